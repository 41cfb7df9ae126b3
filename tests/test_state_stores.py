"""State stores of a stream."""

from basewise.streaming.state import keyed_state


def test_keyed_state_opens_no_more_stores_than_asked(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    with keyed_state(spark, 2):
        assert spark.conf.get(name) == "2"
    with keyed_state(spark, 1 << 20):
        assert spark.conf.get(name) == before
    assert spark.conf.get(name) == before
