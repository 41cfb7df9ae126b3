"""Streams: windows over several batches, restarts, stop rules."""

import collections
import time

import pytest
from pyspark.sql import functions as F

from basewise.options import OptionError, Options, parse_properties
from basewise.sources.tables import stream_pairs
from basewise.streaming.pipeline import write_stream
from basewise.streaming.stop import run_until_idle
from basewise.streaming.windows import stream_count_windows


def pairs(spark, start, stop, sample="S1", name=None):
    label = F.concat(F.lit("read"), F.col("id")) if name is None else F.lit(name)
    blank = [F.lit("").alias(c) for c in ("b1", "q1", "b2", "q2")]
    return spark.range(start, stop, numPartitions=1).select(label.alias("name"), *blank, F.lit(sample).alias("sample"))


OUT = "name string, sample string, shard int, window long"


def test_rest_waits_across_batches_and_restarts(spark, tmp_path):
    data, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))

    def run():
        stream = stream_pairs(spark, data, maxFilesPerTrigger="1")
        windows = stream_count_windows(stream, 10, shards=1)
        write_stream(windows, out, state, available_now=True).awaitTermination()
        return spark.read.schema(OUT).parquet(out).collect()

    for a, b in ((0, 7), (7, 18), (18, 24)):
        pairs(spark, a, b).write.mode("append").parquet(data)
    sizes = collections.Counter(r["window"] for r in run())
    assert sizes == {0: 10, 1: 10}
    pairs(spark, 24, 27).write.mode("append").parquet(data)
    assert len(run()) == 20
    pairs(spark, 0, 1, name="").write.mode("append").parquet(data)
    rows = run()
    assert collections.Counter(r["window"] for r in rows) == {0: 10, 1: 10, 2: 7}
    assert sorted(r["name"] for r in rows) == sorted(f"read{i}" for i in range(27))


def test_sentinel_reaches_every_shard(spark, tmp_path):
    data, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    pairs(spark, 0, 100).unionByName(pairs(spark, 0, 1, name="")).coalesce(1).write.parquet(data)
    write_stream(stream_count_windows(stream_pairs(spark, data), 7, shards=5), out, state, available_now=True).awaitTermination()
    rows = spark.read.schema(OUT).parquet(out).collect()
    assert sorted(r["name"] for r in rows) == sorted(f"read{i}" for i in range(100))
    per_window = collections.Counter((r["shard"], r["window"]) for r in rows)
    assert max(per_window.values()) == 7 and len({s for s, _ in per_window}) == 5


def test_stops_when_idle(spark, tmp_path):
    data, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    pairs(spark, 0, 5).write.parquet(data)
    query = write_stream(stream_pairs(spark, data), out, state, every="200 milliseconds")
    began = time.monotonic()
    assert run_until_idle(query, timeout=3, poll=0.3)
    assert not query.isActive and time.monotonic() - began >= 3
    assert spark.read.parquet(out).count() == 5
    # A restart from the same checkpoint reads only what is new; a fresh one rereads.
    pairs(spark, 5, 6).write.mode("append").parquet(data)
    write_stream(stream_pairs(spark, data), out, state, available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 6
    fresh = str(tmp_path / "fresh")
    write_stream(stream_pairs(spark, data), fresh, str(tmp_path / "state2"), available_now=True).awaitTermination()
    assert spark.read.parquet(fresh).count() == 6


def test_aligned_stream_ends_at_its_sentinel(spark, sf_dir, tmp_path):
    from basewise import fixtures as fx
    from basewise.operators.routing import drop_eos
    from basewise.sinks import write_records
    from basewise.sources.tables import read_records, stream_records

    data, out = str(tmp_path / "records"), str(tmp_path / "out")
    records = fx.records(spark, sf_dir)
    write_records(records, data)
    write_records(records.limit(3).withColumn("name", F.lit("EOS")), data, mode="append")
    live = drop_eos(stream_records(spark, data), aligned=True)
    write_stream(live, out, str(tmp_path / "state"), available_now=True).awaitTermination()
    assert read_records(spark, data).count() == records.count() + 3
    got, want = (d.drop("tags") for d in (read_records(spark, out), records))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == want.count()


def test_rebalance(spark):
    from basewise.operators.routing import rebalance

    parts = rebalance(spark.range(1000, numPartitions=1), 4).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert [r["count"] for r in parts] == [250] * 4


def test_all_index_reads(spark):
    from basewise.operators.reads import decode_index

    df = spark.createDataFrame([(bytes([4, 5]), bytes([6, 7, 0]))], "i1 binary, i2 binary")
    assert decode_index(df).first()["idx"] == "AC" and decode_index(df, all_reads=True).first()["idx"] == "ACGTN"


def test_options():
    text = "# run\nbcl_input_dir = hdfs:///run\ncram_output_dir: o\nreference=r\nflink_tmp_dir = t\nmismatches = 2\n"
    got = Options.from_dict(text, {"reference": "other"})
    assert (got.bcl_input_dir, got.reference, got.mismatches) == ("hdfs:///run/", "other", 2)
    assert got.sample_sheet == "hdfs:///run/SampleSheet.csv" and got.undet == "Undetermined"
    assert parse_properties("a = b=c\n\n!x\nk") == {"a": "b=c", "k": ""}
    with pytest.raises(OptionError, match="cram_output_dir, reference, flink_tmp_dir"):
        Options.from_dict("bcl_input_dir = x")
    with pytest.raises(OptionError, match="mismatches must be a number"):
        Options.from_dict(text, {"mismatches": "many"})
