"""Differences of several copies of a table in one pass, and listings of many folders."""

from contextlib import redirect_stdout
from io import StringIO

from basewise.operators.routing import roundtrip_diffs
from basewise.session import bounded_listing


def test_copies_are_compared_in_one_aggregation_of_digests(spark):
    ddl = "name string, n int, list array<string>"
    rows = spark.createDataFrame([("a", 1, ["x"]), ("a", 1, ["x"]), ("", None, []), (None, 2, None), ("a,b", 3, ["c"])], ddl)
    other = spark.createDataFrame([("a", 1, ["x"]), (None, None, []), (None, 2, None), ("a", 3, ["b,c"]), ("z", 9, ["x"])], ddl)
    found = roundtrip_diffs(rows, {"same": rows, "other": other}, ["name", "n", "list"])
    lost = rows.exceptAll(other).count() + other.exceptAll(rows).count()
    assert [tuple(r) for r in found.orderBy("format").collect()] == [("other", 5, 5, lost), ("same", 5, 5, 0)]
    text = StringIO()
    with redirect_stdout(text):
        found.explain()
    shuffles = [line for line in text.getvalue().splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 1 and "list" not in shuffles[0]
    nothing = rows.limit(0)
    assert [tuple(r) for r in roundtrip_diffs(nothing, {"p": nothing}, ["name"]).collect()] == [("p", 0, 0, 0)]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    spark.range(300).selectExpr("cast(id as string) as value", "id as part").write.partitionBy("part").text(f"{tmp_path}/t")
    tracker, group = spark.sparkContext.statusTracker(), "listing"
    spark.sparkContext.setJobGroup(group, group)
    with bounded_listing(spark):
        table = spark.read.schema("value string, part int").text(f"{tmp_path}/t")
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
    assert tasks and max(tasks) <= 4 * spark.sparkContext.defaultParallelism
    assert table.count() == 300
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
