"""Live programs: tiles, windows, sentinels, rolling parts, control, published batches."""

import collections
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basewise import run_fixtures as rf
from basewise import schemas
from basewise.operators.routing import eos_records, eos_rows
from basewise.plans.reader import load_run, run_pairs
from basewise.sinks import write_pairs, write_records
from basewise.sources.calls import cycle_glob, read_cycles, stream_arrivals
from basewise.sources.tables import read_pairs, stream_pairs
from basewise.streaming.commit import folders, manifest, publish, remove, stream_published
from basewise.streaming.complete import completed_samples
from basewise.streaming.control import Controller, run_live, stream_contents
from basewise.streaming.pipeline import write_stream
from basewise.streaming.reader import LAST_BATCH, complete_tiles, stream_run
from basewise.streaming.state import keyed_state
from basewise.streaming.windows import stream_closed_windows
from basewise.streaming.writer import PartWriter, part_files, read_parts


def pairs(spark, start, stop, sample="S1"):
    cols = [F.concat(F.lit(c), F.col("id")).alias(c) for c in ("b1", "q1", "b2", "q2")]
    return spark.range(start, stop, numPartitions=1).select(F.concat(F.lit("read"), F.col("id")).alias("name"), *cols, F.lit(sample).alias("sample"))


def drain(rows, out, state):
    with keyed_state(rows.sparkSession):
        write_stream(rows, out, state, available_now=True).awaitTermination()


def test_a_batch_is_published_once(spark, tmp_path):
    root = str(tmp_path / "root")

    def write(df):
        return lambda folder: write_pairs(df, folder)

    assert publish(spark, root, 0, write(pairs(spark, 0, 3)), facts={"who": "me"})
    assert not publish(spark, root, 0, write(pairs(spark, 0, 9)))
    with pytest.raises(ZeroDivisionError):
        publish(spark, root, 1, lambda folder: (write_pairs(pairs(spark, 3, 5), folder), 1 / 0))
    assert read_pairs(spark, root).count() == 3  # the half of batch 1 stays hidden
    assert publish(spark, root, 1, write(pairs(spark, 3, 5, "S 2")))
    told = manifest(spark, f"{root}/batch=0")
    assert told["who"] == "me" and [p.split("/")[0] for p, _ in told["files"]] == ["sample=S1"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = stream_published(spark, root, schemas.PAIRS).where(F.col("sample").isin("S 2"))
    write_stream(stream, out, state, available_now=True).awaitTermination()
    assert sorted(r["name"] for r in spark.read.schema(schemas.PAIRS).parquet(out).collect()) == ["read3", "read4"]


def test_tiles_leave_once(spark, sf_dir, tmp_path):
    root, out, state = (str(tmp_path / p) for p in ("run", "out", "state"))
    files = rf.run_files(spark, sf_dir, root)
    options = rf.write_head(spark, sf_dir, root)
    cycles = load_run(spark, options).cycles
    base = options.bcl_input_dir + options.base_dir

    def run():
        tiles = complete_tiles(stream_arrivals(spark, base, 100_000), cycles).withColumn("sample", F.lit("x"))
        drain(tiles, out, state)
        return sorted((r["lane"], r["tile"]) for r in spark.read.schema("lane int, tile int, sample string").parquet(out).collect())

    one = (F.col("lane") == 1) & (F.col("tile") == 1101)
    rf.write_files(files.where(one | (F.col("cycle") == 0) | ((F.col("tile") == 1102) & (F.col("cycle") > 1))))
    assert run() == [(1, 1101)]
    rf.write_files(files.where(one & (F.col("cycle") == 5)))  # written again
    rf.write_files(files.where((F.col("tile") == 1102) & (F.col("lane") == 2) & (F.col("cycle") == 1)))
    assert run() == [(1, 1101), (2, 1102)]
    assert run() == [(1, 1101), (2, 1102)]
    # Only the files asked for are listed.
    assert read_cycles(spark, base, tiles=[(2, 1102)], cycles=3).select("lane", "tile", "cycle").distinct().count() == 3
    assert cycle_glob("/b/", [(1, 1101)], 1) == "/b/L001/C1.1/s_1_1101.bcl.gz"


def test_reader_sends_sentinels_after_the_last_tile(spark, sf_dir, tmp_path):
    root, out, state = (str(tmp_path / p) for p in ("run", "out", "state"))
    files = rf.run_files(spark, sf_dir, root)
    options = rf.write_head(spark, sf_dir, root)
    rf.write_files(files.where("tile < 1104"))
    stream_run(spark, options, out, state, available_now=True).awaitTermination()
    assert not folders(spark, f"{out}/pairs/batch={LAST_BATCH}")
    rf.write_files(files.where("tile = 1104"))
    # The commit of the first batch is lost: it is done again, to no effect.
    remove(spark, f"{state}/commits/0")
    stream_run(spark, options, out, state, available_now=True, eos_partitions=2).awaitTermination()
    got = read_pairs(spark, f"{out}/pairs").select("name", "b1", "q1", "b2", "q2", "sample")
    want = run_pairs(spark, options)
    ends = got.where("name = ''").groupBy("sample").count().collect()
    assert {r["count"] for r in ends} == {2} and {r["sample"] for r in ends} == {r["sample"] for r in spark.read.schema(schemas.TOC).parquet(f"{out}/toc").collect()}
    whole = got.where("name <> ''")
    assert whole.count() == want.count() and whole.exceptAll(want.select(*whole.columns)).isEmpty()


def test_windows_hold_whole_pairs(spark, tmp_path):
    data, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))
    schema = "sample string, shard int, window long, pairs int, text string"

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        text = ";".join(sorted(frame["name"] + frame["b1"] + frame["q2"]))
        return frame.iloc[:1][["sample", "shard", "window"]].assign(pairs=len(frame), text=text)

    def run():
        drain(stream_closed_windows(stream_pairs(spark, data, maxFilesPerTrigger="1"), 10, shards=2, close=close, schema=schema), out, state)
        return spark.read.schema(schema).parquet(out).collect()

    for a, b in ((0, 3), (3, 45), (45, 47)):
        pairs(spark, a, b).write.mode("append").parquet(data)
    assert {r["pairs"] for r in run()} == {10}
    eos_rows(pairs(spark, 0, 0), spark.createDataFrame([("S1",)], "sample string")).write.mode("append").parquet(data)
    rows = run()
    assert len({(r["shard"], r["window"]) for r in rows}) == len(rows) and sum(r["pairs"] for r in rows) == 47
    assert sorted(";".join(r["text"] for r in rows).split(";")) == sorted(f"read{i}b1{i}q2{i}" for i in range(47))
    pairs(spark, 47, 50).write.mode("append").parquet(data)  # after the sentinel: at once
    assert sum(r["pairs"] for r in run()) == 50


def test_a_rest_closes_by_timer(spark, tmp_path):
    data = str(tmp_path / "in")
    pairs(spark, 0, 7).write.parquet(data)
    seen = []
    with keyed_state(spark):
        query = (
            stream_closed_windows(stream_pairs(spark, data), 5, shards=1, idle_ms=1500).writeStream
            .foreachBatch(lambda df, n: seen.extend((r["window"], r["name"]) for r in df.collect()))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
        )
    until = time.monotonic() + 60
    while len(seen) < 7 and time.monotonic() < until and query.isActive:
        time.sleep(0.5)
    query.stop()
    assert collections.Counter(w for w, _ in seen) == {0: 5, 1: 2} and len({n for _, n in seen}) == 7


def test_a_sample_ends_on_all_partitions(spark, tmp_path):
    data, out, state = (str(tmp_path / p) for p in ("in", "out", "state"))

    def run(*ends):
        eos_records(spark.createDataFrame(list(ends), "sample string, part int")).write.mode("append").parquet(data)
        stream = spark.readStream.schema(schemas.SAM).parquet(data)
        drain(completed_samples(stream, 3, F.col("pos"), aligned=True), out, state)
        return sorted((r["sample"], r["partitions"]) for r in spark.read.schema("sample string, partitions int").parquet(out).collect())

    assert run(("A", 0), ("A", 1), ("A", 1), ("B", 2)) == []
    assert run(("B", 0), ("B", 1)) == [("B", 3)]
    assert run(("A", 2), ("B", 2)) == [("A", 3), ("B", 3)]


def records(spark, start, stop, sample):
    fields = schemas.SAM.replace("sample string, ", "")
    row = [F.concat(F.lit("r"), F.col("id")).alias("name"), F.lit(sample).alias("sample"), F.repeat(F.md5(F.col("id").cast("string")), 8).alias("seq")]
    df = spark.range(start, stop, numPartitions=1).select(*row)
    empty = spark.createDataFrame([], schemas.SAM)
    assert "sample" not in fields
    return df.unionByName(empty, allowMissingColumns=True).select(*empty.columns)


def test_parts_roll_by_bytes_and_when_idle(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = PartWriter(spark, out, roll_bytes=20_000, idle=3600)
    writer.batch(records(spark, 0, 20, "small").union(records(spark, 0, 50, "S 2")), 0)
    assert not folders(spark, f"{out}/parts/part=*")
    writer.batch(records(spark, 50, 500, "S 2"), 1)
    assert {r["name"] for r in read_parts(spark, out).where("sample = 'S 2'").collect()} == {f"r{i}" for i in range(500)}
    assert read_parts(spark, out).where("sample = 'small'").isEmpty()
    writer.batch(records(spark, 50, 500, "S 2"), 1)  # a replay
    fresh = PartWriter(spark, out, roll_bytes=20_000, idle=3600)  # a restart
    fresh.batch(records(spark, 50, 500, "S 2"), 1)
    fresh.batch(records(spark, 500, 510, "S 2").union(eos_records(spark.createDataFrame([("S 2", 0)], "sample string, part int"))), 2)
    assert read_parts(spark, out).count() == 500
    assert fresh.close(idle=3600) == 0 and fresh.close() == 2
    got = collections.Counter((r["sample"], r["name"]) for r in read_parts(spark, out).collect())
    assert got == {**{("S 2", f"r{i}"): 1 for i in range(510)}, **{("small", f"r{i}"): 1 for i in range(20)}}
    sizes = part_files(spark, out).orderBy("part", "sample").collect()
    assert [(r["part"], r["sample"]) for r in sizes] == [(0, "S 2"), (1, "S 2"), (1, "small")] and sizes[0]["files"] > 1
    assert fresh.close() == 0


def test_batches_of_due_samples_are_written_once(spark, tmp_path, monkeypatch):
    import basewise.streaming.writer as module

    out, whole, calls = str(tmp_path / "out"), write_records, []
    monkeypatch.setattr(module, "write_records", lambda df, folder, **more: (calls.append(folder), whole(df, folder, **more)))
    writer = PartWriter(spark, out, roll_bytes=20_000, idle=3600)
    writer.batch(records(spark, 0, 1000, "A"), 0)  # through an open batch: a row's bytes are not known yet
    assert len(calls) == 2
    two = records(spark, 1000, 2000, "A").union(records(spark, 0, 1000, "B b"))
    writer.batch(two, 1)
    writer.batch(two, 1)  # a replay
    PartWriter(spark, out, roll_bytes=20_000, idle=3600).batch(two, 1)  # and one after a restart
    assert len(calls) == 3 and len(folders(spark, f"{out}/parts/part=*")) == 2
    fresh = PartWriter(spark, out, roll_bytes=20_000, idle=3600)
    some = records(spark, 2000, 3000, "A").union(records(spark, 1000, 1001, "B b"))
    shown = module.show

    def failing(spark, aside, root, number, *more):
        if root.endswith("open"):
            raise OSError("lost")
        return shown(spark, aside, root, number, *more)

    monkeypatch.setattr(module, "show", failing)
    with pytest.raises(OSError):
        fresh.batch(some, 2)  # A is in a part, B b is lost
    monkeypatch.setattr(module, "show", shown)
    fresh.batch(some, 2)
    assert read_parts(spark, out).where("sample = 'B b'").count() == 1000  # the last row waits
    fresh.batch(records(spark, 1001, 2000, "B b"), 3)
    fresh.batch(records(spark, 2000, 2001, "B b"), 4)
    fresh.close()
    got = collections.Counter((r["sample"], r["name"]) for r in read_parts(spark, out).collect())
    assert got == {**{("A", f"r{i}"): 1 for i in range(3000)}, **{("B b", f"r{i}"): 1 for i in range(2001)}}


def test_an_interrupted_part_is_not_seen(spark, tmp_path, monkeypatch):
    import basewise.streaming.writer as module

    out = str(tmp_path / "out")
    writer = PartWriter(spark, out, roll_bytes=1, idle=3600)
    whole = write_records
    calls = []

    def failing(df, folder, **more):
        calls.append(folder)
        whole(df, folder, **more)
        if len(calls) == 2:
            raise OSError("lost")

    monkeypatch.setattr(module, "write_records", failing)
    with pytest.raises(OSError):
        writer.batch(records(spark, 0, 30, "A"), 0)
    assert not folders(spark, f"{out}/parts/part=*")
    writer.batch(records(spark, 0, 30, "A"), 0)
    assert read_parts(spark, out).count() == 30


def test_contents_start_each_sample_once(spark, tmp_path):
    toc, started = str(tmp_path / "toc"), []

    def add(*rows):
        spark.createDataFrame(list(rows), schemas.TOC).write.mode("append").parquet(toc)

    def start(group):
        started.append(group)
        rate = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
        return [rate.writeStream.format("noop").option("checkpointLocation", str(tmp_path / f"s{len(started)}")).trigger(processingTime="1 second").start()]

    add((0, 0, "A"), (0, 1, "B"), (0, 2, "C"), (1, 3, "other"))
    control = Controller(spark, stream_contents(spark, toc), 0, 2, start, str(tmp_path / "state"))
    added = []

    def done():
        if len(started) == 2 and not added:
            added.append(add((0, 2, "C"), (0, 3, "D")))
        return len(started) == 3

    def step_without_rest():
        for q in control.queries:
            q.stop()

    control.finish = step_without_rest
    assert run_live([control], done)
    assert started == [["A", "B"], ["C"], ["D"]] and not control.watcher.isActive


def test_a_quiet_program_ends(spark, tmp_path):
    toc = str(tmp_path / "toc")
    spark.createDataFrame([(0, 0, "A")], schemas.TOC).write.parquet(toc)
    control = Controller(spark, stream_contents(spark, toc), 0, 3, lambda group: [], str(tmp_path / "state"), timeout=3)
    began = time.monotonic()
    assert not run_live([control]) and time.monotonic() - began >= 3
