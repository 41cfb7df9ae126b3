"""Registered queries over run folders and live programs; see :mod:`basewise.run_fixtures`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise import fixtures as fx
from basewise import run_fixtures as rf
from basewise import schemas
from basewise.functions.cigar import cigar_format
from basewise.operators.demux import table_of_contents
from basewise.operators.reference import Reference, reference_index
from basewise.operators.routing import drop_eos, eos_rows
from basewise.plans.reader import run_clusters, run_pairs
from basewise.registry import query
from basewise.session import materialize, scratch_path
from basewise.sinks import write_pairs, write_records
from basewise.sources.calls import read_controls
from basewise.sources.tables import read_pairs, read_records, read_reference, stream_pairs, stream_records
from basewise.streaming.commit import exists, folders, remove
from basewise.streaming.complete import completed_samples
from basewise.streaming.control import run_live
from basewise.streaming.live import LiveWriter, live_aligner
from basewise.streaming.pipeline import align_stream, window_sizes, write_stream
from basewise.streaming.reader import LAST_BATCH, stream_run
from basewise.streaming.state import keyed_state
from basewise.streaming.writer import PartWriter, read_parts, write_parts_stream

_PAIRS = "select name, b1, q1, b2, q2, sample from pairs"


@query(_PAIRS)
def run_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest, sheet, cycle, filter and location files, read back as pairs."""
    return run_pairs(spark, rf.run_folder(spark, sf_dir))


@query(_PAIRS)
def dual_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with two index reads and a sheet with two barcode columns."""
    options = rf.run_folder(spark, sf_dir, reads=((36, "N"), (4, "Y"), (4, "Y"), (36, "N")), dual_index="1")
    return run_pairs(spark, options)


@query("""
select cast(lane as int) as lane, cast(tile as int) as tile, cast(cid // 8 as bigint) as cluster,
  cast(1000 + cid // 8 // 200 % 82 * 250 + cid // 8 % 200 as int) as x,
  cast(1000 + cid // 8 // 200 // 82 * 250 + cid // 8 // 200 % 250 as int) as y
from fx_clusters where pf = 1""")
def clocs_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing clusters with places from the compressed location file."""
    return run_clusters(spark, rf.run_folder(spark, sf_dir), locs_format="clocs").select("lane", "tile", "cluster", "x", "y")


@query("""
select lane, tile, cast(k as bigint) as cluster, cast((k * 7 + tile) % 97 as smallint) as control, concat((k * 7 + tile) % 97, ':') as text
from (select lane, tile, unnest(range(0, n + 1)) as k from (select lane, tile, max(cid // 8) as n from fx_clusters group by all))""")
def control_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control files, one number a cluster."""
    root = scratch_path(spark, "run")
    rf.write_files(rf.control_files(spark, sf_dir, root))
    return read_controls(spark, f"{root}/{rf.BASE}")


@query(_PAIRS)
def stream_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reader live: half of the files come, then the rest, to a reader started anew from its checkpoint."""
    root, out, checkpoint = (scratch_path(spark, p) for p in ("run", "live", "state"))
    files = rf.run_files(spark, sf_dir, root)
    options = rf.write_head(spark, sf_dir, root)
    early = (F.col("tile") % 2 == 1) | (F.col("cycle") % 3 == 0)
    for part in (early, ~early):
        rf.write_files(files.where(part))
        stream_run(spark, options, out, checkpoint, available_now=True).awaitTermination()
    return drop_eos(read_pairs(spark, f"{out}/pairs")).select("name", "b1", "q1", "b2", "q2", "sample")


_WINDOW, _SHARDS = 100, 4
_SAM = "name, read_no, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, sam.sample"


def _sam(records: DataFrame) -> DataFrame:
    return records.withColumn("cigar", cigar_format(F.col("cigar"))).select(*_SAM.replace("sam.", "").split(", "))


@query(f"""
with s as (
  select sample, cast(('0x' || substr(md5(name), 1, 4)) as int) % {_SHARDS} as shard, count(*) as n from pairs group by all),
w as (select sample, sum((n + {_WINDOW} - 1) // {_WINDOW}) as windows, sum(n // {_WINDOW}) as whole from s group by sample)
select {_SAM},
  cast(windows as bigint) as windows, cast(whole as bigint) as whole
from sam join w on w.sample = sam.sample""")
def stream_window_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pairs in count windows, each mapped when it closes; the sentinels come in a second run from the same checkpoint."""
    data, out, checkpoint = (scratch_path(spark, p) for p in ("topic", "aligned", "state"))
    pairs = materialize(fx.pairs(spark, sf_dir), "pairs")
    index = reference_index(fx.contigs(spark, sf_dir), 12)
    shard = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 4), 16, 10).cast("int") % _SHARDS
    samples = table_of_contents(fx.sheet(spark, sf_dir))
    for rows in (pairs, eos_rows(pairs, samples)):
        write_pairs(rows, data, mode="append")
        align_stream(stream_pairs(spark, data), index, out, checkpoint, available_now=True, window=_WINDOW, shards=_SHARDS, shard=shard, stores=samples.count() * _SHARDS).awaitTermination()
    sizes = window_sizes(spark, out).groupBy("sample").agg(F.count("*").alias("windows"), F.count_if(F.col("pairs") == _WINDOW).alias("whole"))
    return _sam(drop_eos(read_records(spark, out), aligned=True)).join(sizes, "sample")


@query(f"select {_SAM} from sam")
def stream_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as a file stream to rolling parts; the last batch is done twice, as after a failure before its commit."""
    data, out, checkpoint = (scratch_path(spark, p) for p in ("topic", "written", "state"))
    records = materialize(fx.records(spark, sf_dir), "records")
    writer = PartWriter(spark, out, roll_bytes=200_000, idle=3600)
    for part in range(2):
        write_records(records.where(F.pmod(F.xxhash64("name"), F.lit(2)) == part), data, mode="append")
        write_parts_stream(stream_records(spark, data, maxFilesPerTrigger="8"), writer, checkpoint, available_now=True).awaitTermination()
    remove(spark, max(folders(spark, f"{checkpoint}/commits/[0-9]*"), key=lambda f: int(f.rsplit("/", 1)[1])))
    write_parts_stream(stream_records(spark, data, maxFilesPerTrigger="8"), writer, checkpoint, available_now=True).awaitTermination()
    writer.close()
    return _sam(read_parts(spark, out))


@query("""
select sample, 4 as partitions, cast(case when ascii(right(sample, 1)) % 2 = 1 then 2 else 1 end as int) as run, count(*) as pairs
from pairs group by sample""")
def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose sentinels have come on all four partitions; for half of them one comes late."""
    data, out, checkpoint = (scratch_path(spark, p) for p in ("topic", "complete", "state"))
    pairs = materialize(fx.pairs(spark, sf_dir), "pairs")
    present = pairs.select("sample").distinct()
    ends = eos_rows(pairs, present).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("part")))
    late = (F.col("part") == 2) & (F.ascii(F.right("sample", F.lit(1))) % 2 == 1)
    rows = pairs.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(4)).cast("int")).unionByName(ends.where(~late))
    found = []
    for some in (rows, ends.where(late)):
        some.write.mode("append").partitionBy("part").parquet(data)
        stream = spark.readStream.schema(f"{schemas.PAIRS}, part int").parquet(data)
        with keyed_state(spark, 1):
            write_stream(completed_samples(stream, 4, F.col("part")), out, checkpoint, available_now=True).awaitTermination()
        found.append(materialize(spark.read.schema("sample string, partitions int").parquet(out), "complete"))
    first = found[0].select("sample", F.lit(1).alias("run"))
    runs = found[1].join(first, "sample", "left").select("sample", "partitions", F.coalesce("run", F.lit(2)).alias("run"))
    return runs.join(pairs.groupBy("sample").agg(F.count("*").alias("pairs")), "sample")


@query(f"select {_SAM} from sam")
def live_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader, aligner and writer at once: files come in two lots, contents start the work, sentinels end it."""
    root, data, state = (scratch_path(spark, p) for p in ("run", "live", "state"))
    files = rf.run_files(spark, sf_dir, root)
    options = rf.write_head(spark, sf_dir, root, rapi_win="500", aligner_timeout="100", writer_timeout="100")
    # Names of pairs with an even tile come late.
    early = (F.col("tile") % 2 == 1) | (F.col("cycle") % 3 == 0)
    rf.write_files(files.where(early))
    reader = stream_run(spark, options, data, f"{state}/reader", every="1 second")
    aligner = live_aligner(spark, options, data, reference_index(fx.contigs(spark, sf_dir), 12), f"{state}/aligner", shards=2, group_size=8, every="1 second")
    writer = LiveWriter(spark, options, data, f"{state}/writer", shards=2, group_size=8, every="1 second")
    samples = {r["sample"] for r in table_of_contents(fx.sheet(spark, sf_dir)).select("sample").collect()}

    def done() -> bool:
        # Behind the sentinels there is nothing to read: no more listing of the run folder.
        if reader.isActive and exists(spark, f"{data}/pairs/batch={LAST_BATCH}"):
            reader.stop()
        return writer.complete >= samples

    try:
        rf.write_files(files.where(~early))
        if not run_live([aligner, writer], done):
            raise TimeoutError("no rows for too long")
    finally:
        reader.stop()
    return _sam(read_parts(spark, options.cram_output_dir))


# A contig of 32 bases for every fifth order, so that contigs grow with the data.
_LONG = """
with l as (select o_orderkey % 5 as k, o_orderkey, translate(md5(cast(o_orderkey as varchar(20))), '0123456789abcdef', 'ACGTACGTACGTACGT') as b from orders),
w as (select k, string_agg(b, '' order by o_orderkey) as seq from l group by k),
"""


def _long_reference(spark: SparkSession, sf_dir: str) -> Reference:
    """The contigs written as FASTA, one order a line, in many files, and read back."""
    hexes = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
    lines = fx.table(spark, sf_dir, "orders").selectExpr("o_orderkey % 5 as k", "o_orderkey as at", f"lower(translate(md5(cast(o_orderkey as string)), {hexes})) as value")
    titles = lines.select("k").distinct().selectExpr("k", "-1l as at", "concat('>long', k, ' x AS:build', k % 2, case when k = 3 then '' else concat(' SP:sp', k) end) as value")
    path = scratch_path(spark, "fasta")
    lines.unionByName(titles).repartitionByRange(7, "k", "at").sortWithinPartitions("k", "at").select("value").write.text(path)
    return read_reference(spark, path)


@query(_LONG + """
c as (select k, seq, unnest(range(0, (length(seq) + 1023) // 1024)) as chunk from w)
select concat('long', k) as contig, cast(chunk as int) as chunk, cast(least(1024, length(seq) - chunk * 1024) as int) as own,
  md5(substr(concat('^', seq), cast(chunk * 1024 + 1 as bigint), 2049)) as bases_md5
from c""")
def reference_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the bases around them, cut from the lines."""
    found = _long_reference(spark, sf_dir)
    return found.chunks.join(found.contigs, "ref_idx").select("contig", "chunk", "own", F.md5(F.col("bases").cast("binary")).alias("bases_md5"))


@query(_LONG + """
t as (select k, cast(row_number() over (order by k) - 1 as int) as ref_idx, seq from w)
select ref_idx, concat('long', k) as contig, cast(length(seq) as int) as length, md5(seq) as md5, concat('build', k % 2) as assembly,
  case when k <> 3 then concat('sp', k) end as species
from t""")
def reference_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and digests of contigs of which no task or row holds the whole, with assembly and species."""
    return _long_reference(spark, sf_dir).contigs
