"""Registered queries: one per operator, each with its DuckDB twin.

Every query runs over whole tables: clusters are orders, barcodes nations, contigs
regions (see :mod:`basewise.fixtures`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basewise import fixtures as fx
from basewise import schemas
from basewise.functions import barcodes, cigar, decode, tags, wire
from basewise.operators import alignment, containers, demux, layout, mapping, ranking, reads, reference, routing, tracks
from basewise.operators.transpose import cycle_blocks, transpose
from basewise.plans.aligner import republish_toc
from basewise.registry import ORACLES, QUERIES, query
from basewise.session import materialize, scratch_path
from basewise.sinks import write_pairs, write_records, write_sam_text
from basewise.sources.tables import pairs_from_messages, read_fasta, read_records, read_sam_text, stream_pairs
from basewise.streaming.pipeline import align_stream, write_stream
from basewise.streaming.windows import stream_count_windows

# ---------------------------------------------------------------- run layout


@query("""
select cast(lane as int) as lane, cast(tile as int) as tile, count(*) as clusters, cast(sum(pf) as bigint) as passed
from fx_clusters group by lane, tile""")
def enumerate_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tile product of the layout the data implies, with the clusters of each tile."""
    found = fx.clusters(spark, sf_dir).groupBy("lane", "tile").agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("pf").alias("passed")
    )
    found = materialize(found, "tiles")
    shape = found.agg(
        F.max("lane").alias("lanes"), F.max(F.expr("tile div 1000")).alias("surfaces"),
        F.max(F.expr("tile div 100 % 10")).alias("swaths"), F.max(F.col("tile") % 100).alias("tiles"),
    )
    return layout.enumerate_tiles(shape).join(found, ["lane", "tile"], "left").select(
        "lane", "tile", F.coalesce("clusters", F.lit(0)).cast("long").alias("clusters"),
        F.coalesce("passed", F.lit(0)).cast("long").alias("passed"),
    )


@query("""
with n as (select lane, max(length(r1)) as a, max(length(idx_obs)) as b, max(length(r2)) as c from fx_clusters group by lane)
select lane, 1 as read_no, 0 as is_index, 1 as first_cycle, cast(a as int) as last_cycle from n
union all select lane, 2, 1, cast(a + 1 as int), cast(a + b as int) from n
union all select lane, 3, 0, cast(a + b + 1 as int), cast(a + b + c as int) from n""")
def cycle_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle ranges per lane, from the read lengths seen in the data."""
    seen = fx.clusters(spark, sf_dir).groupBy("lane").agg(
        *[F.max(F.length(c)).alias(c) for c in ("r1", "idx_obs", "r2")]
    )
    sizes = seen.select(
        "lane",
        F.posexplode(F.array(*[
            F.struct(F.col(c).alias("num_cycles"), F.lit(c == "idx_obs").alias("is_index")) for c in ("r1", "idx_obs", "r2")
        ])).alias("_i", "_r"),
    ).select("lane", (F.col("_i") + 1).alias("read_no"), "_r.*")
    return layout.cycle_ranges(sizes, ["lane"]).withColumn("is_index", F.col("is_index").cast("int"))


# ------------------------------------------------------- transposition, filter


def _transposed(spark: SparkSession, sf_dir: str, block_size: int = 4096) -> DataFrame:
    """Clusters by way of cycle blocks: packed per cycle, shuffled, transposed, filtered."""
    packed = cycle_blocks(fx.calls(fx.with_position(fx.clusters(spark, sf_dir))), block_size)
    # Written once: calls and filter are two scans of one run folder, not two runs.
    blocks = materialize(packed, "blocks")
    return transpose(
        blocks.where(F.col("cycle") > 0), blocks.where(F.col("cycle") == 0).drop("cycle"), fx.READS, block_size=block_size
    )


@query("""
select cast(c.lane as int) as lane, cast(c.tile as int) as tile, cast(c.cid // 8 as bigint) as cluster,
  max(raw) filter (part = 1) as raw1, max(raw) filter (part = 0) as idx_raw, max(raw) filter (part = 2) as raw2
from fx_clusters c join part p using (cid) group by c.cid, c.lane, c.tile""")
def transpose_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transposed(spark, sf_dir).select(
        "lane", "tile", "cluster", F.hex("r1").alias("raw1"), F.hex("i1").alias("idx_raw"), F.hex("r2").alias("raw2")
    )


@query("select lane, tile, cast(sum(pf) as bigint) as passed, count(*) as total from fx_clusters group by lane, tile")
def pass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.clusters(spark, sf_dir).groupBy("lane", "tile").agg(
        F.count(F.when(F.col("pf") == 1, 1)).alias("passed"), F.count(F.lit(1)).alias("total")
    )


# -------------------------------------------------------------------- decoding


def _both_reads(spark: SparkSession, sf_dir: str, fn: Callable[[Column], Column]) -> DataFrame:
    return reads.explode_reads(fx.raw(spark, sf_dir)).select("name", F.col("read_no").cast("int").alias("read_no"), fn(F.col("raw")).alias("text"))


@query("select n.name, p.part as read_no, p.plain_bases as text from named n join part p using (cid) where p.part > 0")
def decode_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_reads(spark, sf_dir, lambda r: decode.bases(r, mask=False))


@query("select n.name, p.part as read_no, p.plain_quals as text from named n join part p using (cid) where p.part > 0")
def decode_quals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_reads(spark, sf_dir, lambda r: decode.quals(r, mask=False))


@query("select n.name, p.part as read_no, p.bases, p.quals from named n join part p using (cid) where p.part > 0")
def mask_nocalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = reads.explode_reads(fx.raw(spark, sf_dir)).select(
        "name", "read_no", decode.bases(F.col("raw"), mask=False).alias("b"), decode.quals(F.col("raw"), mask=False).alias("q")
    )
    return plain.select(
        "name", F.col("read_no").cast("int").alias("read_no"),
        decode.mask_bases(F.col("b"), F.col("q")).alias("bases"), decode.mask_quals(F.col("q")).alias("quals"),
    )


@query("select name, idx as text from named")
def decode_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.decode_index(fx.raw(spark, sf_dir)).select("name", F.col("idx").alias("text"))


@query("select cid, name from named")
def read_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.raw(spark, sf_dir).select("cid", "name")


def _fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.to_fastq(reads.explode_reads(reads.decode_index(fx.raw(spark, sf_dir)))).withColumn(
        "read_no", F.col("read_no").cast("int")
    )


@query("select name, r as read_no, concat('@', name, ' ', r, ':N:0:', idx, chr(10)) as header from named, (values (1), (2)) v(r)")
def fastq_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fastq(spark, sf_dir).select("name", "read_no", "header")


@query("select n.name, p.part as read_no, p.raw from named n join part p using (cid) where p.part > 0")
def explode_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_reads(spark, sf_dir, F.hex).withColumnRenamed("text", "raw")


@query("""
select concat('@', n.name, ' ', p.part, ':N:0:', n.idx, chr(10)) as header, p.bases, p.quals
from named n join part p using (cid) where p.part > 0""")
def to_fastq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fastq(spark, sf_dir).select("header", "bases", "quals")


@query("""
select n.name, p.part as read_no,
  concat('@', n.name, ' ', p.part, ':N:0:', n.idx, chr(10), p.bases, chr(10), '+', chr(10), p.quals, chr(10)) as text
from named n join part p using (cid) where p.part > 0""")
def fastq_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = decode.fastq_text(F.col("header"), F.col("bases"), F.col("quals"))
    return _fastq(spark, sf_dir).select("name", "read_no", text.alias("text"))


@query("select name, b1, q1, b2, q2, sample from pairs")
def to_read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = reads.decode_index(fx.raw(spark, sf_dir))
    return reads.to_read_pairs(demux.demux_assign(keyed, fx.sheet(spark, sf_dir)))


@query("select name, concat_ws(chr(9), name, b1, q1, b2, q2) as text from pairs")
def pair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = decode.pair_text(*map(F.col, ("name", "b1", "q1", "b2", "q2")))
    return fx.pairs(spark, sf_dir).select("name", line.alias("text"))


SHORT_ADAPTER = "AGATCGGAAGAGC"


@query(f"""
with adapter as (
  select 1 as adapter_no, substr(seq, 11, 20) as ad from fx_contigs where ref_idx = 0
  union all select 2, '{SHORT_ADAPTER}'),
step as (
  select r.name, r.read_no, a.adapter_no, p, i, substr(a.ad, i::int, 1) as x, substr(r.seq, (p + i)::int, 1) as y
  from reads r, adapter a, range(0, 36) ps(p), range(1, 21) ix(i)
  where i <= least(length(a.ad), length(r.seq) - p)),
running as (
  select *, sum((x = y and x <> 'N')::int) over w as m, sum((x <> y and x <> 'N' and y <> 'N')::int) over w as mm
  from step window w as (partition by name, read_no, adapter_no, p order by i)),
score as (
  select name, read_no, adapter_no, p, max(m) as m, max(mm) as mm, bool_or(mm > 1 and mm > m) as dead
  from running group by all),
hit as (
  select name, read_no, adapter_no, min(p) filter (not dead and m > 0 and 10 * m >= 9 * (m + mm)) as hit
  from score group by all),
cut as (
  select r.*, h.adapter_no, cast(case when coalesce(hit, length(seq)) < 22 then 0 else coalesce(hit, length(seq)) end as int) as start
  from reads r join hit h using (name, read_no))
select name, cast(read_no as int) as read_no, cast(adapter_no as int) as adapter_no, start,
  concat(left(seq, start), repeat('N', length(seq) - start)) as bases,
  concat(left(qual, start), repeat('#', length(qual) - start)) as quals
from cut""")
def trim_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two adapters: one that occurs in the reads and a usual short one."""
    contigs = fx.contigs(spark, sf_dir).where(F.col("ref_idx") == 0)
    found = contigs.select(F.substring("seq", 11, 20).alias("a")).first()["a"]
    rows = fx.stored_reads(spark, sf_dir).select("name", "read_no", F.col("seq").alias("bases"), F.col("qual").alias("quals"))
    done = [
        reads.trim_adapter(rows, a).withColumn("adapter_no", F.lit(i)) for i, a in ((1, found), (2, SHORT_ADAPTER))
    ]
    return done[0].unionByName(done[1]).select("name", "read_no", "adapter_no", "start", "bases", "quals")


@query("""
with letter as (select * from (values ('A'), ('C'), ('G'), ('T')) v(l)),
word as (select a.l || b.l || c.l || d.l as kmer from letter a, letter b, letter c, letter d),
observed as (select substr(seq, i::int, 4) as kmer from (select seq, unnest(range(1, length(seq) - 2)) as i from reads))
select w.kmer, count(s.kmer) as n from word w left join observed s using (kmer) group by w.kmer""")
def enumerate_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.kmer_spectrum(fx.reads(spark, sf_dir), 4)


# ---------------------------------------------------------------------- demux


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.decode_index(fx.raw(spark, sf_dir))


@query("""
select name, idx, tidx as expected,
  cast((select count(*) from range(1, 9) t(i) where substr(idx, i::int, 1) <> substr(tidx, i::int, 1)) as int) as distance
from named""")
def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster's observed barcode against the one it was made from."""
    rows = fx.clusters(spark, sf_dir).where(F.col("pf") == 1)
    made = fx.calls(fx.with_position(rows)).select(
        fx.name_column().alias("name"), decode.bases(F.substring("calls", 37, 8)).alias("idx"), F.col("tidx").alias("expected")
    )
    return made.withColumn("distance", barcodes.hamming(F.col("idx"), F.col("expected")))


_MATCH_SQL = """
select s.lane, s.idx, m.best_idx, cast(coalesce(m.distance, -1) as int) as distance, cast(coalesce(m.ties, 0) as int) as ties
from seen s left join nearest m using (lane, idx)"""


@query(_MATCH_SQL)
def demux_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.demux_match(_indexed(spark, sf_dir), fx.sheet(spark, sf_dir))


@query(_MATCH_SQL)
def demux_match_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answer by the path for wide neighbourhoods."""
    seen = _indexed(spark, sf_dir).select("lane", "idx").distinct()
    best = demux.match_distinct(seen, fx.sheet(spark, sf_dir))
    return seen.join(best, ["lane", "idx"], "left").select(
        "lane", "idx", "best_idx", F.coalesce("distance", F.lit(-1)).alias("distance"), F.coalesce("ties", F.lit(0)).alias("ties")
    )


@query("select name, sample from pairs")
def demux_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.demux_assign(_indexed(spark, sf_dir), fx.sheet(spark, sf_dir)).select("name", "sample")


@query("select sample, count(*) as pairs, cast(count(distinct lane) as int) as lanes from pairs group by sample")
def merge_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of single lanes merged: a sample's lanes form one output."""
    assigned = demux.demux_assign(_indexed(spark, sf_dir), fx.sheet(spark, sf_dir)).select("lane", "sample")
    stored = materialize(assigned, "assigned")
    # A run has a handful of lanes.
    lanes = [stored.where(F.col("lane") == r["lane"]) for r in stored.select("lane").distinct().collect()]
    per_lane = routing.merge_lanes(*lanes).groupBy("sample", "lane").agg(F.count(F.lit(1)).alias("n"))
    return per_lane.groupBy("sample").agg(F.sum("n").alias("pairs"), F.count(F.lit(1)).cast("int").alias("lanes"))


@query("select t.id, t.sample, count(p.name) as pairs from toc t left join pairs p using (sample) group by t.id, t.sample")
def sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demux.sample_counts(fx.pairs(spark, sf_dir), demux.table_of_contents(fx.sheet(spark, sf_dir)))


def _toc_of_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the samples that occur in the data."""
    return demux.table_of_contents(fx.pairs(spark, sf_dir).select("sample").distinct())


@query("""
with present as (select distinct sample from pairs union select 'Undetermined')
select 0 as key, cast(row_number() over (order by sample) - 1 as int) as id, sample from present""")
def toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toc_of_data(spark, sf_dir)


@query("""
with present as (select distinct sample from pairs union select 'Undetermined'),
t as (select row_number() over (order by sample) - 1 as id, sample from present)
select k as key, string_agg(concat(id, ' ', sample), chr(10) order by id) as value from t, (values (0), (1)) v(k) group by k""")
def toc_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages: the reader's contents and the aligner's copy."""
    contents = _toc_of_data(spark, sf_dir)
    return demux.toc_lines(contents.unionByName(republish_toc(contents)))


@query("""
with present as (select distinct sample from pairs union select 'Undetermined')
select 1 as key, cast(row_number() over (order by sample) - 1 as int) as id, sample from present""")
def toc_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both messages written, the aligner's parsed back."""
    contents = _toc_of_data(spark, sf_dir)
    return demux.parse_toc(demux.toc_lines(contents.unionByName(republish_toc(contents))), key=1)


# ----------------------------------------------------------- messages, windows


def _length_prefixed(c: str) -> str:
    return f"lpad(upper(to_hex(strlen({c}))), 8, '0'), upper(hex(encode({c})))"


@query(f"select name, concat({', '.join(_length_prefixed(c) for c in ('name', 'b1', 'q1', 'b2', 'q2'))}) as value from pairs")
def encode_prq(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = wire.encode_prq(*map(F.col, ("name", "b1", "q1", "b2", "q2")))
    return fx.pairs(spark, sf_dir).select("name", F.hex(value).alias("value"))


@query("select name, b1, q1, b2, q2 from pairs")
def parse_prq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs encoded as messages and parsed back."""
    value = wire.encode_prq(*map(F.col, ("name", "b1", "q1", "b2", "q2")))
    messages = fx.pairs(spark, sf_dir).select(value.alias("value"), "sample")
    return pairs_from_messages(messages).drop("sample")


@query("select name, read_no, cast(ref_idx as int) as ref_idx from sam")
def contig_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.contig_index(fx.records(spark, sf_dir), fx.contigs(spark, sf_dir)).select("name", "read_no", "ref_idx")


@query("""
select sample, cast((rn - 1) % 7 as int) as slot, count(*) as n
from (select sample, row_number() over (partition by sample order by name) as rn from pairs) group by all""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = ranking.round_robin(fx.pairs(spark, sf_dir).select("sample", "name"), 7, ["sample"], [F.col("name")])
    return dealt.groupBy("sample", "slot").agg(F.count(F.lit(1)).alias("n"))


@query("""
select sample, cast((rn - 1) // 100 as bigint) as "window", count(*) as n, min(name) as first_name
from (select sample, name, row_number() over (partition by sample order by name) as rn from pairs) group by all""")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = ranking.count_windows(fx.pairs(spark, sf_dir).select("sample", "name"), 100, ["sample"], [F.col("name")])
    return cut.groupBy("sample", "window").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name"))


_SHARDS = 4


@query(f"""
with s as (
  select sample, cast(('0x' || substr(md5(name), 1, 4)) as int) % {_SHARDS} as shard, count(*) as n from pairs group by all),
w as (select sample, shard, n, unnest(range(0, (n + 99) // 100)) as k from s)
select sample, cast(shard as int) as shard, cast(k as bigint) as "window", cast(least(100, n - 100 * k) as bigint) as n from w""")
def stream_count_windows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as a file stream; sentinels follow in a second run from the same checkpoint."""
    pairs = fx.pairs(spark, sf_dir)
    data, out, checkpoint = (scratch_path(spark, p) for p in ("topic", "windows", "state"))
    write_pairs(pairs, data)
    samples = demux.table_of_contents(fx.sheet(spark, sf_dir))
    shard = F.conv(F.substring(F.md5(F.col("name").cast("binary")), 1, 4), 16, 10).cast("int") % _SHARDS

    def run() -> None:
        windows = stream_count_windows(stream_pairs(spark, data), 100, _SHARDS, shard)
        write_stream(windows, out, checkpoint, available_now=True).awaitTermination()

    run()
    write_pairs(routing.eos_rows(pairs, samples), data, mode="append")
    run()
    done = spark.read.schema("name string, sample string, shard int, window long").parquet(out)
    return done.groupBy("sample", "shard", "window").agg(F.count(F.lit(1)).alias("n"))


QUERIES["stream_count_windows"] = QUERIES.pop("stream_count_windows_query")
ORACLES["stream_count_windows"] = ORACLES.pop("stream_count_windows_query")


@query("""
select name, read_no, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, sample from sam""")
def stream_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live pipeline: pairs as a file stream, mapped batch by batch."""
    data, out, checkpoint = (scratch_path(spark, p) for p in ("topic", "aligned", "state"))
    write_pairs(fx.pairs(spark, sf_dir), data)
    contigs = fx.contigs(spark, sf_dir)
    align_stream(stream_pairs(spark, data), contigs, out, checkpoint, available_now=True).awaitTermination()
    return _sam_text_columns(read_records(spark, out)).drop("ref_idx", "pos_end", "tags")


# -------------------------------------------------------------------- mapping


@query("select name, sample, cast(read_no as int) as read_no, seq, qual from reads")
def explode_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.reads(spark, sf_dir)


@query("""
select name, cast(read_no as int) as read_no, ref_idx, pos, strand, nm, score, cast(mapq as int) as mapq from mapped""")
def map_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.mapped(spark, sf_dir).select("name", "read_no", "ref_idx", "pos", "strand", "nm", "score", "mapq")


@query("select seq, ref_idx, pos, strand, votes, score from best")
def best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best candidate of each distinct read."""
    seqs = fx.reads(spark, sf_dir).select("seq").distinct()
    return mapping.map_sequences(seqs, fx.contigs(spark, sf_dir)).select("seq", "ref_idx", "pos", "strand", "votes", "score")


def _mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.with_mates(fx.mapped(spark, sf_dir))


@query("""
select name, cast(read_no as int) as read_no, pos, pos_end, m_ref as mate_ref_idx, m_pos as mate_pos, m_strand as mate_strand from (
  select *, pos_end::int as pos_end from mates)""".replace("select *, pos_end::int as pos_end", "select * replace (pos_end::int as pos_end)"))
def mate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mates(spark, sf_dir).select("name", "read_no", "pos", "pos_end", "mate_ref_idx", "mate_pos", "mate_strand")


@query("select name, cast(read_no as int) as read_no, tlen from geometry")
def insert_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.with_pair_geometry(_mates(spark, sf_dir)).select("name", "read_no", "tlen")


@query("select name, cast(read_no as int) as read_no, proper::int as proper from geometry")
def proper_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.with_pair_geometry(_mates(spark, sf_dir)).select("name", "read_no", F.col("proper").cast("int").alias("proper"))


@query("select name, cast(read_no as int) as read_no, flag from sam")
def sam_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.records(spark, sf_dir).select("name", "read_no", "flag")


def _sam_text_columns(records: DataFrame) -> DataFrame:
    return records.select(
        "name", "read_no", "flag", "rname", "pos", "mapq", cigar.cigar_format(F.col("cigar")).alias("cigar"),
        "rnext", "pnext", "tlen", "seq", "qual", "sample", "ref_idx", "pos_end", tags.tags_text(F.col("tags")).alias("tags"),
    )


@query("""
select name, cast(read_no as int) as read_no, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, sample, ref_idx, pos_end,
  case when ref_idx < 0 then '' else concat('AS:i:', score, chr(9), 'NM:i:', nm) end as tags from sam""")
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sam_text_columns(fx.records(spark, sf_dir))


@query("""
select name, cast(read_no as int) as read_no, case when ref_idx < 0 then '' else
  concat('AS:i:', score, chr(9), 'NM:i:', nm, chr(9), 'RG:Z:', sample) end as tags from sam""")
def sam_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NM`` and ``AS`` with a tag of the aligner's own."""
    extra = F.create_map(F.lit("RG"), F.col("sample"))
    built = F.when(F.col("ref_idx").isNotNull(), tags.tags_text(tags.sam_tags(F.col("nm"), F.col("score"), extra)))
    return fx.mapped(spark, sf_dir).select("name", "read_no", F.coalesce(built, F.lit("")).alias("tags"))


@query("""
select name, cast(read_no as int) as read_no, case when ref_idx < 0 then '' else concat('NM:i:', nm) end as kept,
  case when ref_idx < 0 then '' else concat('AS:i:', score) end as rest from sam""")
def filter_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tags")
    return fx.records(spark, sf_dir).select(
        "name", "read_no", tags.tags_text(tags.filter_tags(t, keep=["NM", "XX"])).alias("kept"),
        tags.tags_text(tags.filter_tags(t, ignore=["NM"])).alias("rest"),
    )


# Elements derived from each line item: all nine operators occur.
_CIGAR_SQL = """
select l_orderkey, l_linenumber, l_partkey, j, cast((l_partkey * 7 + j * 3) % 50 + 1 as int) as len,
  substr('MIDNSHP=X', cast((l_suppkey + j * 4) % 9 + 1 as int), 1) as op
from lineitem, range(1, 6) r(j) where j <= l_orderkey % 5 + 1"""


def _line_cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.schema("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").parquet(f"{sf_dir}/lineitem.parquet")
    element = F.expr("""transform(sequence(1, int(l_orderkey % 5) + 1), j -> named_struct(
        'len', int((l_partkey * 7 + j * 3) % 50 + 1), 'op', substr('MIDNSHP=X', int((l_suppkey + j * 4) % 9 + 1), 1)))""")
    return items.withColumn("cigar", element)


_CIGAR_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""
with e as ({_CIGAR_SQL.replace('l_partkey, j', 'l_partkey, l_suppkey, lid, j').replace('from lineitem,', 'from (select *, row_number() over () as lid from lineitem) lineitem,')})
select {_CIGAR_KEYS}, string_agg(concat(len, op), '' order by j) as text from e group by {_CIGAR_KEYS}, lid""")
def cigar_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_cigars(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cigar.cigar_format(F.col("cigar")).alias("text")
    )


@query(f"select l_orderkey, l_linenumber, l_partkey, cast(j as int) as j, len, op from ({_CIGAR_SQL})")
def cigar_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIGAR text parsed back into its elements."""
    parsed = cigar.cigar_parse(cigar.cigar_format(F.col("cigar")))
    return _line_cigars(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.posexplode(parsed).alias("_i", "_c")
    ).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("_i") + 1).alias("j"), "_c.len", "_c.op")


@query(f"""
with e as ({_CIGAR_SQL.replace('l_partkey, j', 'l_partkey, l_suppkey, lid, j').replace('from lineitem,', 'from (select *, row_number() over () as lid from lineitem) lineitem,')})
select {_CIGAR_KEYS},
  cast(l_partkey + coalesce(sum(len) filter (op in ('M','D','N','=','X')), 0) - 1 as bigint) as pos_end,
  cast(coalesce(sum(len) filter (op in ('M','I','S','=','X')), 0) as int) as read_len
from e group by {_CIGAR_KEYS}, lid""")
def alignment_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("cigar")
    return _line_cigars(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        cigar.alignment_end(F.col("l_partkey"), c).alias("pos_end"), cigar.read_length(c).alias("read_len"),
    )


@query("""
with s as (select sample, count(*) as pairs from pairs group by sample),
h as (
  select ref_idx as ord, concat('@SQ', chr(9), 'SN:', contig, chr(9), 'LN:', length(seq), chr(9), 'M5:', md5(seq)) as line from fx_contigs
  union all select 2147483647, concat('@PG', chr(9), 'ID:basewise', chr(9), 'PN:basewise'))
select s.sample, s.pairs, cast(h.ord as int) as ord, h.line from s, h""")
def sam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines of each sample's file: one array per sample, exploded."""
    contigs = fx.contigs(spark, sf_dir).withColumn("md5", F.md5(F.upper("seq").cast("binary")))
    lines = reference.sam_header_lines(contigs).agg(F.array_sort(F.collect_list(F.struct("ord", "line"))))
    per_sample = fx.pairs(spark, sf_dir).groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"))
    return per_sample.select("sample", "pairs", F.explode(lines.scalar()).alias("_h")).select("sample", "pairs", "_h.*")


@query("""
select name, cast(read_no as int) as read_no, string_agg(chr(33 + case
    when q < 2 then q when q < 10 then 6 when q < 20 then 15 when q < 25 then 22 when q < 30 then 27
    when q < 35 then 33 when q < 40 then 37 else 40 end), '' order by i) as qual
from (select name, read_no, i, ascii(substr(qual, i::int, 1)) - 33 as q
      from (select *, unnest(range(1, length(qual) + 1)) as i from reads)) group by name, read_no""")
def bin_quals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.reads(spark, sf_dir).select("name", "read_no", decode.bin_quals(F.col("qual")).alias("qual"))


@query("select name, b1, q1, b2, q2, sample from pairs")
def drop_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels appended and taken out again."""
    samples = demux.table_of_contents(fx.sheet(spark, sf_dir))
    return routing.drop_eos(routing.with_eos(fx.pairs(spark, sf_dir), samples, 3))


@query("""
select sample, name = '' as eos, count(*) as n from (
  select sample, name from pairs union all
  select sample, '' from toc, (values (1), (2), (3)) v(p)) group by all""")
def with_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = demux.table_of_contents(fx.sheet(spark, sf_dir))
    ended = routing.with_eos(fx.pairs(spark, sf_dir), samples, 3)
    return ended.groupBy("sample", (F.length("name") <= 1).alias("eos")).agg(F.count(F.lit(1)).alias("n"))


# ----------------------------------------------------------- containers, tracks

_N, _M = 100, 10


def _by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.containers_by_count(fx.records(spark, sf_dir), _N)


def _by_coordinate(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Placed records with the columns of the order and ``more``: others would be shuffled and stored for no use."""
    records = fx.records(spark, sf_dir).select("sample", "name", "read_no", "ref_idx", "pos", *more)
    return containers.containers_by_coordinate(records, _N, _M)


@query("select sample, container_id, count(*) as records, min(name) as first_name from by_count group by all")
def containers_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_count(spark, sf_dir).groupBy("sample", "container_id").agg(
        F.count(F.lit(1)).alias("records"), F.min("name").alias("first_name")
    )


@query("select name, cast(read_no as int) as read_no, sample, container_id from by_coord")
def containers_by_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_coordinate(spark, sf_dir).select("name", "read_no", "sample", "container_id")


@query("""
select sample, container_id, cast(coalesce(min(pos) filter (ref_idx >= 0), 0) as int) as span_start,
  cast(coalesce(max(pos_end) filter (ref_idx >= 0), 0) as int) as span_end from by_coord group by all""")
def container_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_span(_by_coordinate(spark, sf_dir, "pos_end"))


@query("""
select sample, container_id, cast(case when count(distinct ref_idx) = 1 then min(ref_idx) else -2 end as int) as context,
  count(*) as records from by_coord group by all""")
def container_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_context(_by_coordinate(spark, sf_dir))


@query("""
select sample, container_id, cast(sum(length(seq)) as bigint) as bases, cast(sum(coalesce(nm, 0)) as bigint) as features,
  cast(sum(length(seq)) < 3 * sum(coalesce(nm, 0)) as int) as warn from by_count group by all""")
def container_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.container_quality(_by_count(spark, sf_dir))


@query("""
with c as (select sample, container_id, min(ref_idx) as context from by_coord group by all having count(distinct ref_idx) = 1)
select c.sample, c.container_id, cast(c.context as int) as context, md5(k.seq) as md5 from c join fx_contigs k on k.ref_idx = c.context""")
def contig_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the contig behind each single-contig container."""
    return containers.container_md5(_by_coordinate(spark, sf_dir), fx.contigs(spark, sf_dir))


@query("select name, cast(read_no as int) as read_no, container_id, rec_index from by_count")
def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_count(spark, sf_dir).select("name", "read_no", "container_id", "rec_index")


@query("""
select name, cast(read_no as int) as read_no, cast(pos - coalesce(lag(pos) over (partition by sample, container_id order by rec_index),
  min(pos) filter (ref_idx >= 0) over (partition by sample, container_id), 0) as int) as delta from by_coord""")
def alignment_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.alignment_delta(_by_coordinate(spark, sf_dir)).select("name", "read_no", "delta")


_LINKED_SQL = """
select a.name, cast(a.read_no as int) as read_no, cast(coalesce(
  (select min(b.rec_index) from by_coord b where b.sample = a.sample and b.container_id = a.container_id
     and b.name = a.name and b.rec_index > a.rec_index) - a.rec_index - 1, -1) as int) as next_gap,
  cast(exists (select 1 from by_coord b where b.sample = a.sample and b.container_id = a.container_id
     and b.name = a.name and b.rec_index < a.rec_index) as int) as has_previous
from by_coord a"""


@query(_LINKED_SQL)
def link_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.link_mates(_by_coordinate(spark, sf_dir, "flag")).select("name", "read_no", "next_gap", "has_previous")


@query("""
with two as (
  select a.sample, a.container_id, a.name from by_coord a join by_coord b
    on b.sample = a.sample and b.container_id = a.container_id and b.name = a.name
  where a.rec_index < b.rec_index and a.read_no = 1 and b.read_no = 2 and b.tlen = -a.tlen
    and a.tlen = case when a.ref_idx >= 0 and a.ref_idx = b.ref_idx then
      (greatest(a.pos_end, b.pos_end) - least(a.pos, b.pos) + 1) * (case when a.pos <= b.pos then 1 else -1 end) else 0 end)
select r.name, cast(r.read_no as int) as read_no, cast(two.name is null as int) as detached
from by_coord r left join two on two.sample = r.sample and two.container_id = r.container_id and two.name = r.name""")
def detached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.detached(_by_coordinate(spark, sf_dir, "flag", "pos_end", "tlen")).select("name", "read_no", "detached")


@query("""
with changed as (select * replace (cast(tlen + case when read_no = 2 and pos % 3 = 0 then 1 else 0 end as int) as tlen) from by_coord),
two as (
  select a.sample, a.container_id, a.name from changed a join changed b
    on b.sample = a.sample and b.container_id = a.container_id and b.name = a.name
  where a.rec_index < b.rec_index and a.read_no = 1 and b.read_no = 2 and b.tlen = -a.tlen
    and a.tlen = case when a.ref_idx >= 0 and a.ref_idx = b.ref_idx then
      (greatest(a.pos_end, b.pos_end) - least(a.pos, b.pos) + 1) * (case when a.pos <= b.pos then 1 else -1 end) else 0 end),
pair as (
  select sample, container_id, name, min(rec_index) as lo, max(rec_index) as hi from changed group by all)
select r.name, cast(r.read_no as int) as read_no, cast(two.name is null as int) as detached,
  cast(case when two.name is null or r.rec_index = hi then -1 else hi - r.rec_index - 1 end as int) as next_gap,
  cast(two.name is not null and r.rec_index > lo as int) as has_previous
from changed r join pair using (sample, container_id, name)
left join two on two.sample = r.sample and two.container_id = r.container_id and two.name = r.name""")
def mate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and detachment together, a third of the second reads with a template length that does not fit."""
    off = F.when((F.col("read_no") == 2) & (F.col("pos") % 3 == 0), 1).otherwise(0)
    rows = _by_coordinate(spark, sf_dir, "flag", "pos_end", "tlen").withColumn("tlen", (F.col("tlen") + off).cast("int"))
    return containers.mate_links(rows).select("name", "read_no", "detached", "next_gap", "has_previous")


@query("""
select sample, container_id, rec_index, cast(dense_rank() over (partition by sample, container_id order by f) as varchar) as name
from (select *, min(rec_index) over (partition by sample, container_id, name) as f from by_coord)""")
def drop_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.drop_names(_by_coordinate(spark, sf_dir)).select("sample", "container_id", "rec_index", "name")


@query("select cast(ref_idx as int) as ref_idx, cast(pos as int) as pos, count(*) as n from placed_base group by all")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.coverage(fx.records(spark, sf_dir))


@query("select cast(ref_idx as int) as ref_idx, cast(pos as int) as pos, count(*) as n from placed_base where base <> ref_base group by all")
def mismatch_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.mismatch_track(fx.records(spark, sf_dir), fx.contigs(spark, sf_dir))


@query('select sample, rn as "rank", name, cast(read_no as int) as read_no from in_order')
def coordinate_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each record in its sample's coordinate order, from its place among the sorted rows."""
    rows = ranking.coordinate_sort(materialize(fx.records(spark, sf_dir), "records"))
    placed = materialize(rows.select("sample", "name", "read_no", F.monotonically_increasing_id().alias("at")), "sorted")
    return ranking.ranked(placed, ["sample"], [F.col("at")], "rank").select("sample", "rank", "name", "read_no")


@query("""
select 'parquet' as format, count(*) as orig, count(*) as back, cast(0 as bigint) as diff from reads
union all select 'sam', count(*), count(*), 0 from reads""")
def roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written and read back in both formats: no row may differ."""
    records, contigs = materialize(fx.records(spark, sf_dir), "records"), fx.contigs(spark, sf_dir)
    parquet, text = scratch_path(spark, "parquet"), scratch_path(spark, "sam")
    write_records(records, parquet)
    write_sam_text(records, contigs, text, part_records=1000)
    columns = ["name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "sample", "tags"]

    def plain(df: DataFrame) -> DataFrame:
        # Maps cannot be grouped; sorted entries can.
        return df.select(*[c for c in columns if c != "tags"], F.array_sort(F.map_entries("tags")).alias("tags"))

    sides = {"parquet": read_records(spark, parquet), "sam": read_sam_text(spark, text)}
    return routing.roundtrip_diffs(plain(records), {name: plain(back) for name, back in sides.items()}, columns)


_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"


@query(f"""
select cast(row_number() over (order by s_suppkey) - 1 as int) as ref_idx, concat('sup', s_suppkey) as contig, seq,
  cast(length(seq) as int) as length, md5(seq) as md5
from (select s_suppkey, translate(concat(md5(cast(s_suppkey as varchar)), md5(s_name)), {_HEX}) as seq from supplier)""")
def fasta_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contig per supplier, written as FASTA with ``>`` and blanks in the titles and read back."""
    rows = spark.read.schema("s_suppkey bigint, s_name string").parquet(f"{sf_dir}/supplier.parquet")
    seq = F.expr(f"translate(concat(md5(cast(s_suppkey as string)), md5(s_name)), {_HEX})")
    title = F.concat(F.lit(">sup"), F.col("s_suppkey").cast("string"), F.lit(" from a->b >c "), "s_name")
    text = F.concat_ws("\n", title, F.lower(F.substring(seq, 1, 50)), F.substring(seq, 51, 14))
    path = scratch_path(spark, "fasta")
    rows.repartitionByRange("s_suppkey").sortWithinPartitions("s_suppkey").select(text.alias("value")).write.text(path)
    return read_fasta(spark, path)


# -------------------------------------------------------------------- flagship


@query("""
select p.lane, p.sample, count(*) as pairs, round(sum(q.s) * 1.0 / (count(*) * 72), 3)::double as mean_q
from pairs p join (select cid, sum(ascii(qual) - 33) as s from call where part > 0 group by cid) q using (cid) group by p.lane, p.sample""")
def demux_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycle blocks to samples: pairs and mean quality per lane and sample."""
    keyed = reads.decode_index(_transposed(spark, sf_dir))
    rows = demux.demux_assign(keyed, fx.sheet(spark, sf_dir))
    quals = F.concat(decode.quals(F.col("r1")), decode.quals(F.col("r2")))
    # Summed inside each row: no per-base rows.
    total = F.aggregate(F.split(quals, ""), F.lit(0), lambda s, c: s + F.ascii(c) - 33)
    per_sample = rows.select("lane", "sample", total.cast("long").alias("q"), F.length(quals).alias("n")).groupBy(
        "lane", "sample"
    ).agg(F.count(F.lit(1)).alias("pairs"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    return per_sample.select("lane", "sample", "pairs", F.round(F.col("q") / F.col("n"), 3).alias("mean_q"))


from basewise import live_queries  # noqa: E402, F401
