"""Word shingles, exact verification of pairs on whole texts, and an exact join for crowds.

``verified`` moves only the texts of its pairs, each once for every partner it leads.
``crowded`` finds every similar pair among texts too many for pairing bucket by
bucket: shingles are put in one order, rare ones first by exact counts; two similar
texts share one of the first few of each (prefix filter), far enough to the front that
the rest can still suffice (position filter), and their sizes are alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import components, fitted, map_batches, slices
from basewise.session import materialize, small_side

WORDS, LEAST = 5, 0.8
#: Partners that one copy of a leading text serves.
LED = 512


def tokens_of(text: str) -> list[bytes]:
    """A-Z are lower-cased; words are runs without ASCII white space."""
    return text.encode().lower().split()


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    """A text with fewer words is one shingle, one without words has none."""
    tokens = tokens_of(text)
    if not tokens:
        return set()
    joined, ends, at = b" ".join(tokens), [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    if len(tokens) <= words:
        return {joined}
    starts = [0, *[e + 1 for e in ends[:len(tokens) - words]]]
    return {joined[a:b] for a, b in zip(starts, ends[words - 1:])}


def percent(least: float) -> int:
    """Thresholds are whole per cents, so that comparisons are exact in integers."""
    return round(100 * least)


def similar(a: set[bytes], b: set[bytes], least: float = LEAST) -> bool:
    both = len(a & b)
    return 100 * both >= percent(least) * (len(a) + len(b) - both)


def sizes_near(x: Column, y: Column, least: float) -> Column:
    """Sets whose sizes differ more cannot be similar enough."""
    return F.lit(100) * F.least(x, y) >= F.lit(percent(least)) * F.greatest(x, y)


def hashes(found: set[bytes]) -> np.ndarray:
    """XXH64 of shingles, unsigned."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s) for s in found], dtype=np.uint64)


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """Those of the distinct pairs ``a, b`` whose texts (``row, text``) are similar on their full sets.

    Texts outside the pairs do not move. A text ``a`` leads its partners: it moves once
    for every ``LED`` of them, so one that leads a third of all texts is many tasks.
    """
    led = pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    followers = pairs.join(led, "a").select(F.col("b").alias("node"), F.col("a").alias("lead"), part.alias("part"), F.col("b").alias("other"))
    leaders = led.select(F.col("a").alias("node"), F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    count = pairs.count()
    moves = materialize(fitted(followers.unionByName(leaders.withColumn("other", F.lit(None).cast("long"))), count), "moves")
    wanted = moves.select(F.col("node").alias("row")).distinct()
    found = texts.select("row", "text").join(small_side(wanted), "row", "left_semi")
    rows = moves.join(found, moves["node"] == found["row"]).select("lead", "part", "other", "text")
    # Nulls sort first, so a leader precedes those it leads.
    tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // LED)))
    rows = rows.repartition(tasks, "lead", "part").sortWithinPartitions("lead", "part", "other")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: set[bytes] = set()
        for batch in slices(batches):
            a, b = [], []
            for lead, other, text in zip(batch.column("lead").to_pylist(), batch.column("other").to_pylist(), batch.column("text")):
                if other is None:
                    own = shingles(text.as_py(), words)
                elif similar(own, shingles(text.as_py(), words), least):
                    a.append(lead)
                    b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, schema)


def hub_pairs(buckets: DataFrame, least: float, near: Column | None = None, led: DataFrame | None = None) -> DataFrame:
    """``a, b``: the one text of each bucket (``bucket, node, size, label, texts`` and more) that others of it are compared with.

    It is the one that meets the most rows of other labels in all its buckets, and is not among ``led``, the hubs of
    earlier turns: the middle of a group of near copies is linked with all around it, which may not be linked with each
    other. The order of nodes is one for all buckets of a turn, so that a group meets few different hubs.
    """
    same = buckets.groupBy("bucket", "label").agg(F.count("*").alias("same"))
    ranked = buckets.join(same, ["bucket", "label"]).groupBy("node").agg(F.sum(F.col("same") - F.col("texts")).alias("others"))
    ranked = ranked if led is None else ranked.join(led, "node", "left_anti")
    order = F.struct("others", F.xxhash64("node").alias("h"), F.struct(*buckets.columns).alias("is"))
    hubs = buckets.join(ranked, "node").groupBy("bucket").agg(F.min(order)["is"].alias("hub"))
    met = buckets.join(hubs, "bucket").filter(F.col("label") != F.col("hub.label")).filter(sizes_near(F.col("size"), F.col("hub.size"), least))
    met = met.filter(near) if near is not None else met
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` with more links ``a, b``: they join whole components, so each link is looked at once."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("x")), roots.select(F.col("node").alias("b"), F.col("root").alias("y"))
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    moved = components(between.filter("a <> b").distinct())
    rows, more = roots.count(), moved.count()
    if not more:
        return roots
    new = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = roots.join(new, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(fitted(kept.union(moved.join(roots, "node", "left_anti").select("node", "root")), rows + more), "roots")


def no_roots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "node long, root long")


def contracted(
    buckets: DataFrame, texts: DataFrame, words: int, least: float, roots: DataFrame, near: Column | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Components found by comparing all texts of each bucket with one of them, in turns, each with other hubs.

    Gives ``roots`` with what was linked, the pairs compared, the rows of ``buckets``
    that still hold several labels (with ``label`` and ``texts``), and how many those are.
    A turn costs as many comparisons as there are rows; there is another one as long as
    the last closed a third of the rows.
    """
    left = materialize(open_buckets(relabelled(buckets, roots)), "labelled")
    rows, compared = left.count(), None
    while True:
        led = None if compared is None else compared.select(F.col("a").alias("node")).distinct()
        pairs = materialize(fitted(hub_pairs(left, least, near, led), rows), "hub-pairs")
        found = materialize(verified(pairs, texts, words, least), "hub-links")
        roots = merged(roots, found)
        compared = pairs if compared is None else compared.union(pairs)
        left = materialize(fitted(open_buckets(relabelled(left.select(*buckets.columns), roots)), rows), "open-buckets")
        before, rows = rows, left.count()
        if 3 * rows > 2 * before or not rows:
            return roots, compared, left, rows


def relabelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with ``label``: the component that their ``node`` is in so far."""
    return rows.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")


def open_buckets(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that still hold several labels, with ``texts``, the number of rows."""
    left = rows.groupBy("bucket").agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high"))
    return rows.join(left.filter("low <> high").select("bucket", "texts"), "bucket")


def _prefixes(texts: DataFrame, words: int, least: float) -> DataFrame:
    """``bucket, node, size, place``: the shared shingles among the first of each text, rare ones first, with their places."""
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens = [np.unique(hashes(shingles(t.as_py(), words))).view(np.int64) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(tokens, pa.list_(pa.int64()))], names=["node", "tokens"])

    sets = materialize(map_batches(texts.select("row", "text"), run, schema), "crowd-sets")
    each = sets.select("node", F.size("tokens").alias("size"), F.explode("tokens").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    shared = each.join(counts, "bucket")
    own = Window.partitionBy("node")  # one text
    place = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("n", "bucket")) - 1
    # A similar set shares at least this many, so one of them is among the first ``size - need + 1``.
    need = F.ceil(F.col("size") * F.lit(percent(least)) / 100 - 1e-9)
    return shared.withColumn("place", place).filter(F.col("place") <= F.col("size") - need).select("bucket", "node", "size", "place")


def _reach(size: str, place: str, size2: str, place2: str, least: float) -> Column:
    """Whether sets that meet first at these places can still share enough."""
    rest = F.least(F.col(size) - F.col(place), F.col(size2) - F.col(place2))
    return rest * (100 + percent(least)) >= F.lit(percent(least)) * (F.col(size) + F.col(size2))


def crowded(texts: DataFrame, roots: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """``roots`` with every similar pair of the distinct ``texts`` (``row, text``) in one component."""
    prefixes = materialize(_prefixes(texts, words, least), "crowd-prefixes")
    near = _reach("size", "place", "hub.size", "hub.place", least)
    roots, _, left, rows = contracted(prefixes, texts, words, least, roots, near)
    # Similar sizes lie in one band or in neighbouring ones.
    left = left.withColumn("band", F.floor(F.log("size") / math.log(100 / percent(least))))
    # A pair is made at the first shingle that its prefixes share, and at no other.
    own = left.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "bucket"))).alias("own")).select("node", F.col("own.bucket").alias("own"))
    left = materialize(fitted(left.join(own, "node"), rows), "crowd-open")
    # The smaller set of a pair is ``a``; what it shares with one of at least its size begins nearer to its front.
    front = left.filter(_reach("size", "place", "size", "place", least))
    a = front.select("*", F.explode(F.array("band", F.col("band") + 1)).alias("met")).alias("a")
    b = left.alias("b")
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.met") == F.col("b.band")) & (F.col("a.label") != F.col("b.label"))
    meet &= F.struct("a.size", "a.node") < F.struct("b.size", "b.node")
    meet &= sizes_near(F.col("a.size"), F.col("b.size"), least) & _reach("a.size", "a.place", "b.size", "b.place", least)
    meet &= F.array_intersect("a.own", "b.own")[0] == F.col("a.bucket")
    pairs = materialize(a.join(b, meet).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")), "crowd-pairs")
    return merged(roots, materialize(verified(pairs, texts, words, least), "crowd-links"))
