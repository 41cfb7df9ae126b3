"""Near duplicates by SuperMinHash signatures, banding, verification and grouping.

Every shingle draws a random permutation of the signature's places and visits them in
turn: in step j it offers ``j + u`` (u uniform in [0, 1)) to its j-th place, and each
place keeps the least offer. All values below a whole number j are final after step j,
so a set stops as soon as no place holds more than its current step: after two or three
steps where it has more shingles than places. Signatures are cut into bands; texts that
agree in a band meet in a bucket and are compared on their full sets.

With bands of four places the chance to miss a link at the very threshold is
``(1 - least**4) ** bands``: 5e-10 for 0.85 with 29 bands, 7e-10 for 0.8 with 40, and
less for any closer pair.

In a bucket all texts are first compared with one of them (the hub, which meets most others),
and what that links is grouped. Of buckets that still hold several groups, small ones are paired; the texts
of all others go through an exact join of shingles (``jaccard.crowded``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import fitted, map_batches, numbered, text_of
from basewise.llm.jaccard import contracted, crowded, hashes, merged, no_roots, relabelled, shingles, sizes_near, tokens_of, verified
from basewise.session import materialize, scratch, scratch_path, small_side

WORDS, LEAST = 5, 0.85
#: Places of a band.
ROWS = 4
#: Shingles worked on at once, and texts of a bucket that are paired at most.
BLOCK, CROWD = 1 << 16, 16
_STEP, _FULL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFFFFFFFFFF)  # fixed values


def bands_for(least: float) -> int:
    """Bands that leave at most one link in 10^9 unfound at the threshold itself."""
    bands = 1
    while (1 - least**ROWS) ** bands > 1e-9:
        bands += 1
    return bands


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finalising rounds of the public SplitMix64 generator (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _offer(values: np.ndarray, own: np.ndarray, owner: np.ndarray) -> None:
    """Lowers ``values`` (sets x places) by the offers of shingles; ``owner`` is the set of each."""
    places = values.shape[1]
    flat = values.reshape(-1)
    order = np.tile(np.arange(places, dtype=np.uint16), (len(own), 1))
    for step in range(places):
        row = np.arange(len(own))
        drawn = _mixed(own + np.uint64((step + 1) * int(_STEP) % 2**64))
        at = step + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(places - step)) >> np.uint64(32)).astype(np.int64)
        place = order[row, at].astype(np.int64)
        order[row, at] = order[:, step]
        np.minimum.at(flat, owner * places + place, (np.uint64(step) << np.uint64(32)) | (drawn >> np.uint64(32)))
        # Later offers are at least step + 1: a set whose places all hold less is done.
        going = (values.max(axis=1) >= (np.uint64(step + 1) << np.uint64(32)))[owner]
        if not going.any():
            return
        if not going.all():
            own, owner, order = own[going], owner[going], order[going]


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """One row of ``places`` values for each set of shingle hashes; equal sets have equal rows, an empty one holds no value."""
    values = np.full((len(sets), places), _FULL)
    start = 0
    while start < len(sets):
        end, total = start, 0
        while end < len(sets) and (end == start or total + len(sets[end]) <= BLOCK):
            total += len(sets[end])
            end += 1
        own = np.concatenate(sets[start:end]) if total else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(end - start), [len(s) for s in sets[start:end]])
        for at in range(0, total, BLOCK):  # one very long set is offered in parts
            _offer(values[start:end], own[at:at + BLOCK], owner[at:at + BLOCK])
        start = end
    return values


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One signed long for each band of each signature, from its number and its values."""
    parts = values.reshape(len(values), bands, -1)
    key = np.broadcast_to(_mixed(np.arange(1, bands + 1, dtype=np.uint64) * _STEP), parts.shape[:2])
    for place in range(parts.shape[2]):
        key = _mixed((key ^ parts[:, :, place]) + _STEP)
    return key.view(np.int64)


def sketches(rows: DataFrame, words: int, bands: int) -> DataFrame:
    """``row, id, text_key, size, bands``: 128-bit key of the lower-cased words, distinct shingles, band keys."""
    schema = T.StructType([
        rows.schema["row"], rows.schema["id"], T.StructField("text_key", T.BinaryType()), T.StructField("size", T.LongType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sets, sizes = [], [], []
        for value in batch.column("text"):
            text = value.as_py()
            found = shingles(text, words)
            keys.append(xxhash.xxh3_128_digest(b" ".join(tokens_of(text))))
            sizes.append(len(found))
            sets.append(hashes(found))
        keyed = band_keys(signatures(sets, bands * ROWS), bands)
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(list(keyed), pa.list_(pa.int64()))],
            names=schema.fieldNames(),
        )

    return map_batches(rows, run, schema)


def linked(texts: DataFrame, nodes: DataFrame, words: int = WORDS, least: float = LEAST, known: DataFrame | None = None) -> DataFrame:
    """``node, root`` of all texts linked with others, among the distinct texts ``nodes`` (``row, size, bands``).

    ``texts`` holds ``row, text``. Similar texts come to lie in one component. ``known``
    are links found before, which need no second comparison.
    """
    roots = no_roots(texts.sparkSession)
    roots = roots if known is None else merged(roots, known)
    each = nodes.select(F.explode("bands").alias("bucket"), F.col("row").alias("node"), "size")
    # Bucket keys alone are counted first: most hold one text and travel no further.
    met = each.select("bucket").groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    shared = materialize(each.join(met, "bucket"), "shared-buckets")
    roots, compared, left, rows = contracted(shared, texts, words, least, roots)
    few = left.filter(F.col("texts") <= CROWD)
    a, b = few.alias("a"), few.alias("b")
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label"))
    pairs = a.join(b, meet & sizes_near(F.col("a.size"), F.col("b.size"), least))
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct().join(done, ["a", "b"], "left_anti")
    pairs = materialize(fitted(pairs, CROWD * rows), "pairs")
    roots = merged(roots, materialize(verified(pairs, texts, words, least), "links"))
    crowd = materialize(fitted(left.filter(F.col("texts") > CROWD).select(F.col("node").alias("row")).distinct(), rows), "crowd")
    if crowd.isEmpty():
        return roots
    theirs = materialize(texts.select("row", "text").join(small_side(crowd), "row", "left_semi"), "crowd-texts")
    return crowded(theirs, roots, words, least)


def near_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, words: int = WORDS,
    least: float = LEAST, empty_linked: bool = False, before: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """For each row ``row, id, size, component_id, keep_row``.

    Texts are linked if the Jaccard similarity of their sets of ``words``-word shingles is
    ``least`` (whole per cents) or more; ``size`` is that of the set. ``component_id`` is
    the smallest id reachable over links (null ids last), ``keep_row`` the row that holds
    it (of several, the first read). Texts equal but for ASCII case and white space are
    linked. Null text counts as empty; texts without words have size 0 and are linked with
    nothing, or with each other if ``empty_linked``. Repeated rows are rows of their own,
    linked as equal texts are. An empty table gives no rows; other columns are never read.
    ``row_col`` may name a stored column of unique numbers to serve as ``row``. ``before``
    may find some links ``a, b`` of the texts ``row, text`` among the given ``row`` by another method first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "near-groups")
    with scratch(spark):
        rows = numbered(df, row_col, id=F.col(f"`{id_col}`"), text=text_of(text_col))
        if not row_col:
            rows = materialize(rows, "near-rows")
        drawn = materialize(sketches(rows, words, bands_for(least)), "sketches")
        # One row a text: copies are never paired. Texts without words are their own group, or one.
        alone = F.when((F.col("size") == 0) & F.lit(not empty_linked), F.col("row")).otherwise(F.lit(-1))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
        one = F.min(F.struct("row", "size", "bands")).alias("one")
        heads = materialize(drawn.groupBy("text_key", alone.alias("alone")).agg(first, one).withColumn("node", F.col("one.row")), "heads")
        nodes = heads.select("one.*").filter("size > 0")
        known = materialize(before(rows, nodes.select("row")), "known") if before else None
        roots = linked(rows, nodes, words, least, known)
        heads = heads.select("text_key", "alone", "first", "node")
        named = materialize(relabelled(heads, roots), "named-heads")
        best = materialize(named.groupBy("label").agg(F.min("first").alias("best")).join(named, "label").select("text_key", "alone", "best"), "best")
        placed = drawn.select("row", "id", "size", "text_key", alone.alias("alone")).join(best, ["text_key", "alone"])
        out = placed.select("row", "id", "size", F.col("best.id").alias("component_id"), F.col("best.row").alias("keep_row"))
        out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
