"""Sample assignment by tolerant barcode matching."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basewise.functions.barcodes import hamming
from basewise.session import BROADCAST_ROWS, materialize, small_side

UNDETERMINED = "Undetermined"

# Stands for every letter that no sheet barcode holds; such letters differ from all of them alike.
_OTHER = "*"


def _alphabet(sheet: DataFrame) -> str:
    """Letters of the sheet's barcodes, and one more that is in none of them."""
    rows = sheet.select(F.explode(F.split("idx", "")).alias("c")).where("c <> ''").distinct().collect()
    letters = sorted(r["c"] for r in rows)
    other = _OTHER if _OTHER not in letters else next(c for c in map(chr, range(33, 0xD800)) if c not in letters)
    return "".join(letters) + other


def _canonical(idx: Column, letters: str) -> Column:
    """``idx`` with each letter that no sheet barcode holds as the last of ``letters``; no distance changes."""
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in letters)
    return F.regexp_replace(idx, f"(?s)[^{kept}]", "\\" + letters[-1])


def _best(candidates: DataFrame) -> DataFrame:
    """Per observed barcode the smallest (distance, barcode), and how many share that distance."""
    per_distance = candidates.groupBy("lane", "idx", "distance").agg(
        F.min("_sheet_idx").alias("best_idx"), F.count(F.lit(1)).cast("int").alias("ties")
    )
    first = F.min(F.struct("distance", "best_idx", "ties"))
    return per_distance.groupBy("lane", "idx").agg(first.alias("_m")).select(
        "lane", "idx", "_m.best_idx", "_m.distance", "_m.ties"
    )


def neighbourhood_size(length: int, mismatches: int, letters: int = 5) -> int:
    """Strings over so many letters within reach of one sheet barcode or a prefix of it."""
    others = letters - 1
    return sum(
        comb(n, d) * others**d for n in range(length + 1) for d in range(min(n, mismatches) + 1)
    )


def _neighbours(sheet: DataFrame, mismatches: int, alphabet: str) -> DataFrame:
    """(lane, idx, _sheet_idx): every string within ``mismatches`` of each sheet barcode.

    Prefixes count as well, since a shorter barcode is compared on its own length.
    """
    grown = sheet.select("lane", F.col("idx").alias("_sheet_idx")).distinct().select(
        "*",
        F.explode(F.sequence(F.lit(0), F.length("_sheet_idx"))).alias("_len"),
    ).select("lane", "_sheet_idx", F.left(F.col("_sheet_idx"), F.col("_len")).alias("idx"))
    for _ in range(mismatches):
        # Position 0 stands for "leave as is".
        spots = F.explode(F.sequence(F.lit(0), F.length("idx")))
        letters = F.when(F.col("_at") == 0, F.array(F.lit(""))).otherwise(F.array(*map(F.lit, alphabet)))
        changed = F.when(F.col("_at") == 0, F.col("idx")).otherwise(
            F.expr("concat(substring(idx, 1, _at - 1), _letter, substring(idx, _at + 1))")
        )
        grown = (
            grown.select("*", spots.alias("_at"))
            .select("*", F.explode(letters).alias("_letter"))
            .select("lane", "_sheet_idx", changed.alias("idx"))
            .distinct()
        )
    return grown


def barcode_table(sheet: DataFrame, mismatches: int = 1, alphabet: str | None = None) -> DataFrame:
    """Every barcode that can match, in canonical letters, with its best sheet entry.

    Made from the sheet alone; its size is sheet rows x ``neighbourhood_size``.
    """
    near = _neighbours(sheet, mismatches, alphabet or _alphabet(sheet))
    return _best(near.withColumn("distance", hamming(F.col("idx"), F.col("_sheet_idx"))))


def _pieces(text: Column, length: Column, parts: int) -> Column:
    """``text`` cut at ``length * j / parts`` for j = 0 .. parts."""

    def piece(j: Column) -> Column:
        lo = F.floor(length * j / parts).cast("int")
        hi = F.floor(length * (j + 1) / parts).cast("int")
        return F.substring(text, lo + 1, hi - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), piece)


def match_distinct(observed: DataFrame, sheet: DataFrame, mismatches: int = 1) -> DataFrame:
    """Best sheet entry of distinct (lane, idx) rows, for wide neighbourhoods.

    Two strings within m mismatches agree on at least one of m + 1 pieces, so the
    candidates come from an equality join on (lane, length, piece), not from
    comparing every barcode with every sheet row. A pair that agrees on several
    pieces is kept at the first one only.
    """
    parts = mismatches + 1
    o = observed.select("lane", "idx", F.length("idx").alias("_len")).withColumn("_ps", _pieces(F.col("idx"), F.col("_len"), parts))
    s = (
        sheet.select("lane", F.col("idx").alias("_sheet_idx")).distinct()
        .select("*", F.explode(F.sequence(F.lit(0), F.length("_sheet_idx"))).alias("_len"))
        .withColumn("_sheet_ps", _pieces(F.col("_sheet_idx"), F.col("_len"), parts))
        .select("*", F.posexplode("_sheet_ps").alias("_piece_no", "_piece"))
    )
    o = o.select("*", F.posexplode("_ps").alias("_piece_no", "_piece"))
    same = F.zip_with("_ps", "_sheet_ps", lambda a, b: a == b)
    candidates = (
        o.join(small_side(s), ["lane", "_len", "_piece_no", "_piece"])
        .where(F.array_position(same, F.lit(True)) == F.col("_piece_no") + 1)
        .withColumn("distance", hamming(F.col("idx"), F.col("_sheet_idx")))
        .where(F.col("distance") <= mismatches)
    )
    return _best(candidates)


def _sheet_bound(sheet: DataFrame, mismatches: int, letters: int) -> int:
    """Upper bound of the barcode table's rows, from two numbers of the sheet."""
    row = sheet.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("idx")).alias("len")).first()
    return row["n"] * neighbourhood_size(row["len"] or 0, mismatches, letters)


def demux_match(observed: DataFrame, sheet: DataFrame, mismatches: int = 1) -> DataFrame:
    """(lane, idx, best_idx, distance, ties) for each distinct observed barcode.

    Unmatched barcodes show NULL, distance -1 and 0 ties. The smallest (distance,
    barcode) wins; ``ties`` above 1 tells that other entries are as near.
    """
    distinct = observed.select("lane", "idx").distinct()
    alphabet = _alphabet(sheet)
    if _sheet_bound(sheet, mismatches, len(alphabet)) <= BROADCAST_ROWS:
        table = F.broadcast(barcode_table(sheet, mismatches, alphabet).withColumnRenamed("idx", "_key"))
        joined = distinct.withColumn("_key", _canonical(F.col("idx"), alphabet)).join(table, ["lane", "_key"], "left")
    else:
        joined = distinct.join(match_distinct(distinct, sheet, mismatches), ["lane", "idx"], "left")
    return joined.select(
        "lane", "idx", "best_idx",
        F.coalesce("distance", F.lit(-1)).alias("distance"),
        F.coalesce("ties", F.lit(0)).alias("ties"),
    )


def demux_assign(
    clusters: DataFrame, sheet: DataFrame, mismatches: int = 1, undet: str = UNDETERMINED
) -> DataFrame:
    """``clusters`` (with lane, idx) plus ``sample``.

    With the usual one or two mismatches the table of all matching barcodes is made
    from the sheet and broadcast under a proven row bound, so the clusters are
    neither shuffled nor read twice. Beyond the bound the distinct barcodes are
    matched first. That table holds at most the distinct *matching* barcodes; it is
    broadcast only if counted small.
    """
    alphabet = _alphabet(sheet)
    bounded = _sheet_bound(sheet, mismatches, len(alphabet)) <= BROADCAST_ROWS
    if bounded:
        matches, key = barcode_table(sheet, mismatches, alphabet), _canonical(F.col("idx"), alphabet)
    else:
        # Stored before it is counted, so that it is made once.
        matches, key = materialize(match_distinct(clusters.select("lane", "idx").distinct(), sheet, mismatches), "matches"), F.col("idx")
    # One sample per barcode, so that no cluster can match twice.
    names = sheet.groupBy("lane", F.col("idx").alias("best_idx")).agg(F.min("sample").alias("sample"))
    table = matches.join(F.broadcast(names) if bounded else small_side(names), ["lane", "best_idx"]).select(
        "lane", F.col("idx").alias("_key"), "sample"
    )
    table = F.broadcast(table) if bounded else small_side(table)
    return clusters.withColumn("_key", key).join(table, ["lane", "_key"], "left").select(
        *[F.col(c) for c in clusters.columns], F.coalesce("sample", F.lit(undet)).alias("sample")
    )


def table_of_contents(sheet: DataFrame, key: int = 0, undet: str = UNDETERMINED) -> DataFrame:
    """(key, id, sample): dense ids by name; the fallback sample is always listed.

    One row per sample of the sheet, so its single-partition window is small.
    """
    names = sheet.select("sample").unionByName(sheet.sparkSession.createDataFrame([(undet,)], "sample string")).distinct()
    return names.select(
        F.lit(key).alias("key"), (F.expr("dense_rank() over (order by sample)") - 1).cast("int").alias("id"), "sample"
    )


def toc_lines(toc: DataFrame) -> DataFrame:
    """Contents as control messages: (key, value), one ``id sample`` line per output."""
    line = F.concat(F.col("id").cast("string"), F.lit(" "), F.col("sample"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda s: s["line"])
    return toc.groupBy("key").agg(F.array_join(lines, "\n").alias("value"))


def parse_toc(messages: DataFrame, key: int | None = None) -> DataFrame:
    """Control messages (key, value) back to (key, id, sample), for one key or all."""
    wanted = messages if key is None else messages.where(F.col("key") == key)
    parts = F.split("line", " ", 2)
    return wanted.select("key", F.explode(F.split("value", "\n")).alias("line")).select(
        "key", parts[0].cast("int").alias("id"), parts[1].alias("sample")
    )


def sample_counts(pairs: DataFrame, toc: DataFrame) -> DataFrame:
    """Pairs per listed sample, zeros kept: the completeness check after a write."""
    counts = pairs.groupBy("sample").agg(F.count(F.lit(1)).alias("pairs"))
    return toc.select("id", "sample").join(counts, "sample", "left").select(
        "id", "sample", F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs")
    )
