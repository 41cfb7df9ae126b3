"""Containers of aligned records: assignment and per-container fields.

Numbering goes through :func:`ranked`, so no sample is sorted in one task. All later
windows are over one container, which holds a bounded number of records.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from basewise.operators.ranking import coordinate_keys, ranked, ranked_with_counts
from basewise.operators.reference import contig_md5
from basewise.session import materialize, small_side

# Fixed values of the container rule.
RECORDS_PER_CONTAINER = 10_000
MIN_SINGLE_REFERENCE_RECORDS = 1_000
UNMAPPED_CONTEXT, MULTIPLE_CONTEXT = -1, -2

_KEY = ("sample", "container_id")


def containers_by_count(records: DataFrame, n: int = RECORDS_PER_CONTAINER) -> DataFrame:
    """Adds ``container_id`` (per sample) and ``rec_index`` (1-based inside it).

    Records are taken by (name, read number), a container closing after ``n``.
    """
    numbered = ranked(records, ["sample"], [F.col("name"), F.col("read_no")], "_rn")
    return numbered.select(
        *records.columns,
        F.expr(f"(_rn - 1) div {int(n)}").alias("container_id"),
        ((F.col("_rn") - 1) % n + 1).cast("int").alias("rec_index"),
    )


_RUN_SCHEMA = "sample string, ref_idx int, start long, lead long, lead_id long, next_id long, lead_from long"


def _split_runs(n: int, m: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The sequential container rule over (contig, record count) rows of one sample.

    Each run gives up to ``lead`` records to the open container and then fills
    containers of its own, ``n`` records each.
    """

    def split(runs: pd.DataFrame) -> pd.DataFrame:
        out, start, size, context, current = [], 1, 0, None, -1
        # Contigs in record order; unmapped (-1) last.
        for ref, count in sorted(zip(runs["ref_idx"].tolist(), runs["n"].tolist()), key=lambda r: (r[0] < 0, r[0])):
            joins_open = (
                0 < size < n
                and (context == UNMAPPED_CONTEXT or ref != UNMAPPED_CONTEXT)
                and (context == MULTIPLE_CONTEXT or size <= m)
            )
            lead = min(count, n - size) if joins_open else 0
            out.append((runs["sample"].iat[0], ref, start, lead, current, current + 1, size))
            if lead:
                size, context = size + lead, MULTIPLE_CONTEXT
            rest = count - lead
            if rest:
                current, context, size = current + -(-rest // n), ref, (rest - 1) % n + 1
            start += count
        return pd.DataFrame(out, columns=["sample", "ref_idx", "start", "lead", "lead_id", "next_id", "lead_from"])

    return split


def containers_by_coordinate(
    records: DataFrame, n: int = RECORDS_PER_CONTAINER, m: int = MIN_SINGLE_REFERENCE_RECORDS
) -> DataFrame:
    """Adds ``container_id`` and ``rec_index`` in coordinate order.

    A new container starts at ``n`` records, when the contig changes after more than
    ``m`` records, and where unmapped records begin; below that the container becomes
    multi-contig. The rule is sequential but needs only the record count of each
    contig, so it runs over one row per (sample, contig), never over records.
    """
    numbered, counts = ranked_with_counts(records, ["sample"], coordinate_keys(), "_rn", ["ref_idx"])
    runs = counts.withColumnRenamed("_n", "n")
    placed = materialize(runs.groupBy("sample").applyInPandas(_split_runs(n, m), _RUN_SCHEMA), "container-runs")
    j = F.col("_rn") - F.col("start")
    in_lead = j < F.col("lead")
    after = j - F.col("lead")
    return numbered.join(small_side(placed), ["sample", "ref_idx"]).select(
        *[F.col(c) for c in records.columns],
        F.when(in_lead, F.col("lead_id")).otherwise(F.col("next_id") + F.floor(after / n)).cast("long").alias("container_id"),
        F.when(in_lead, F.col("lead_from") + j + 1).otherwise(after % n + 1).cast("int").alias("rec_index"),
    )


def _mapped() -> Column:
    return F.col("ref_idx") >= 0


def container_span(records: DataFrame) -> DataFrame:
    """First and last reference position of the mapped records, 0 if there are none."""
    return records.groupBy(*_KEY).agg(
        F.coalesce(F.min(F.when(_mapped(), F.col("pos"))), F.lit(0)).alias("span_start"),
        F.coalesce(F.max(F.when(_mapped(), F.col("pos_end"))), F.lit(0)).alias("span_end"),
    )


def container_context(records: DataFrame) -> DataFrame:
    """Contig of the container: its index, -1 if all unmapped, -2 if several.

    Minimum and maximum tell whether there is one value; no distinct is needed.
    """
    lo, hi = F.min("ref_idx"), F.max("ref_idx")
    return records.groupBy(*_KEY).agg(
        F.when(lo == hi, lo).otherwise(MULTIPLE_CONTEXT).alias("context"), F.count(F.lit(1)).alias("records")
    )


def container_quality(records: DataFrame) -> DataFrame:
    """Bases against differences; ``warn`` where there are under 3 bases per difference."""
    nm = F.coalesce(F.try_element_at("tags", F.lit("NM")).cast("int"), F.lit(0))
    sums = records.groupBy(*_KEY).agg(
        F.sum(F.length("seq")).alias("bases"), F.sum(nm).alias("features")
    )
    return sums.withColumn("warn", (F.col("bases") < 3 * F.col("features")).cast("int"))


def container_md5(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Digest of the contig of each single-contig container."""
    return container_context(records).join(
        small_side(contig_md5(contigs).select(F.col("ref_idx").alias("context"), "md5")), "context"
    ).select(*_KEY, "context", "md5")


def alignment_delta(records: DataFrame) -> DataFrame:
    """Adds ``delta``: start minus the previous record's, the first against the span start."""
    here = W.partitionBy(*_KEY)
    span_start = F.coalesce(F.min(F.when(_mapped(), F.col("pos"))).over(here), F.lit(0))
    before = F.lag("pos").over(here.orderBy("rec_index"))
    return records.withColumn("delta", (F.col("pos") - F.coalesce(before, span_start)).cast("int"))


def _fragment() -> WindowSpec:
    return W.partitionBy(*_KEY, "name", (F.col("flag").bitwiseAND(F.lit(0x100)) != 0))


def link_mates(records: DataFrame) -> DataFrame:
    """Adds ``next_gap`` (records up to the next of the same fragment, -1 if last) and ``has_previous``."""
    order = _fragment().orderBy("rec_index")
    gap = F.lead("rec_index").over(order) - F.col("rec_index") - 1
    return records.withColumn("next_gap", F.coalesce(gap, F.lit(-1)).cast("int")).withColumn(
        "has_previous", F.lag("rec_index").over(order).isNotNull().cast("int")
    )


def detached(records: DataFrame, coordinate_order: bool = True) -> DataFrame:
    """Adds ``detached``: 0 if the fragment's records can be restored from one another.

    That needs two records or more in the container, the first being read 1 and the
    last read 2, a first template length equal to the computed one and its negative
    in every later record. Out of coordinate order every record is detached.
    """
    if not coordinate_order:
        return records.withColumn("detached", F.lit(1))
    whole = _fragment().orderBy("rec_index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    part = F.struct("read_no", "ref_idx", "pos", "pos_end", "tlen")
    first, last = F.first(part).over(whole), F.last(part).over(whole)
    follower = F.col("tlen") == -F.col("_f.tlen")
    is_first = F.col("rec_index") == F.min("rec_index").over(whole)
    size = F.greatest(F.col("_f.pos_end"), F.col("_l.pos_end")) - F.least(F.col("_f.pos"), F.col("_l.pos")) + 1
    computed = F.when(
        (F.col("_f.ref_idx") >= 0) & (F.col("_f.ref_idx") == F.col("_l.ref_idx")),
        F.when(F.col("_f.pos") <= F.col("_l.pos"), size).otherwise(-size),
    ).otherwise(0)
    linked = records.select("*", first.alias("_f"), last.alias("_l"), F.count(F.lit(1)).over(whole).alias("_n"), is_first.alias("_is_first"))
    followers_ok = F.min(F.when(~F.col("_is_first"), follower)).over(whole)
    ok = (
        (F.col("_n") > 1)
        & (F.col("_f.read_no") == 1)
        & (F.col("_l.read_no") == 2)
        & (F.col("_f.tlen") == computed)
        & F.coalesce(followers_ok, F.lit(False))
    )
    return linked.withColumn("detached", F.when(ok, 0).otherwise(1)).drop("_f", "_l", "_n", "_is_first")


def mate_links(records: DataFrame, coordinate_order: bool = True) -> DataFrame:
    """Adds ``next_gap``, ``has_previous`` and ``detached``; a detached record has no links (-1 and 0)."""
    alone = F.col("detached") == 1
    return detached(link_mates(records), coordinate_order).withColumn(
        "next_gap", F.when(alone, F.lit(-1)).otherwise(F.col("next_gap"))
    ).withColumn("has_previous", F.when(alone, F.lit(0)).otherwise(F.col("has_previous")))


def drop_names(records: DataFrame) -> DataFrame:
    """Read names replaced by the number of the fragment in its container, by first record."""
    first = F.min("rec_index").over(W.partitionBy(*_KEY, "name"))
    number = F.dense_rank().over(W.partitionBy(*_KEY).orderBy("_first"))
    return records.withColumn("_first", first).withColumn("name", number.cast("string")).drop("_first")
