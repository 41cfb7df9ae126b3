"""Sentinel rows, unions and differences of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from basewise import schemas

# Fixed value: the name that ends an aligned stream.
EOS_NAME = "EOS"


def _keep_pair(name: Column) -> Column:
    return F.length(name) > 1


def drop_eos(rows: DataFrame, aligned: bool = False) -> DataFrame:
    """Rows without sentinels: pair names of one letter or none, or ``EOS`` records."""
    return rows.where(F.col("name") != EOS_NAME if aligned else _keep_pair(F.col("name")))


def with_eos(pairs: DataFrame, samples: DataFrame, partitions: int = 1) -> DataFrame:
    """``pairs`` plus sentinel pairs: ``partitions`` per listed sample, all fields empty."""
    return pairs.unionByName(eos_rows(pairs, samples, partitions))


def eos_rows(pairs: DataFrame, samples: DataFrame, partitions: int = 1) -> DataFrame:
    """The sentinel rows alone, with the columns of ``pairs``."""
    fill = [
        F.col("sample") if f.name == "sample" else F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name)
        for f in pairs.schema.fields
    ]
    return samples.select("sample", F.explode(F.sequence(F.lit(1), F.lit(partitions))).alias("_p")).select(*fill)


def eos_records(ends: DataFrame) -> DataFrame:
    """Sentinel records of (sample, part): named ``EOS``, with the number of the part that ended as ``pos``, else empty."""
    own = {"name": F.lit(EOS_NAME), "sample": F.col("sample"), "pos": F.col("part")}
    fields = StructType.fromDDL(schemas.SAM).fields
    return ends.select(*[own.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def rebalance(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt evenly over ``partitions``, whatever tile or key they came from."""
    return rows.repartition(partitions)


def merge_lanes(*runs: DataFrame) -> DataFrame:
    """Pairs of several lanes or runs as one table; a sample's rows end up together."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    return merged


def row_digest(df: DataFrame, columns: list[str]) -> Column:
    """256-bit digest of a row's values: as JSON, which tells null from empty and where a value ends; strings by their bytes."""
    plain = [F.col(c).cast("binary").alias(c) if t == "string" else F.col(c) for c, t in df.select(*columns).dtypes]
    return F.unhex(F.sha2(F.to_json(F.struct(*plain)), 256))


def roundtrip_diffs(original: DataFrame, restored: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """A row for each of ``restored``: (format, orig, back, diff), with the number of rows that only one side has.

    All sides are reduced to a count per distinct row in one aggregation, which
    moves digests of the rows and reads ``original`` once; the counts differ exactly where
    ``exceptAll`` would report rows.
    """
    def side(df: DataFrame, number: int) -> DataFrame:
        return df.select(row_digest(df, columns).alias("_row"), F.lit(number).alias("_side"))

    every = side(original, 0)
    for number, back in enumerate(restored.values(), 1):
        every = every.unionByName(side(back, number))
    counts = [f"_n{number}" for number in range(len(restored) + 1)]
    per_row = every.groupBy("_row").agg(*[F.count_if(F.col("_side") == number).alias(n) for number, n in enumerate(counts)])
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    facts = per_row.agg(F.array(*[
        F.struct(
            F.lit(name).alias("format"), total(F.col("_n0")).alias("orig"), total(F.col(n)).alias("back"),
            total(F.abs(F.col("_n0") - F.col(n))).alias("diff"),
        )
        for name, n in zip(restored, counts[1:])
    ]).alias("_facts"))
    return facts.select(F.inline("_facts"))


def roundtrip_diff(original: DataFrame, restored: DataFrame, columns: list[str]) -> DataFrame:
    """One row: (orig, back, diff), as :func:`roundtrip_diffs` has it."""
    return roundtrip_diffs(original, {"": restored}, columns).drop("format")
