"""Sample sheet (sectioned CSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, path: str, all_indexes: bool = False) -> DataFrame:
    """(line_no, lane, sample, idx) of every non-blank line of the data section."""
    lines = F.transform(F.split("value", "\r?\n"), lambda line: F.trim(line))
    data_at = F.array_position("_lines", F.lit("[Data]"))
    no_data = F.raise_error(F.lit("the sample sheet has no [Data] section")).cast("bigint")
    after = F.slice("_lines", (F.col("_at") + 1).cast("int"), F.size("_lines"))
    section_at = F.array_position(F.transform("_after", lambda line: line.startswith("[")), F.lit(True))
    # Up to the next section or the end, without the header line.
    stop = F.when(section_at > 0, section_at - 1).otherwise(F.size("_after"))
    body = F.slice("_after", F.lit(2), F.greatest(stop - 1, F.lit(0)).cast("int"))
    field = F.split("_line", ",")
    # The second barcode's column goes by its name in the header; a sheet may have none.
    named = F.transform(F.split(F.get("_after", F.lit(0)), ","), lambda c: F.lower(F.trim(c)))
    second = F.coalesce(F.get(field, (F.array_position(named, F.lit("index2")) - 1).cast("int")), F.lit(""))
    idx = F.concat(field[6], F.when(F.col("_second"), F.trim(second)).otherwise("")) if all_indexes else field[6]
    return (
        spark.read.text(path, wholetext=True)
        .select(lines.alias("_lines"))
        .select("_lines", F.when(data_at > 0, data_at).otherwise(no_data).alias("_at"))
        .select(after.alias("_after"))
        .select("_after", F.array_contains(named, "index2").alias("_second"), F.posexplode(body).alias("line_no", "_line"))
        .where(F.col("_line") != "")
        .select("line_no", field[0].cast("int").alias("lane"), field[1].alias("sample"), idx.alias("idx"))
    )


def read_sheet(spark: SparkSession, path: str, all_indexes: bool = False) -> DataFrame:
    """(lane, sample, idx); of a repeated (lane, idx) the last line counts.

    With ``all_indexes`` the barcode in the column ``index2``, if there is one, follows the first.
    """
    return _rows(spark, path, all_indexes).groupBy("lane", "idx").agg(F.max_by("sample", "line_no").alias("sample")).select("lane", "sample", "idx")


def sheet_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """(lane, idx, n) of barcodes listed more than once."""
    return _rows(spark, path).groupBy("lane", "idx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
