"""CIGAR values: ``array<struct<len: int, op: string>>`` and their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operators of the format and what they consume.
OPERATORS = "MIDNSHP=X"
REF_OPS = "MDN=X"
READ_OPS = "MIS=X"
# The seven operators an aligner may hand over.
ALIGNER_OPS = "MIDSHNP"

CIGAR_TYPE = "array<struct<len: int, op: string>>"


def cigar_format(cigar: Column, allowed: str = OPERATORS) -> Column:
    """Text form; an operator outside ``allowed`` fails the query."""
    return F.array_join(
        F.transform(
            cigar,
            lambda c: F.when(
                F.instr(F.lit(allowed), c["op"]) > 0, F.concat(c["len"].cast("string"), c["op"])
            ).otherwise(F.raise_error(F.concat(F.lit("unknown CIGAR operator: "), c["op"])).cast("string")),
        ),
        "",
    )


def cigar_parse(text: Column) -> Column:
    """Array form; ``*`` and the empty text give an empty array."""
    whole = F.lit(f"^([0-9]+[{OPERATORS}])*$")
    parts = F.regexp_extract_all(text, F.lit(f"[0-9]+[{OPERATORS}]"), 0)
    return F.when(text.isin("*", ""), F.array().cast(CIGAR_TYPE)).when(
        F.rlike(text, whole),
        F.transform(
            parts,
            lambda p: F.struct(
                F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")
            ),
        ),
    ).otherwise(F.raise_error(F.concat(F.lit("malformed CIGAR: "), text)).cast(CIGAR_TYPE))


def _consumed(cigar: Column, ops: str) -> Column:
    return F.aggregate(
        F.filter(cigar, lambda c: F.instr(F.lit(ops), c["op"]) > 0), F.lit(0), lambda s, c: s + c["len"]
    )


def reference_length(cigar: Column) -> Column:
    """Reference positions covered."""
    return _consumed(cigar, REF_OPS)


def read_length(cigar: Column) -> Column:
    """Read bases covered."""
    return _consumed(cigar, READ_OPS)


def alignment_end(pos: Column, cigar: Column) -> Column:
    """Last reference position of an alignment that starts at ``pos``."""
    return pos + reference_length(cigar) - 1


def placed_elements(pos: Column, cigar: Column) -> Column:
    """CIGAR elements with their starts: array of (op, len, ref_start, read_start).

    Both starts are 1-based and point at the first base the element would consume.
    """
    start = F.struct(
        pos.cast("int").alias("ref"),
        F.lit(1).alias("read"),
        F.array().cast("array<struct<op: string, len: int, ref_start: int, read_start: int>>").alias("out"),
    )

    def step(s: Column, c: Column) -> Column:
        here = F.struct(
            c["op"].alias("op"), c["len"].alias("len"), s["ref"].alias("ref_start"), s["read"].alias("read_start")
        )
        return F.struct(
            (s["ref"] + F.when(F.instr(F.lit(REF_OPS), c["op"]) > 0, c["len"]).otherwise(0)).alias("ref"),
            (s["read"] + F.when(F.instr(F.lit(READ_OPS), c["op"]) > 0, c["len"]).otherwise(0)).alias("read"),
            F.concat(s["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(cigar, start, step, lambda s: s["out"])
