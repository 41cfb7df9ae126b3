"""SAM row expressions over a read and its mate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of the format.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED = 0x1, 0x2, 0x4, 0x8
REVERSE, MATE_REVERSE, FIRST, SECOND = 0x10, 0x20, 0x40, 0x80


def _bit(condition: Column, value: int) -> Column:
    return F.when(condition, F.lit(value)).otherwise(F.lit(0))


def checked_read_no(read_no: Column) -> Column:
    """1 or 2; anything else fails the query."""
    bad = F.raise_error(F.concat(F.lit("read number must be 1 or 2, got "), read_no.cast("string")))
    return F.when(read_no.isin(1, 2), read_no).otherwise(bad.cast("int"))


def insert_size(
    read_no: Column, ref: Column, pos: Column, end: Column, mate_ref: Column, mate_pos: Column, mate_end: Column
) -> Column:
    """Signed template length: positive for the leftmost mate, 0 across contigs.

    The contig columns are NULL for unmapped reads.
    """
    size = F.greatest(end, mate_end) - F.least(pos, mate_pos) + 1
    left = (pos < mate_pos) | ((pos == mate_pos) & (read_no == 1))
    return F.when(ref == mate_ref, F.when(left, size).otherwise(-size)).otherwise(F.lit(0)).cast("int")


def proper_pair(
    ref: Column, pos: Column, strand: Column, mate_ref: Column, mate_pos: Column, mate_strand: Column,
    size: Column, max_insert: int = 1000,
) -> Column:
    """Same contig, strands facing each other, size within bounds. Never NULL."""
    forward = F.when(strand == "+", pos).otherwise(mate_pos)
    backward = F.when(strand == "+", mate_pos).otherwise(pos)
    ok = (ref == mate_ref) & (strand != mate_strand) & (forward <= backward) & (F.abs(size) <= max_insert)
    return F.coalesce(ok, F.lit(False))


def sam_flag(
    read_no: Column, mapped: Column, strand: Column, proper: Column, mate_mapped: Column, mate_strand: Column,
    mate_info_on_unmapped: bool = False,
) -> Column:
    """Flag bits. By default an unmapped read says nothing about its mate."""
    mate_bits = _bit(~mate_mapped, MATE_UNMAPPED) + _bit(mate_mapped & (mate_strand == "-"), MATE_REVERSE)
    own = _bit(proper, PROPER) + _bit(strand == "-", REVERSE) + mate_bits
    lost = F.lit(UNMAPPED) + (mate_bits if mate_info_on_unmapped else F.lit(0))
    which = F.when(checked_read_no(read_no) == 1, F.lit(FIRST)).otherwise(F.lit(SECOND))
    return (F.lit(PAIRED) + which + F.when(mapped, own).otherwise(lost)).cast("int")
