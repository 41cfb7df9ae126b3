"""Call bytes to bases, qualities, names and records.

A call byte holds the base in bits 0-1 and the quality in bits 2-7. Both decoders
are one ``translate`` over the ISO-8859-1 view of the bytes, so they run inside
whole-stage codegen for reads of any length.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format.
BASES = "ACGT"
PHRED_OFFSET = 33
NO_CALL_BASE = "N"
NO_CALL_QUAL = "#"

_BYTES = "".join(map(chr, range(256)))
_BASE_OF = "".join(BASES[b & 3] for b in range(256))
_QUAL_OF = "".join(chr(PHRED_OFFSET + (b >> 2)) for b in range(256))


def _masked(alphabet: str, mark: str) -> str:
    # Quality 0 is bytes 0 to 3, whatever their base bits say.
    return mark * 4 + alphabet[4:]


def _latin1(raw: Column) -> Column:
    return F.decode(raw, "ISO-8859-1")


def bases(raw: Column, mask: bool = True) -> Column:
    """Base letters of a call string; no-calls read ``N`` unless ``mask`` is off."""
    target = _masked(_BASE_OF, NO_CALL_BASE) if mask else _BASE_OF
    return F.translate(_latin1(raw), _BYTES, target)


def quals(raw: Column, mask: bool = True) -> Column:
    """Phred+33 qualities of a call string; no-calls read ``#`` unless ``mask`` is off."""
    target = _masked(_QUAL_OF, NO_CALL_QUAL) if mask else _QUAL_OF
    return F.translate(_latin1(raw), _BYTES, target)


def mask_bases(base: Column, qual: Column) -> Column:
    """``N`` where an unmasked quality string shows quality 0 (``!``)."""
    return F.array_join(
        F.zip_with(
            F.split(base, ""),
            F.split(qual, ""),
            lambda b, q: F.when(q == chr(PHRED_OFFSET), F.lit(NO_CALL_BASE)).otherwise(b),
        ),
        "",
    )


def mask_quals(qual: Column) -> Column:
    """``#`` for quality 0 (``!``)."""
    return F.translate(qual, chr(PHRED_OFFSET), NO_CALL_QUAL)


def read_name(*parts: Column) -> Column:
    """``instrument:run:flowcell:lane:tile:x:y``."""
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def fastq_header(name: Column, read_no: Column, index: Column) -> Column:
    """FASTQ title line, with the newline that belongs to it."""
    return F.concat(F.lit("@"), name, F.lit(" "), read_no.cast("string"), F.lit(":N:0:"), index, F.lit("\n"))


def fastq_text(header: Column, base: Column, qual: Column) -> Column:
    """Four-line record; ``header`` ends in its own newline."""
    return F.concat(header, base, F.lit("\n+\n"), qual, F.lit("\n"))


def pair_text(name: Column, b1: Column, q1: Column, b2: Column, q2: Column) -> Column:
    """Five tab-separated fields."""
    return F.concat_ws("\t", name, b1, q1, b2, q2)


def reverse_complement(seq: Column) -> Column:
    """Other strand of a base string; ``N`` stays."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


# The public 8-level binning as (lowest, highest, bin) qualities.
QUALITY_BINS = [(0, 0, 0), (1, 1, 1), (2, 9, 6), (10, 19, 15), (20, 24, 22),
                (25, 29, 27), (30, 34, 33), (35, 39, 37), (40, 93, 40)]
_BIN_FROM = "".join(chr(PHRED_OFFSET + q) for lo, hi, _ in QUALITY_BINS for q in range(lo, hi + 1))
_BIN_TO = "".join(chr(PHRED_OFFSET + to) for lo, hi, to in QUALITY_BINS for _q in range(lo, hi + 1))


def bin_quals(qual: Column) -> Column:
    """Qualities rounded to 8 levels."""
    return F.translate(qual, _BIN_FROM, _BIN_TO)
