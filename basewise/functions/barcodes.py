"""Barcode comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(observed: Column, expected: Column) -> Column:
    """Positions of ``observed`` that differ from ``expected``.

    A shorter observed barcode is compared on its own length only. A longer one
    cannot match and gives NULL. ``N`` is a letter like any other.
    """
    diff = F.aggregate(
        F.zip_with(
            F.split(observed, ""),
            F.slice(F.split(expected, ""), F.lit(1), F.length(observed)),
            lambda a, b: F.when(a == b, 0).otherwise(1),
        ),
        F.lit(0),
        lambda s, d: s + d,
    )
    return (
        F.when(F.length(observed) > F.length(expected), F.lit(None).cast("int"))
        .when(F.length(observed) == 0, F.lit(0))
        .otherwise(diff)
    )
