"""Topic message bodies: length-prefixed blocks and table-of-contents lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _block(text: Column) -> Column:
    body = F.encode(text, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), body)


def encode_prq(*blocks: Column) -> Column:
    """Each field as a big-endian int32 length and its bytes."""
    return F.concat(*[_block(b) for b in blocks])


def parse_blocks(value: Column, count: int = 5) -> Column:
    """First ``count`` length-prefixed blocks of ``value`` as an array of strings.

    A body that ends early fails the query rather than giving short fields.
    """
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, _i: Column) -> Column:
        size = F.conv(F.hex(F.substring(value, s["at"], F.lit(4))), 16, 10).cast("int")
        body = F.substring(value, s["at"] + 4, size)
        whole = F.when(F.octet_length(body) == size, F.decode(body, "UTF-8")).otherwise(
            F.raise_error(F.lit("truncated length-prefixed block")).cast("string")
        )
        return F.struct((s["at"] + 4 + size).alias("at"), F.concat(s["out"], F.array(whole)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, step, lambda s: s["out"])


def parse_prq(value: Column) -> Column:
    """A read pair message as struct (name, b1, q1, b2, q2)."""
    blocks = parse_blocks(value, 5)
    return F.transform(
        F.array(blocks),
        lambda a: F.struct(*[F.get(a, F.lit(i)).alias(n) for i, n in enumerate(("name", "b1", "q1", "b2", "q2"))]),
    )[0]
