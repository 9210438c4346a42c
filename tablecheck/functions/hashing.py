"""Content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def row_text(columns: Sequence[str | Column]) -> Column:
    """Unambiguous text of a row: a null differs from an empty string and a
    separator inside a value cannot shift values between columns."""
    parts = []
    for c in columns:
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(
            F.when(text.isNull(), F.lit("-")).otherwise(
                F.concat(F.length(text).cast("string"), F.lit(":"), text)
            )
        )
    return F.concat_ws("|", *parts)


def checksum(columns: Sequence[str | Column]) -> Column:
    """Aggregate: order-free checksum over the given columns, as text.

    Sums 60-bit slices of a row hash in decimal(38,0) (ten digits above those of
    the summands), so copies count (unlike XOR) and the result does not depend on
    partitioning.
    """
    part = F.conv(F.substring(F.md5(row_text(columns)), 1, 15), 16, 10)
    return F.coalesce(F.sum(part.cast("decimal(28,0)")), F.lit(0)).cast("string")


def fast_checksum(columns: Sequence[str | Column]) -> Column:
    """Aggregate: cheaper Spark-only variant for comparing two Spark tables."""
    h = F.xxhash64(*columns)
    return F.concat_ws("-", F.bit_xor(h), F.sum(h.cast("decimal(28,0)")), F.count(F.lit(1)))


def sample_bucket(columns: Sequence[str | Column], buckets: int, seed: int = 42) -> Column:
    """Stable bucket number of a row: the same row always lands in the same one."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.pmod(part, F.lit(buckets))
