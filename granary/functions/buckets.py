"""Length buckets and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual lengths.
BUCKETS = (128, 256, 512, 1024, 2048)


def checked_buckets(buckets: Sequence[int]) -> tuple[int, ...]:
    """The buckets, if positive, sorted and without repeats."""
    out = tuple(buckets)
    if not out or any(b < 1 for b in out):
        raise ValueError("bucket lengths must be positive and there must be one at least")
    if list(out) != sorted(set(out)):
        raise ValueError("bucket lengths must ascend without repeats")
    return out


def normalized_buckets(buckets: Sequence[int]) -> tuple[int, ...]:
    return checked_buckets(sorted(set(buckets)))


def assign_bucket(n: Column, buckets: Sequence[int] = BUCKETS) -> tuple[Column, Column]:
    """(bucket, truncated): the least length that holds n tokens, else the largest and what exceeds it; n < 1 raises."""
    lengths = checked_buckets(buckets)
    n = F.when(n < 1, F.raise_error(F.lit("token count must be positive")).cast("int")).otherwise(n)
    bucket = F.lit(lengths[-1])
    for b in reversed(lengths[:-1]):
        bucket = F.when(n <= b, F.lit(b)).otherwise(bucket)
    return bucket.cast("int"), F.greatest(n - lengths[-1], F.lit(0)).cast("int")


def pad_left(tokens: Column, length: Column | int, pad: Column) -> Column:
    """The last ``length`` elements, filled with pad from the left."""
    length = F.lit(length) if isinstance(length, int) else length
    size = F.size(tokens)
    fill = F.array_repeat(pad, F.greatest(length - size, F.lit(0)))
    return F.when(size > length, F.slice(tokens, -length, length)).otherwise(F.concat(fill, tokens))


def attention_mask(tokens: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    real = F.least(F.size(tokens), length)
    return F.concat(F.array_repeat(F.lit(0), length - real), F.array_repeat(F.lit(1), real))
