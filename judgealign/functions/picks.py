"""Deterministic pseudo-random choices.

Every choice is a function of a seed and of row keys through md5, so that a retried task repeats it,
row order and partitioning do not matter, and another SQL engine can check it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed: int, *keys) -> Column:
    """md5 over ``seed|key|key...`` as hex text; strings are literals, Columns are values."""
    parts = [F.lit(str(seed))] + [F.lit(k) if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts))


def number(seed: int, *keys) -> Column:
    """The first 15 hex digits of the digest as a number below 2**60: no table has more rows than it can draw from."""
    return F.conv(F.substring(digest(seed, *keys), 1, 15), 16, 10).cast("bigint")


def below(n: Column, seed: int, *keys) -> Column:
    """A number in ``0..n-1``; NULL where ``n`` is 0."""
    return F.when(n > 0, number(seed, *keys) % n)


def choose(options: Column, seed: int, *keys) -> Column:
    """One element of an array; NULL for an empty array."""
    index = below(F.size(options), seed, *keys)
    return F.when(F.size(options) > 0, F.get(options, index.cast("int")))


def permute(options: Column, seed: int, *keys) -> Column:
    """The elements of a string array in a random but repeatable order."""
    tagged = F.transform(options, lambda o: F.struct(digest(seed, *keys, o).alias("h"), o.alias("o")))
    return F.transform(F.array_sort(tagged), lambda s: s["o"])


def distinct_indices(pool_size: Column, k: int, seed: int, *keys) -> Column:
    """``k`` different numbers in ``0..pool_size-1`` (all of them where the pool is not larger).

    Draw ``j`` is uniform over the ``pool_size - j`` numbers not yet drawn: a draw among the free ones is
    shifted past the taken ones in ascending order.
    """
    def step(taken, j):
        draw = number(seed, *keys, j) % (pool_size - j)
        slot = F.aggregate(F.array_sort(taken), draw, lambda x, t: F.when(x >= t, x + 1).otherwise(x))
        return F.concat(taken, F.array(slot))

    drawn = F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.lit(k - 1).cast("bigint")), F.array().cast("array<bigint>"), step
    )
    everything = F.sequence(F.lit(0).cast("bigint"), F.greatest(pool_size - 1, F.lit(0)).cast("bigint"))
    return F.when(pool_size > k, drawn).otherwise(F.when(pool_size > 0, everything))
