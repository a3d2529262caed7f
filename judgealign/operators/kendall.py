"""Kendall tau-b over whole groups without forming pairs of rows.

Let C be the number of pairs that both sides order the same way. All untied pairs split into C and the
discordant D, and n0 - Tx - Ty + Txy counts the untied ones, so C alone is enough.

C is counted digit by digit over the dense rank of y: two different ranks first differ at exactly one digit, where the
smaller rank has the smaller digit under equal higher digits. Per digit place, each row adds the number of rows with the
same higher digits, a smaller digit and a smaller x, which are running counts over x.

Groups with a bounded number of values are counted in one task each, after one shuffle of their cells, with binary
digits and sorted arrays. Groups of any size take octal digits and :func:`running_counts`, fully partitioned; no window
holds a whole dimension. Both ways are exact.
"""

from __future__ import annotations

import decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.operators.ranks import Compressed, average_ranks, running_counts
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

# exact for up to 1e19 pairs in one product; a sum of products may have 38 digits
_EXACT = "decimal(38,0)"

_DIGIT_BITS = 3
_BASE = 1 << _DIGIT_BITS


def _choose2(n: Column) -> Column:
    d = n.cast("decimal(19,0)")
    return (d * (d - F.lit(1).cast("decimal(1,0)")) / 2).cast(_EXACT)


def _exact_sum(n: np.ndarray, times: np.ndarray, total: int) -> int:
    """The sum of products of counts; ``total`` bounds both factors' sums."""
    if total < 1 << 31:
        return int((n * times).sum())
    return int((n.astype(object) * times.astype(object)).sum())


def _begins(change: np.ndarray) -> np.ndarray:
    """For each row the first row of its run; a run begins where ``change`` is set."""
    return np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))


def count_concordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Pairs that both sides order the same way, of cells with values x and y and a count n."""
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    rank = np.unique(y[order], return_inverse=True)[1]
    total, found = int(n.sum()), 0
    for level in range(int(rank.max(initial=0)).bit_length()):
        high = rank >> (level + 1)
        order = np.argsort(high, kind="stable")  # by x within equal higher digits
        high, at, count, one = high[order], x[order], n[order], (rank[order] >> level) & 1
        before = np.cumsum(np.where(one, 0, count)) - np.where(one, 0, count)
        block = np.r_[True, high[1:] != high[:-1]]
        tie = block | np.r_[True, at[1:] != at[:-1]]
        smaller = before[_begins(tie)] - before[_begins(block)]
        found += _exact_sum(count * one, smaller, total)
    return found


def _pairs_in(n: np.ndarray, total: int) -> int:
    return (_exact_sum(n, n, total) - int(n.sum())) // 2


def _tied_pairs(values: np.ndarray, n: np.ndarray, total: int) -> int:
    return _pairs_in(np.bincount(np.unique(values, return_inverse=True)[1], n).astype(np.int64) if total < 1 << 53 else _by_value(values, n), total)


def _by_value(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    return np.add.reduceat(n[order], np.flatnonzero(np.r_[True, np.diff(values[order]) != 0]))


def _counted(keys: list[str]):
    """One row per group: number of rows, pairs tied on either side and on both, concordant pairs."""

    def run(cells: pa.Table) -> pa.Table:
        x, y, n = (cells.column(c).to_numpy() for c in ("x", "y", "n"))
        total = int(n.sum())
        counts = [_pairs_in(n, total), _tied_pairs(x, n, total), _tied_pairs(y, n, total), count_concordant(x, y, n)]
        columns = {k: cells.column(k).slice(0, 1).combine_chunks() for k in keys}
        columns["n"] = pa.array([total], pa.int64())
        for name, value in zip(("_txy", "_tx", "_ty", "concordant"), counts, strict=True):
            columns[name] = pa.array([decimal.Decimal(value)], pa.decimal128(38, 0))
        return pa.table(columns)

    return run


def concordant(cells: Compressed, keys: list[str], y_ranks: DataFrame) -> DataFrame:
    """Concordant pairs per group of any size from cells ``(keys, x, y, n)``."""
    top = y_ranks.groupBy(*keys).agg(F.max("dense").alias("_top"))
    ranked = cells.df.join(y_ranks.select(*keys, "y", F.col("dense").alias("_yk")), [*keys, "y"]).join(top, keys)
    bits = F.greatest(F.length(F.bin("_top")), F.lit(1))
    last = F.ceil(bits / _DIGIT_BITS).cast("int") - 1
    levels = ranked.select(*keys, "x", "n", "_yk", F.explode(F.sequence(F.lit(0), last)).alias("_level"))
    digit = F.expr(f"shiftright(_yk, {_DIGIT_BITS} * _level) & {_BASE - 1}")
    per_x = (
        levels.select(
            *keys, "x", "n", "_level", F.expr(f"shiftright(_yk, {_DIGIT_BITS} * (_level + 1))").alias("_high"), digit.alias("_digit")
        )
        .groupBy(*keys, "_level", "_high", "x")
        .agg(*[F.sum(F.when(F.col("_digit") == d, F.col("n")).otherwise(0)).alias(f"_n{d}") for d in range(_BASE)])
    )
    counted = running_counts(per_x, [*keys, "_level", "_high"], "x", [f"_n{d}" for d in range(_BASE - 1)])
    product, smaller = F.lit(0).cast(_EXACT), F.lit(0).cast("bigint")
    for d in range(1, _BASE):
        smaller = smaller + F.col(f"before__n{d - 1}")
        pairs = F.col(f"_n{d}").cast("decimal(19,0)") * smaller.cast("decimal(19,0)")
        product = F.when(F.col(f"_n{d}") > 0, (product + pairs).cast(_EXACT)).otherwise(product)
    return counted.groupBy(*keys).agg(F.sum(product).cast(_EXACT).alias("concordant"))


def _tied(cells: Compressed, keys: list[str], value: str) -> DataFrame:
    """Pairs tied on one side per group."""
    per_value = cells.df.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    return per_value.groupBy(*keys).agg(F.sum(_choose2(F.col("n"))).alias(f"_t{value}"))


def kendall(cells: Compressed, keys: list[str]) -> DataFrame:
    """tau-b per group from compressed pairs, with the pair counts; NULL for a constant side."""
    if cells.bounded:
        types = dict(cells.df.dtypes)
        schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "n long", *(f"{c} {_EXACT}" for c in ("_txy", "_tx", "_ty", "concordant"))])
        joined = cells.df.select(*keys, "x", "y", "n").groupBy(*keys).applyInArrow(_counted(keys), schema)
    else:
        totals = cells.df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(_choose2(F.col("n"))).alias("_txy"))
        conc = concordant(cells, keys, average_ranks(cells, keys, "y"))
        joined = totals.join(_tied(cells, keys, "x"), keys).join(_tied(cells, keys, "y"), keys).join(conc, keys)
    d = "double"
    n0 = _choose2(F.col("n")).cast(d)
    tx, ty, txy, c = (F.col(name).cast(d) for name in ("_tx", "_ty", "_txy", "concordant"))
    untied = n0 - tx - ty + txy
    root = F.sqrt(n0 - tx) * F.sqrt(n0 - ty)
    return joined.select(
        *keys,
        "n",
        c.alias("concordant"),
        (untied - c).alias("discordant"),
        F.try_divide(2 * c - untied, root).alias("kendall"),
    )
