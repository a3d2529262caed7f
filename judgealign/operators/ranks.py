"""Rank statistics without sorting a whole dimension in one task.

There are few dimensions and many rows, so a window partitioned by dimension would put a dimension on one task.
Rows are first compressed to cells (group, x, y, count) by a combining aggregate. Counts of smaller values then come
from three levels of windows over the bits of the value: the top 22 bits of its order-preserving bit pattern, the
next 21 bits, the values that share both. No window can hold more than 2**22 rows, wherever the values lie and
however many there are; nothing is sampled, so a recomputed task repeats the cells.

Scores of a rating scale and means of a few trials have a bounded number of distinct values. A caller that knows this
says so (``bounded=True``), and groups are ranked by one window each. Both ways are exact and give the same numbers.
Everything here is lazy: the compressed table is computed when a report is, once per report where Spark reuses the
exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgealign.operators.moments import metrics, moments
from judgealign.schemas import OVERALL


@dataclass
class Compressed:
    """A compressed table, and whether its groups have a bounded number of rows."""

    df: DataFrame
    bounded: bool


def order_bits(value: Column) -> Column:
    """The bit pattern of a double as a whole number in the order of the values (its own inverse for negative ones)."""
    size = F.abs(value)
    guess = F.floor(F.log2(F.greatest(size, F.lit(2.2250738585072014e-308))))
    low = F.when(F.pow(F.lit(2.0), guess) > size, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= size, guess + 1).otherwise(guess)
    exponent = F.greatest(F.least(low, F.lit(1023)), F.lit(-1022)).cast("int")
    mantissa = (size / F.pow(F.lit(2.0), exponent) - 1.0) * float(1 << 52)
    bits = F.shiftleft((exponent + 1023).cast("bigint"), 52) + mantissa.cast("bigint")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(value < 0, -bits).otherwise(bits)


def _before(cols: list[str], order: str, measure: str) -> Column:
    """Sum of a measure over the earlier rows of a window."""
    w = Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(measure).over(w), F.lit(0))


def running_counts(values: DataFrame, groups: list[str], value: str, measures: list[str], bounded: bool = False) -> DataFrame:
    """Add ``before_<m>``: the sum of measure ``m`` over the smaller values of the group.

    ``values`` has one row per (group, value); ``bounded`` says that a group has a bounded number of them.
    """
    own = [f"`{c}`" for c in values.columns]
    if bounded:
        return values.select(*own, *[_before(groups, value, m).alias(f"before_{m}") for m in measures])
    bits = order_bits(F.col(value).cast("double"))
    # never NULL, see count_pairs; values that are NULL would have cells of their own
    cells = values.withColumns({f"_c{i}": F.coalesce(F.shiftright(bits, b), F.lit(-1 << 62)) for i, b in ((1, 42), (2, 21))})
    cell = [*groups, "_c1", "_c2"]
    fine = cells.groupBy(*cell).agg(*[F.sum(m).alias(f"_f_{m}") for m in measures])
    coarse = fine.groupBy(*groups, "_c1").agg(*[F.sum(f"_f_{m}").alias(f"_g_{m}") for m in measures])
    begins = coarse.select(*groups, "_c1", *[_before(groups, "_c1", f"_g_{m}").alias(f"_b1_{m}") for m in measures])
    start = fine.join(begins, [*groups, "_c1"]).select(
        *cell, *[(F.col(f"_b1_{m}") + _before([*groups, "_c1"], "_c2", f"_f_{m}")).alias(f"_b2_{m}") for m in measures]
    )
    return cells.join(start, cell).select(
        *own, *[(F.col(f"_b2_{m}") + _before(cell, value, m)).alias(f"before_{m}") for m in measures]
    )


def count_pairs(
    pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", overall: bool = True,
    exclude: tuple[str, ...] = (), bounded: bool = False,
) -> Compressed:
    """Compress pairs to ``(keys, x, y, n)``; with ``overall`` also for all dimensions pooled.

    A row counts for its dimension and for the pool in one aggregation: equal cells are combined map-side, so
    the second copy costs no second shuffle.
    """
    # never NULL, which the plan must see: joins would put their own filters below, and each reader of the cells its own copy
    x, y = (F.coalesce(F.col(c).cast("double") + 0.0, F.lit(0.0)) for c in (pred, truth))
    rows = pairs.where(F.col(pred).isNotNull() & F.col(truth).isNotNull()).select(*keys, x.alias("x"), y.alias("y"))
    if overall:
        label = F.array("dim", F.lit(OVERALL))
        if exclude:
            label = F.when(F.col("dim").isin(list(exclude)), F.array("dim")).otherwise(label)
        others = [k for k in keys if k != "dim"]
        rows = rows.select(*others, F.explode(label).alias("dim"), "x", "y")
    return Compressed(rows.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), bounded)


def average_ranks(cells: Compressed, keys: list[str], value: str) -> DataFrame:
    """``(keys, value, n, rank, dense)`` per distinct value: average rank of ties, and 0-based dense rank."""
    values = cells.df.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    values = values.withColumn("one", F.least("n", F.lit(1).cast("bigint")))  # by n, so that the cells are the same ones for all readers
    counted = running_counts(values, keys, value, ["n", "one"], cells.bounded)
    return counted.select(
        *keys,
        value,
        "n",
        (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"),
        F.col("before_one").alias("dense"),
    )


def _ranked_cells(cells: Compressed, keys: list[str]) -> DataFrame:
    """Cells with the average ranks of both sides and the mean rank of the group."""
    if cells.bounded:
        group = Window.partitionBy(*keys)

        def rank(v: str) -> Column:
            upto = group.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow)
            return F.sum("n").over(upto) - (F.sum("n").over(Window.partitionBy(*keys, v)) - 1) / 2

        return cells.df.select(
            *keys, "n", rank("x").alias("rx"), rank("y").alias("ry"), ((F.sum("n").over(group) + 1) / 2).alias("mid")
        )
    rx = average_ranks(cells, keys, "x").select(*keys, "x", F.col("rank").alias("rx"))
    ry = average_ranks(cells, keys, "y").select(*keys, "y", F.col("rank").alias("ry"))
    totals = cells.df.groupBy(*keys).agg(((F.sum("n") + 1) / 2).alias("mid"))
    return cells.df.join(rx, [*keys, "x"]).join(ry, [*keys, "y"]).join(totals, keys)


def spearman(cells: Compressed, keys: list[str]) -> DataFrame:
    """Spearman rho per group from compressed pairs: Pearson over average ranks."""
    # ranks are centred on their mean, which every group shares on both sides
    centred = _ranked_cells(cells, keys).select(
        *keys, (F.col("rx") - F.col("mid")).alias("pred"), (F.col("ry") - F.col("mid")).alias("truth"), "n"
    )
    return metrics(moments(centred, keys, weight="n", centred=True)).select(*keys, "n", F.col("pearson").alias("spearman"))


def class_counts(
    scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", bounded: bool = False
) -> Compressed:
    """``(keys, v, n1, n0)``: positives and negatives per score value."""
    return Compressed(
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, (F.col(score).cast("double") + 0.0).alias("v"))
        .agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0")),
        bounded,
    )


def auc_of(values: Compressed, keys: list[str]) -> DataFrame:
    """ROC AUC per group by rank sums; NULL where only one class is present."""
    ranked = running_counts(values.df, keys, "v", ["n0"], values.bounded)
    won = F.col("n1") * (F.col("before_n0") + F.col("n0") / 2)
    return ranked.groupBy(*keys).agg(
        F.sum("n1").alias("positives"),
        F.sum("n0").alias("negatives"),
        F.try_divide(F.sum(won), F.sum("n1").cast("double") * F.sum("n0")).alias("auc"),
    )


def auc(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", bounded: bool = False) -> DataFrame:
    """ROC AUC per group of scored rows."""
    return auc_of(class_counts(scored, keys, score, label, bounded), keys)
