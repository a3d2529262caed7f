"""Descriptive statistics with exact quantiles, histograms and box tables.

Everything works on the compressed table (keys, value, count); an exact quantile is the value whose running
count covers the wanted position. Groups of any size are narrowed down by the bits of the value: counts per leading bits tell
which of them hold a wanted rank, and only the values that share these go into the next count. So no task holds
all values of a group, and no values are sorted but the few that share all but the last 21 bits with a quantile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgealign.operators.ranks import Compressed, order_bits
from judgealign.schemas import OVERALL


def count_values(
    df: DataFrame, keys: list[str], value: str, overall_dim: str | None = None, bounded: bool = False
) -> Compressed:
    """``(keys, v, n)`` of the defined values; ``overall_dim`` also pools that key."""
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, (v + 0.0).alias("v"))
    if overall_dim is not None:
        others = [k for k in keys if k != overall_dim]
        rows = rows.select(*others, F.explode(F.array(overall_dim, F.lit(OVERALL))).alias(overall_dim), "v")
    return Compressed(rows.groupBy(*keys, "v").agg(F.count("*").alias("n")), bounded)


def _before(cols: list[str], order: str) -> Column:
    """Counts of the earlier rows of a window."""
    w = Window.partitionBy(*cols).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(w), F.lit(0))


def _narrowed(values: DataFrame, hits: DataFrame, cell: list[str], finer: str) -> DataFrame:
    """The rows of the cells that hold wanted ranks, counted by a finer cell; ranks count from the cell's beginning."""
    # an inner join with different cells: a semi join would go below the count of values, which then could not be shared
    inside = values.join(hits.select(*cell).distinct(), cell).groupBy(*cell, finer).agg(F.sum("n").alias("n"))
    counted = inside.withColumn("_before", _before(cell, finer)).join(hits, cell)
    found = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("n"))
    return counted.where(found).withColumn("_rank", F.col("_rank") - F.col("_before")).drop("n", "_before")


def _selected(values: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``(keys, _i, _total, v)``: the values at the ranks below (2 i) and above (2 i + 1) the i-th quantile's position."""
    bits = order_bits(F.col("v"))
    cells = values.withColumns({"_c1": F.shiftright(bits, 42), "_c2": F.shiftright(bits, 21)})
    top = cells.groupBy(*keys, "_c1").agg(F.sum("n").alias("n"))
    ranked = top.withColumns({"_before": _before(keys, "_c1"), "_total": F.sum("n").over(Window.partitionBy(*keys))})
    ranks = []
    for i, q in enumerate(qs):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        for k, r in ((2 * i, F.floor(pos)), (2 * i + 1, F.ceil(pos))):
            ranks.append(F.struct(F.lit(k).alias("_i"), (r.cast("bigint") - F.col("_before")).alias("_rank")))
    here = F.filter(F.array(*ranks), lambda s: (s["_rank"] >= 0) & (s["_rank"] < F.col("n")))
    hits = ranked.select(*keys, "_c1", "_total", F.inline(here))
    hits = _narrowed(cells, hits, [*keys, "_c1"], "_c2").drop("_c1")
    return _narrowed(cells, hits, [*keys, "_c2"], "v").select(*keys, "_i", "_total", "v")


def quantiles(values: Compressed, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation between neighbours, one column per entry of ``qs``."""
    if values.bounded:
        ranked = values.df.withColumns({"_before": _before(keys, "v"), "_total": F.sum("n").over(Window.partitionBy(*keys))})

        def at(k: int, position: Column) -> Column:
            inside = (F.col("_before") <= position) & (position < F.col("_before") + F.col("n"))
            return F.max(F.when(inside, F.col("v")))

    else:
        ranked = _selected(values.df, keys, list(qs.values()))

        def at(k: int, position: Column) -> Column:
            return F.max(F.when(F.col("_i") == k, F.col("v")))

    aggs = []
    for i, (name, q) in enumerate(qs.items()):
        pos = (F.col("_total") - 1) * F.lit(float(q))
        aggs += [at(2 * i, F.floor(pos)).alias(f"_lo_{name}"), at(2 * i + 1, F.ceil(pos)).alias(f"_hi_{name}"), F.max(pos - F.floor(pos)).alias(f"_w_{name}")]
    lerp = [
        (F.col(f"_lo_{m}") + (F.col(f"_hi_{m}") - F.col(f"_lo_{m}")) * F.col(f"_w_{m}")).alias(m) for m in qs
    ]
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *lerp)


def spread(values: Compressed, keys: list[str]) -> DataFrame:
    """count, mean, population and sample deviation, min, max, range from counted values."""
    first = values.df.groupBy(*keys).agg(
        F.sum("n").alias("count"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
    )
    dev = F.col("v") - F.col("mean")
    squares = (
        values.df.join(first.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(dev * dev * F.col("n")).alias("_ss"))
    )
    n = F.col("count")
    return first.join(squares, keys).select(
        *keys,
        n,
        "mean",
        F.sqrt(F.col("_ss") / n).alias("std"),
        F.sqrt(F.try_divide(F.col("_ss"), n - 1)).alias("std_sample"),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
    )


QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(values: Compressed, keys: list[str]) -> DataFrame:
    """Spread and quartiles per group."""
    return spread(values, keys).join(quantiles(values, keys, QUARTILES), keys)


def histogram(values: Compressed, keys: list[str], bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed; only bins that hold something.

    A constant series is spread over one unit around its value, as plotting tools do.
    """
    ends = values.df.groupBy(*keys).agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    flat = F.col("_a") == F.col("_b")
    low = F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("_b") - F.col("_a")) / bins
    placed = values.df.join(ends, keys).withColumns({"_low": low, "_width": width})
    bin_no = F.least(F.floor((F.col("v") - F.col("_low")) / F.col("_width")), F.lit(bins - 1)).cast("bigint")
    return (
        placed.groupBy(*keys, bin_no.alias("bin"), "_low", "_width")
        .agg(F.sum("n").alias("count"))
        .select(
            *keys,
            "bin",
            (F.col("_low") + F.col("_width") * F.col("bin")).alias("left"),
            (F.col("_low") + F.col("_width") * (F.col("bin") + 1)).alias("right"),
            "count",
        )
    )


def box_table(values: Compressed, keys: list[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 times the interquartile range, number of outliers."""
    q = quantiles(values, keys, QUARTILES)
    iqr = F.col("q75") - F.col("q25")
    fences = q.withColumns({"_lo": F.col("q25") - 1.5 * iqr, "_hi": F.col("q75") + 1.5 * iqr})
    inside = (F.col("v") >= F.col("_lo")) & (F.col("v") <= F.col("_hi"))
    return (
        values.df.join(fences, keys)
        .groupBy(*keys, "q25", "median", "q75")
        .agg(
            F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
        )
    )


def outliers(values: Compressed, keys: list[str]) -> DataFrame:
    """The values beyond the whisker fences with their counts."""
    q = quantiles(values, keys, {"q25": 0.25, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    beyond = (F.col("v") < F.col("q25") - 1.5 * iqr) | (F.col("v") > F.col("q75") + 1.5 * iqr)
    return values.df.join(q, keys).where(beyond).select(*keys, "v", "n")
