"""Mergeable moments per group, and the error and correlation metrics that follow from them.

One row per group is all that crosses the network: counts, means and central moments, which Spark merges without
cancellation. Rows of groups (of dimensions, batches or files) merge by the pairwise formula around their common
mean, so pooling costs no second pass over the pairs. The same rows serve the stream.

A pair with a NaN or infinite side makes the metrics of its group undefined (NULL); such pairs are counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgealign.schemas import OVERALL

ADDED = ("n", "sae", "sse", "sape", "zero_truth", "nonfinite")
MOMENTS = (*ADDED, "mp", "mg", "vp", "vg", "cpg", "min_p", "max_p", "min_g", "max_g")


def moments(
    pairs: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth", weight: str | None = None, centred: bool = False
) -> DataFrame:
    """Moments of a table of pairs per group: means ``mp, mg``, sums of squared deviations ``vp, vg, cpg``, errors.

    ``weight`` is a multiplicity column (default 1); ``centred`` says that weighted values lie around zero in every
    group, which saves finding a centre. Only finite pairs enter the moments and extremes.
    """
    p, g = F.col(pred).cast("double"), F.col(truth).cast("double")
    inf = float("inf")
    bad = F.isnan(p) | F.isnan(g) | (F.abs(p) == inf) | (F.abs(g) == inf)
    usable = ~bad & p.isNotNull() & g.isNotNull()
    x, y = F.when(usable, p), F.when(usable, g)
    w = F.col(weight) if weight else F.lit(1)
    err = x - y
    shared = [
        F.sum(F.when(p.isNotNull() & g.isNotNull(), w.cast("bigint"))).alias("n"),
        F.sum(w * F.abs(err)).alias("sae"),
        F.sum(w * err * err).alias("sse"),
        F.sum(w * F.abs(F.try_divide(err, y))).alias("sape"),
        F.sum(F.when(y == 0, w.cast("bigint")).otherwise(0)).alias("zero_truth"),
        F.sum(F.when(bad, w.cast("bigint")).otherwise(0)).alias("nonfinite"),
        F.min(x).alias("min_p"),
        F.max(x).alias("max_p"),
        F.min(y).alias("min_g"),
        F.max(y).alias("max_g"),
    ]
    if weight is None:
        used = F.count(x)
        central = [
            F.avg(x).alias("mp"), F.avg(y).alias("mg"),
            (F.var_pop(x) * used).alias("vp"), (F.var_pop(y) * used).alias("vg"), (F.covar_pop(x, y) * used).alias("cpg"),
        ]
        return pairs.groupBy(*keys).agg(*shared, *central).select(*keys, *MOMENTS)
    # equal pairs share a row: deviations are taken from values of the group (or zero), then from the mean
    return _weighted(pairs, keys, x, y, w, shared, centred)


def _weighted(pairs: DataFrame, keys: list[str], x: Column, y: Column, w: Column, shared: list[Column], centred: bool) -> DataFrame:
    """Central moments with multiplicities: sums about the group's least values, which lie inside the data."""
    if centred:
        near = pairs.withColumns({"_x0": F.lit(0.0), "_y0": F.lit(0.0)})
    else:
        near = pairs.join(pairs.groupBy(*keys).agg(F.min(x).alias("_x0"), F.min(y).alias("_y0")), keys)
    dx, dy = x - F.col("_x0"), y - F.col("_y0")
    used = F.when(x.isNotNull(), w)
    sums = near.groupBy(*keys, "_x0", "_y0").agg(
        *shared, F.sum(used).alias("_u"), F.sum(w * dx).alias("_sx"), F.sum(w * dy).alias("_sy"),
        F.sum(w * dx * dx).alias("_sxx"), F.sum(w * dy * dy).alias("_syy"), F.sum(w * dx * dy).alias("_sxy"),
    )
    u, sx, sy = F.col("_u"), F.col("_sx"), F.col("_sy")
    return sums.withColumns(
        {
            "mp": F.col("_x0") + F.try_divide(sx, u), "mg": F.col("_y0") + F.try_divide(sy, u),
            "vp": F.col("_sxx") - F.try_divide(sx * sx, u), "vg": F.col("_syy") - F.try_divide(sy * sy, u),
            "cpg": F.col("_sxy") - F.try_divide(sx * sy, u),
        }
    ).select(*keys, *MOMENTS)


def merge_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Merge rows of moments (per batch, per file, per dimension) to fewer groups.

    The common mean is found by a window over the few rows of a group; the sums then follow without a second
    shuffle: deviations within the rows plus deviations of their means.
    """
    group = Window.partitionBy(*keys)
    used = F.col("n") - F.col("nonfinite")
    total = F.sum(used).over(group)
    rows = rows.withColumns(
        {
            "_u": used,
            "_mp": F.try_divide(F.sum(used * F.col("mp")).over(group), total),
            "_mg": F.try_divide(F.sum(used * F.col("mg")).over(group), total),
        }
    )
    dp, dg = F.col("mp") - F.col("_mp"), F.col("mg") - F.col("_mg")
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ADDED],
        F.max("_mp").alias("mp"),
        F.max("_mg").alias("mg"),
        F.sum(F.col("vp") + F.col("_u") * dp * dp).alias("vp"),
        F.sum(F.col("vg") + F.col("_u") * dg * dg).alias("vg"),
        F.sum(F.col("cpg") + F.col("_u") * dp * dg).alias("cpg"),
        F.min("min_p").alias("min_p"),
        F.max("max_p").alias("max_p"),
        F.min("min_g").alias("min_g"),
        F.max("max_g").alias("max_g"),
    )


def with_overall(rows: DataFrame, keys: list[str], dim: str = "dim", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Add the pooled group of all dimensions. ``exclude`` keeps gate dimensions out of the pool.

    Each row of moments goes to its own group and to the pool, and the groups are merged once more: the pairs
    behind them are read once.
    """
    label = F.array(F.col(dim), F.lit(OVERALL))
    if exclude:
        label = F.when(F.col(dim).isin(list(exclude)), F.array(dim)).otherwise(label)
    others = [c for c in rows.columns if c != dim]
    doubled = rows.select(*others, F.explode(label).alias(dim))
    return merge_moments(doubled, keys)


def correlation(vp: Column, vg: Column, cpg: Column, constant: Column) -> Column:
    """Pearson r from central moments, NULL for a constant side."""
    root = F.sqrt(F.when((vp > 0) & (vg > 0), vp)) * F.sqrt(F.when((vp > 0) & (vg > 0), vg))
    r = F.try_divide(cpg, root)
    return F.when(~constant & ~F.isnan(r), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def metrics(rows: DataFrame, nonfinite: bool = False) -> DataFrame:
    """Metric columns from moments: n, pearson, mae, mse, rmse, mape, zero_truth, r2.

    ``r2`` is the coefficient of determination against the mean truth (it can be negative). With a constant
    truth it is 1 for a perfect prediction and 0 otherwise. With a zero truth ``mape`` is infinite. All of them are
    NULL in a group with NaN or infinite pairs; ``nonfinite`` adds the number of these.
    """
    keys = [c for c in rows.columns if c not in MOMENTS]
    n = F.col("n").cast("double")
    flat_g = F.col("min_g") == F.col("max_g")
    constant = flat_g | (F.col("min_p") == F.col("max_p"))
    r2 = F.when(flat_g, F.when(F.col("sse") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.try_divide(F.col("sse"), F.col("vg")))
    mape = F.when(F.col("zero_truth") > 0, float("inf")).otherwise(F.col("sape") / n * 100)

    def defined(value: Column) -> Column:
        return F.when(F.col("nonfinite") == 0, value)

    return rows.select(
        *keys,
        "n",
        defined(correlation(F.col("vp"), F.col("vg"), F.col("cpg"), constant)).alias("pearson"),
        defined(F.col("sae") / n).alias("mae"),
        defined(F.col("sse") / n).alias("mse"),
        defined(F.sqrt(F.col("sse") / n)).alias("rmse"),
        defined(mape).alias("mape"),
        "zero_truth",
        defined(r2).alias("r2"),
        *(["nonfinite"] if nonfinite else []),
    )


def agreement(pairs: DataFrame, keys: list[str], exclude: tuple[str, ...] = (), nonfinite: bool = False) -> DataFrame:
    """Moment metrics per group and pooled over dimensions."""
    return metrics(with_overall(moments(pairs, keys), keys, exclude=exclude), nonfinite)
