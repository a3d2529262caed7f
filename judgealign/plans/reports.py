"""Whole reports: trial agreement, folder report, prediction statistics, role-result analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions import ratings as R
from judgealign.functions.scores import finite, rescale_gate
from judgealign.functions.stats import p_value
from judgealign.functions.text import preview
from judgealign.operators import classify, describe, moments, ranks
from judgealign.operators.kendall import kendall
from judgealign.schemas import CONFIDENCE_FIELD, GATE_DIM, OVERALL, REALISM_DIMS


def agreement_report(
    pairs: DataFrame, keys: list[str], exclude: tuple[str, ...] = (), with_p: bool = False, min_n: int = 1,
    finite_only: bool = True, bounded: bool = False,
) -> DataFrame:
    """Pearson, Spearman, Kendall, errors and R² per group and pooled over dimensions.

    ``exclude`` keeps gate dimensions out of OVERALL. ``min_n`` drops smaller dimension groups (not OVERALL).
    ``bounded`` says that scores and truths have a bounded number of values (see :mod:`judgealign.operators.ranks`).
    """
    if finite_only:
        pairs = pairs.where(finite(F.col("pred").cast("double")) & finite(F.col("truth").cast("double")))
    cells = ranks.count_pairs(pairs, keys, exclude=exclude, bounded=bounded)
    basic = moments.agreement(pairs, keys, exclude).where(F.col("n") > 0)
    rho = ranks.spearman(cells, keys).drop("n")
    tau = kendall(cells, keys).select(*keys, "kendall")
    out = basic.join(rho, keys, "left").join(tau, keys, "left")
    if min_n > 1:
        out = out.where((F.col("n") >= min_n) | (F.col("dim") == OVERALL))
    if with_p:
        out = out.withColumns(
            {"pearson_p": p_value(F.col("pearson"), F.col("n")), "spearman_p": p_value(F.col("spearman"), F.col("n"))}
        )
    return out


def trial_consistency(pairs: DataFrame) -> DataFrame:
    """Per dimension: mean and deviation of the trial deviation, mean trial count, over matched items."""
    return pairs.groupBy("dim").agg(
        F.avg("trial_std").alias("trial_std_mean"),
        F.stddev_pop("trial_std").alias("trial_std_std"),
        F.avg("trial_count").alias("trial_count_mean"),
    )


def trial_summary(all_pairs: DataFrame, count_dim: str, exclude: tuple[str, ...] = (GATE_DIM,)) -> DataFrame:
    """Mean and deviation of the number of usable trials, mean trial deviation over dimensions: one row.

    ``all_pairs`` comes from ``pair_up(..., keep_unmatched=True)``: counts are over all items, deviations over the
    matched ones. The counts are those of one dimension, gate dimensions do not enter the deviations.
    """
    per_dim = all_pairs.groupBy("dim").agg(
        F.avg("trial_count").alias("_avg"),
        F.stddev_pop("trial_count").alias("_std"),
        F.avg(F.when(F.col("truth").isNotNull(), F.col("trial_std"))).alias("_dev"),
    )
    own = F.col("dim") == count_dim
    return per_dim.agg(
        F.max(F.when(own, F.col("_avg"))).alias("avg_trial_count"),
        F.max(F.when(own, F.col("_std"))).alias("std_trial_count"),
        F.avg(F.when(~F.col("dim").isin(list(exclude)), F.col("_dev"))).alias("avg_std_across_dimensions"),
    )


def summarise_metrics(report: DataFrame, names: list[str], exclude: tuple[str, ...] = (GATE_DIM,)) -> DataFrame:
    """Mean and population deviation of each metric over the dimension rows.

    One undefined dimension makes the summary undefined: NULL, not the mean of the others.
    """
    dims = report.where((F.col("dim") != OVERALL) & ~F.col("dim").isin(list(exclude)))
    rows = dims.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in names]))
    )
    full = F.count("v") == F.count("*")
    return rows.groupBy("metric").agg(
        F.when(full, F.avg("v")).alias("mean"), F.when(full, F.stddev_pop("v")).alias("std"), F.count("*").alias("dims")
    )


# ---- folder report --------------------------------------------------------------------------------------


def _ratings_of_dim(mapping: dict[str, str]) -> Column:
    entries = [F.lit(x) for d, f in mapping.items() for x in (d, f)]
    field = F.coalesce(F.create_map(*entries)[F.col("specific_dimension")], F.col("specific_dimension"))
    return F.col("ground_truth_ratings")[field]


def prepare_folder(results: DataFrame, policy: str = "drop_null_na1", mapping: dict[str, str] | None = None) -> DataFrame:
    """One row per record with a usable truth: scores, mean truth, rating count, averages of all rated dimensions.

    With ``drop_null_na1_gate`` the gate dimension gets the strict majority vote as truth, ties drop the row.
    Averages of all dimensions are a map ``dim -> mean`` without the confidence rating. The rating lists are read by
    deep expressions: write the result once before a report that reads it for many metrics.
    """
    mapping = mapping or {d: f for d, f, _ in REALISM_DIMS}
    gate = policy == "drop_null_na1_gate"
    is_gate = F.col("specific_dimension") == GATE_DIM

    def mean(values):
        return R.finish(R.mean(values), policy)

    def coerced(r):
        return F.transform(r, lambda x: R.coerce(x, policy))

    def vote(values):
        passes = F.size(F.filter(values, lambda v: v == 1))
        fails = F.size(F.filter(values, lambda v: v == 0))
        return R.majority(passes, fails, F.size(values), "null").cast("double")

    rated = results.where(F.size("ground_truth_ratings") > 0).withColumn("_r", _ratings_of_dim(mapping))
    plain = R.clean(F.col("_r"), policy)
    values = F.when(is_gate, R.clean(F.col("_r"), policy, gate=True)).otherwise(plain) if gate else plain
    rated = rated.withColumn("_v", F.coalesce(values, F.array().cast("array<double>")))
    truth = F.when(is_gate, vote(F.col("_v"))).otherwise(mean(F.col("_v"))) if gate else mean(F.col("_v"))

    others = F.map_filter(F.col("ground_truth_ratings"), lambda k, _: k != CONFIDENCE_FIELD)
    averages = F.transform_values(
        others,
        lambda k, r: F.when(k == GATE_DIM, vote(R.clean(r, policy, gate=True))).otherwise(mean(coerced(r)))
        if gate
        else mean(coerced(r)),
    )
    keep = [c for c in ("id", "source_file") if c in results.columns]
    return (
        rated.select(
            *keep,
            F.col("specific_dimension").alias("dim"),
            F.col("model_score").cast("double").alias("model_score"),
            F.col("probability_score").cast("double").alias("probability_score"),
            truth.alias("truth"),
            F.size("_v").alias("n_ratings"),
            preview(F.col("char_profile"), 50).alias("character"),
            F.map_filter(averages, lambda _, v: v.isNotNull()).alias("gt_avg"),
        )
        .where((F.col("n_ratings") > 0) & F.col("truth").isNotNull())
    )


def predictor_pairs(prepared: DataFrame, predictors: dict[str, str] | None = None) -> DataFrame:
    """Long pairs ``(predictor, dim, pred, truth)`` for the two predictors."""
    predictors = predictors or {"Model": "model_score", "Probability": "probability_score"}
    cells = [F.struct(F.lit(n).alias("predictor"), F.col(c).cast("double").alias("pred")) for n, c in predictors.items()]
    return prepared.select("dim", "truth", F.inline(F.array(*cells))).select("predictor", "dim", "pred", "truth")


def better(model: Column, prob: Column, larger: bool = True) -> Column:
    """Which predictor wins; a tie or an undefined side goes to Probability."""
    wins = model > prob if larger else model < prob
    return F.when(F.coalesce(wins & ~F.isnan(model) & ~F.isnan(prob), F.lit(False)), "Model").otherwise("Probability")


def compare_predictors(report: DataFrame, larger: list[str], smaller: list[str], absolute: tuple[str, ...] = ("pearson", "spearman"), plain: list[str] | None = None) -> DataFrame:
    """Both predictors side by side per dimension with winner flags; ``plain`` columns get no flag."""
    names = [*larger, *smaller]
    aggs = []
    for m in [*names, *(plain or [])]:
        for tag, predictor in (("model", "Model"), ("prob", "Probability")):
            aggs.append(F.max(F.when(F.col("predictor") == predictor, F.col(m))).alias(f"{tag}_{m}"))
    wide = report.groupBy("dim").agg(F.max("n").alias("count"), *aggs)
    for m in names:
        a, b = F.col(f"model_{m}"), F.col(f"prob_{m}")
        if m in absolute:
            a, b = F.abs(a), F.abs(b)
        wide = wide.withColumn(f"better_{m}", better(a, b, m in larger))
    return wide


def gate_report(prepared: DataFrame, dim: str = GATE_DIM, bounded: bool = False) -> DataFrame:
    """Classification of both predictors against the gate votes; the 1..5 model score is rescaled to 0..1."""
    gate = prepared.where(F.col("dim") == dim).select(
        F.inline(
            F.array(
                F.struct(F.lit("Model").alias("predictor"), rescale_gate(F.col("model_score")).alias("score")),
                F.struct(F.lit("Probability").alias("predictor"), F.col("probability_score").alias("score")),
            )
        ),
        F.col("truth").cast("int").alias("label"),
    )
    return classify.classification(gate, ["predictor"], bounded=bounded)


def archetype_summary(prepared: DataFrame, include_gate: bool = False, bounded: bool = False) -> DataFrame:
    """Summary rows of the archetype folder report: errors and correlations per scored dimension and pooled, and
    classification of the gate. ``include_gate`` pools the 0/1 gate votes with the 1..5 scores."""
    pairs = predictor_pairs(prepared)
    exclude = () if include_gate else (GATE_DIM,)
    report = agreement_report(pairs, ["predictor", "dim"], exclude=exclude, min_n=2, bounded=bounded).where(F.col("dim") != GATE_DIM)
    scored = compare_predictors(report, ["pearson", "spearman"], ["mae", "rmse"])
    gate = gate_report(prepared, bounded=bounded).withColumn("dim", F.lit(GATE_DIM))
    voted = compare_predictors(gate, ["accuracy", "precision", "recall", "f1", "auc"], [], absolute=())
    return scored.unionByName(voted, allowMissingColumns=True)


# values that other tools report where a metric is undefined: (correlations, errors)
SENTINELS = {"zero_inf": (0.0, float("inf")), "nan": (float("nan"), float("nan")), "zero": (0.0, 0.0)}


def legacy_sentinels(report: DataFrame, form: str, correlations: list[str], errors: list[str]) -> DataFrame:
    """Undefined metrics (NULL) as the fixed values of an older form."""
    corr, err = SENTINELS[form]
    return report.withColumns(
        {
            **{c: F.coalesce(F.col(c), F.lit(corr)) for c in correlations},
            **{c: F.coalesce(F.col(c), F.lit(err)) for c in errors},
        }
    )


# ---- prediction statistics, audits -----------------------------------------------------------------------------


def prediction_statistics(df: DataFrame, series: dict[str, str]) -> DataFrame:
    """count, mean, deviations, extremes and quartiles per score series, dimension and overall."""
    cells = [F.struct(F.lit(n).alias("series"), F.col(c).cast("double").alias("v")) for n, c in series.items()]
    long = df.select("dim", F.inline(F.array(*cells)))
    return describe.describe(describe.count_values(long, ["series", "dim"], "v", overall_dim="dim"), ["series", "dim"])


def plot_statistics(df: DataFrame, series: dict[str, str]) -> DataFrame:
    """Mean, sample deviation, median and range per series and dimension; 0 where a dimension has no value."""
    stats = prediction_statistics(df, series).where(F.col("dim") != OVERALL)
    grid = df.select("dim").distinct().select("dim", F.explode(F.array(*[F.lit(s) for s in series])).alias("series"))
    zero = F.lit(0.0)
    return grid.join(stats, ["series", "dim"], "left").select(
        "series", "dim",
        *[F.coalesce(c, zero).alias(n) for n, c in (
            ("mean", F.col("mean")), ("std", F.col("std_sample")), ("median", F.col("median")), ("range", F.col("range")))],
    )


def non_finite(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Number of NaN and infinite values per column and group."""
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.count_if(F.isnan(v)).alias(f"{c}_nan"), F.count_if(F.abs(v) == float("inf")).alias(f"{c}_inf")]
    return df.groupBy(*keys).agg(*aggs)


def counts_by_dim(df: DataFrame, file_col: str | None = None) -> DataFrame:
    """Records per dimension, most frequent first."""
    aggs = [F.count("*").alias("records")]
    if file_col:
        aggs.append(F.countDistinct(file_col).alias("files"))
    return df.groupBy("dim").agg(*aggs).orderBy(F.desc("records"), "dim")


def usable_score() -> Column:
    """1 where a record was evaluated, else NULL: a score in one dimension, or a map of scores with any entry."""
    single = (F.col("evaluation_type") == "specific_dimension") & (F.coalesce("specific_dimension", F.lit("")) != "")
    return F.when(F.when(single, F.col("model_score").isNotNull()).otherwise(F.coalesce(F.size("dimension_scores") > 0, F.lit(False))), 1)


def with_any_score(df: DataFrame) -> DataFrame:
    """Records with a model score or a probability score."""
    return df.where(F.coalesce(F.col("model_score").cast("double"), F.col("probability_score").cast("double")).isNotNull())


def category_fields() -> dict[str, str]:
    """Annotation field of each category of a free-text evaluation that has one."""
    fields = {d: f for d, f, _ in REALISM_DIMS}
    own = {f: f for f in fields.values()}
    return {**own, **fields, "emotional_accuracy": "emotion_accuracy"}


def category_pairs(ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """Correlation of each category ``(id, category, rating)`` with its own field ``(id, field, truth)`` over all records."""
    entries = [F.lit(x) for c, f in category_fields().items() for x in (c, f)]
    known = ratings.withColumn("field", F.create_map(*entries)[F.col("category")]).where(F.col("field").isNotNull())
    pairs = known.join(truth, ["id", "field"]).withColumn("pair", F.concat("category", F.lit("_vs_"), "field"))
    return moments.metrics(moments.moments(pairs, ["pair"], "rating", "truth")).select("pair", "n", "pearson")


def heatmap_predictors(report: DataFrame) -> DataFrame:
    """Pearson and Spearman of both predictors as ``(dim, metric, value)``, one row per cell of the four-column table."""
    short = F.when(F.col("predictor") == "Model", "Model").otherwise("Prob")
    cells = [F.struct(F.concat(short, F.lit(f"_{label}")).alias("metric"), F.col(m).alias("value")) for label, m in (("Pearson", "pearson"), ("Spearman", "spearman"))]
    return report.where(F.col("dim") != OVERALL).select("dim", F.inline(F.array(*cells)))


def success_rates(df: DataFrame, score: Column, keys: list[str]) -> DataFrame:
    """Usable and failed evaluations and the success rate."""
    ok = F.count_if(score.isNotNull())
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), ok.alias("successful"), (F.count("*") - ok).alias("failed"),
        F.try_divide(ok.cast("double"), F.count("*")).alias("success_rate"),
    )


def rating_summary(ratings: DataFrame, category: str = "category", rating: str = "rating") -> DataFrame:
    """mean, deviation, min, max, count per category from rows ``(category, rating)``."""
    return (
        ratings.where(F.col(rating).isNotNull())
        .groupBy(F.col(category).alias("category"))
        .agg(
            F.avg(rating).alias("mean"), F.stddev_pop(rating).alias("std"), F.min(rating).alias("min"),
            F.max(rating).alias("max"), F.count(rating).alias("count"),
        )
    )


def heatmap(report: DataFrame, names: list[str]) -> DataFrame:
    """Long correlation table ``(dim, metric, value)`` of the dimension rows."""
    cells = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names]
    return report.where(F.col("dim") != OVERALL).select("dim", F.inline(F.array(*cells)))
