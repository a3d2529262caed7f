"""From parsed judge rows and raw ratings to aligned (prediction, truth) pairs.

Rows stay wide (one column per dimension) through the shuffles and become long only after the join, so
that an item crosses the network once and not once per dimension.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions import ratings as R
from judgealign.functions import text as X
from judgealign.functions.keys import nested_or_top
from judgealign.functions.scores import range_check
from judgealign.schemas import CONFIDENCE_FIELD, dim_map


def last_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    ``max_by`` combines map-side, so a key with very many copies costs no big group.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def unpivot(df: DataFrame, ids: list[str], dims: list[str], value: str) -> DataFrame:
    """Dimension columns to rows ``(ids..., dim, value)``."""
    cells = [F.struct(F.lit(d).alias("dim"), F.col(f"`{d}`").alias(value)) for d in dims]
    return df.select(*ids, F.inline(F.array(*cells)))


def legacy_ratings(df: DataFrame, fields: dict[str, str], prefixes: list[str]) -> list[Column]:
    """Per dimension an array of the ratings found in ``<prefix><field>`` columns, missing ones skipped."""
    out = []
    for dim, field in fields.items():
        found = [F.col(f"`{p}{field}`").cast("string") for p in prefixes if f"{p}{field}" in df.columns]
        ratings = F.array(*found) if found else F.array().cast("array<string>")
        out.append(F.filter(ratings, lambda r: r.isNotNull()).alias(dim))
    return out


def trial_means(parsed: DataFrame, dims: list[str], key: str | list[str] = "item_id") -> DataFrame:
    """Per item and dimension: mean, population deviation and number of usable trials.

    Output is wide: ``<dim>``, ``<dim>_std``, ``<dim>_count``. Without a usable trial they are 1, 0 and 0.
    """
    keys = [key] if isinstance(key, str) else key
    aggs = []
    for d in dims:
        aggs += [
            F.coalesce(F.avg(d), F.lit(1.0)).alias(d),
            F.coalesce(F.stddev_pop(d), F.lit(0.0)).alias(f"{d}_std"),
            F.count(d).alias(f"{d}_count"),
        ]
    return parsed.groupBy(*keys).agg(*aggs)


def truth_means_wide(raw: DataFrame, dims: list[str], policy: str, key: str = "item_id") -> DataFrame:
    """Mean over annotators from one row per (item, annotator) with a raw rating column per dimension."""
    return raw.groupBy(key).agg(*[R.mean_or_null(R.coerce(F.col(d), policy), policy).alias(d) for d in dims])


def truth_means_arrays(items: DataFrame, fields: dict[str, Column], policy: str, key: str = "item_id") -> DataFrame:
    """Mean over annotators from one row per item with a rating array per dimension (no shuffle)."""
    return items.select(key, *[R.mean_of(c, policy).alias(d) for d, c in fields.items()])


def truth_means_long(
    ratings: DataFrame, policy: str, keys: tuple[str, ...] = ("item_id", "dim"), raw: str = "raw"
) -> DataFrame:
    """Mean and number of the kept ratings from the long form; groups without any kept rating give no row."""
    value = R.coerce(F.col(raw), policy)
    return (
        ratings.select(*keys, value.alias("_v"))
        .groupBy(*keys)
        .agg(R.mean_or_null(F.col("_v"), policy).alias("truth"), F.count("_v").alias("n_ratings"))
        .where(F.col("n_ratings") > 0)
    )


def pair_up(
    pred: DataFrame, truth: DataFrame, dims: list[str], key: str = "item_id", keep_unmatched: bool = False
) -> DataFrame:
    """Inner join of wide predictions and wide truths, then one row per dimension that both have.

    ``keep_unmatched`` keeps predictions without a truth, with a NULL truth.
    """
    has_trials = all(f"{d}_std" in pred.columns for d in dims)
    t = truth.select(key, *[F.col(d).alias(f"_t_{d}") for d in dims])
    cells = []
    for d in dims:
        fields = [F.lit(d).alias("dim"), F.col(d).alias("pred"), F.col(f"_t_{d}").alias("truth")]
        if has_trials:
            fields += [F.col(f"{d}_std").alias("trial_std"), F.col(f"{d}_count").alias("trial_count")]
        cells.append(F.struct(*fields))
    joined = pred.join(t, key, "left" if keep_unmatched else "inner").select(key, F.inline(F.array(*cells)))
    if keep_unmatched:
        return joined
    return joined.where(F.col("truth").isNotNull() & F.col("pred").isNotNull())


def coverage(pred: DataFrame, truth: DataFrame, key: str = "item_id") -> DataFrame:
    """How many items are on both sides, only predicted, only annotated: one row, counts only."""
    p = pred.select(key).distinct().withColumn("_p", F.lit(1))
    t = truth.select(key).distinct().withColumn("_t", F.lit(1))
    both = F.col("_p").isNotNull() & F.col("_t").isNotNull()
    return p.join(t, key, "full_outer").agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("_t").isNull()).alias("only_predicted"),
        F.count_if(F.col("_p").isNull()).alias("only_annotated"),
    )


def residuals(df: DataFrame, predictors: list[str], truth: str = "truth") -> DataFrame:
    """``<predictor>_residual = predictor - truth``."""
    return df.withColumns({f"{p}_residual": F.col(p) - F.col(truth) for p in predictors})


def merge_dimensions(long: DataFrame, dims: list[str], key: str = "item_id", value: str = "score") -> DataFrame:
    """Separate one-dimension answers to one row per item with all dimensions."""
    return long.groupBy(key).agg(*[F.max(F.when(F.col("dim") == d, F.col(value))).alias(d) for d in dims])


def merge_attempts(
    attempts: DataFrame,
    key: str = "item_id",
    attempt: str = "attempt",
    score: str = "score",
    response: str = "response",
    fallback: str | None = None,
    default: float = 3.0,
) -> DataFrame:
    """First usable attempt per item: a finite score, or 1 for an answer with ``N/A``; else the fallback, else 3.0."""
    s = F.col(score).cast("double")
    ok = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    usable = F.when(ok, s).when(F.contains(F.col(response), F.lit("N/A")), 1.0)
    aggs = [F.min_by(F.struct(usable.alias("s")), F.when(usable.isNotNull(), F.col(attempt))).alias("_first")]
    if fallback:
        aggs.append(F.max(fallback).alias("_fallback"))
    merged = attempts.groupBy(key).agg(*aggs, F.count("*").alias("n_attempts"))
    options = [F.col("_first.s")] + ([F.col("_fallback")] if fallback else []) + [F.lit(default)]
    return merged.select(
        key, F.coalesce(*options).alias("score"), F.col("_first.s").isNotNull().alias("succeeded"), "n_attempts"
    )


def first_source(df: DataFrame, sources: list[str]) -> Column:
    """First non-empty text among columns in order of preference, '' where all are empty."""
    return F.coalesce(*[F.nullif(F.col(s), F.lit("")) for s in sources], F.lit(""))


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items that have no stored result yet. Copies of a key are combined before the shuffle."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def rename_dims(df: DataFrame, rubric: str, dim: str = "dim") -> DataFrame:
    """Add the annotation field of each prediction dimension; an unknown dimension keeps its name."""
    names = dim_map(df.sparkSession).where(F.col("rubric") == rubric).select(F.col("dim").alias(dim), "gt_field")
    joined = df.join(F.broadcast(names), dim, "left")
    return joined.withColumn("gt_field", F.coalesce("gt_field", dim))


def validate(df: DataFrame, rubric: str, dim: str = "dim", score: str = "score") -> DataFrame:
    """Add ``reason``: why a score breaks the form of its dimension (missing, range, fraction, unknown), else NULL."""
    forms = dim_map(df.sparkSession).where(F.col("rubric") == rubric).select(F.col("dim").alias(dim), "lo", "hi")
    joined = df.join(F.broadcast(forms), dim, "left")
    reason = F.when(F.col("lo").isNull(), "unknown").otherwise(range_check(F.col(score), F.col("lo"), F.col("hi")))
    return joined.withColumn("reason", reason).drop("lo", "hi")


def result_records(items: DataFrame, outputs: DataFrame, fields: list[str], key: str = "item_id", dims: list[str] | None = None) -> DataFrame:
    """Dimension-result records: the item, the raw output, its score, and all ratings as a map.

    With ``dims`` the records are comprehensive: ``dimension_scores`` maps every dimension to its tagged score (NULL
    without a tag), and ``outputs`` needs ``(key, raw_model_output)`` only.

    ``outputs`` has ``(key, specific_dimension, raw_model_output, probability_score)``. Texts that are missing
    become '', rating lists that are missing become empty. The join is on the item key, never by position.
    """
    texts = [n for n in ("original_id", "char_profile", "char_style", "transcript", "local_scene") if n != key]
    ratings = F.create_map(
        *[
            x
            for f in [*fields, CONFIDENCE_FIELD]
            for x in (F.lit(f), F.coalesce(nested_or_top(items, f).cast("array<string>"), F.array().cast("array<string>")))
        ]
    )
    known = items.select(
        key,
        *[(F.coalesce(F.col(t), F.lit("")) if t in items.columns else F.lit("")).alias(t) for t in texts],
        ratings.alias("ground_truth_ratings"),
    )
    raw = F.col("raw_model_output")
    if dims:
        scores = F.transform_values(X.tagged_scores(raw, dims), lambda _, v: v.cast("double"))
        every = outputs.select(key, "raw_model_output", F.lit("comprehensive").alias("evaluation_type"), scores.alias("dimension_scores"))
        return every.join(known, key)
    scored = outputs.select(
        key, "specific_dimension", "raw_model_output", "probability_score",
        F.lit("specific_dimension").alias("evaluation_type"),
        X.answer_score(raw).alias("model_score"),
        F.coalesce(X.answer_text(raw), F.lit("No valid score found")).alias("evaluation_text"),
    )
    return scored.join(known, key)


def flatten_map(df: DataFrame, column: str, keys: list[str], prefix: str) -> DataFrame:
    """Map entries as columns ``<prefix><key>``, as CSV files need them."""
    return df.select(*[c for c in df.columns if c != column], *[F.col(column)[k].alias(f"{prefix}{k}") for k in keys])


def preview_rows(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows of a report in a given order."""
    return df.orderBy(*order).limit(n)
