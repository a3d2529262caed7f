"""Pass/fail votes and binary classification metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.functions.ratings import coerce, majority
from judgealign.operators.ranks import auc_of, class_counts


def vote_counts(votes: DataFrame, key: str = "item_id", vote: str = "vote", policy: str = "fill1_bool") -> DataFrame:
    """Passes, fails and total of the kept votes per item (text votes go through a rating policy)."""
    v = F.col(vote)
    if dict(votes.dtypes)[vote] == "boolean":
        value = F.when(v, 1.0).when(~v, 0.0)
        if not policy.startswith("drop"):
            value = F.coalesce(value, F.lit(1.0))
    else:
        value = coerce(v, policy, gate=True)
    return votes.select(key, value.alias("_v")).groupBy(key).agg(
        F.count_if(F.col("_v") == 1).alias("passes"),
        F.count_if(F.col("_v") == 0).alias("fails"),
        F.count("_v").alias("votes"),
    )


def majority_vote(counts: DataFrame, tie: str) -> DataFrame:
    """Add ``label``: 1 pass, 0 fail, NULL for a tie under ``tie="null"``. Items without votes are dropped."""
    label = majority(F.col("passes"), F.col("fails"), F.col("votes"), tie)
    return counts.where(F.col("votes") > 0).withColumn("label", label)


def _confusion(counts: DataFrame, keys: list[str]) -> DataFrame:
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *keys, (tp + fp + tn + fn).alias("n"), "tp", "fp", "tn", "fn",
        ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
    )


def confusion(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """tp, fp, tn, fn, accuracy, precision, recall, f1 per group; a zero denominator gives 0."""
    p, g = F.col(score) >= threshold, F.col(label)
    counts = scored.where(F.col(score).isNotNull() & g.isNotNull()).groupBy(*keys).agg(
        F.count_if(p & (g == 1)).alias("tp"),
        F.count_if(p & (g == 0)).alias("fp"),
        F.count_if(~p & (g == 0)).alias("tn"),
        F.count_if(~p & (g == 1)).alias("fn"),
    )
    return _confusion(counts, keys)


def classification(
    scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5,
    bounded: bool = False,
) -> DataFrame:
    """Confusion metrics and ROC AUC per group, both from the same compressed table of score values.

    ``bounded`` says that there is a bounded number of score values.
    """
    values = class_counts(scored, keys, score, label, bounded)
    p = F.col("v") >= threshold
    counts = values.df.groupBy(*keys).agg(
        F.sum(F.when(p, F.col("n1")).otherwise(0)).alias("tp"),
        F.sum(F.when(p, F.col("n0")).otherwise(0)).alias("fp"),
        F.sum(F.when(~p, F.col("n0")).otherwise(0)).alias("tn"),
        F.sum(F.when(~p, F.col("n1")).otherwise(0)).alias("fn"),
    )
    return _confusion(counts, keys).join(auc_of(values, keys).select(*keys, "auc"), keys, "left")


def confusion_matrix(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", threshold: float = 0.5) -> DataFrame:
    """Counts per true and predicted class."""
    predicted = F.when(F.col(score) >= threshold, 1).otherwise(0)
    return (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(*keys, F.col(label).cast("int").alias("truth"), predicted.alias("predicted"))
        .agg(F.count("*").alias("n"))
    )


def per_label_accuracy(df: DataFrame, keys: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Accuracy and count per true score, plus ``overall`` (by rows) and ``average`` (over the labels)."""
    hit = (F.col(pred) == F.col(truth)).cast("int")
    per = df.groupBy(*keys, F.col(truth).cast("string").alias("label")).agg(
        F.sum(F.coalesce(hit, F.lit(0))).alias("_hits"), F.count("*").alias("n")
    )
    acc = F.col("_hits") / F.col("n")
    # each label row also counts for the two summaries, so the rows behind are read once
    rows = per.select(
        *keys, F.explode(F.array("label", F.lit("overall"), F.lit("average"))).alias("label"), "_hits", "n", acc.alias("_acc")
    )
    by_rows = F.sum("_hits") / F.sum("n")
    return rows.groupBy(*keys, "label").agg(
        F.when(F.col("label") == "average", F.avg("_acc")).otherwise(by_rows).alias("accuracy"), F.sum("n").alias("n")
    )
