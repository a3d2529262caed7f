"""Completion rewards, their weighted sum, and group-normalised advantages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions.text import strip_blank


def _body(text: Column) -> Column:
    """Body of the first one-line answer tag, else the whole text; without outer blanks."""
    pattern = r"<answer>(.*?)</answer>"
    return strip_blank(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def accuracy_reward(completion: Column, solution: Column) -> Column:
    """1.0 where the answer bodies are equal, else 0.0."""
    return F.when(_body(completion) == _body(solution), 1.0).otherwise(0.0)


def format_reward(completion: Column, solution: Column | None = None) -> Column:
    """1.0 where the whole completion is one answer span, else 0.0."""
    return F.when(completion.rlike(r"(?s)^<answer>.*?</answer>\z"), 1.0).otherwise(0.0)


REWARDS: dict[str, Callable[[Column, Column], Column]] = {"accuracy": accuracy_reward, "format": format_reward}


def register_reward(name: str, builder: Callable[[Column, Column], Column]) -> None:
    """Add a reward: a builder of a Column from (completion, solution), for example around a pandas UDF."""
    REWARDS[name] = builder


def add_rewards(df: DataFrame, names: list[str], weights: dict[str, float] | None = None,
                completion: str = "completion", solution: str = "solution") -> DataFrame:
    """One column ``reward_<name>`` per reward and their weighted sum ``reward``; undefined ones count as nothing."""
    built = {f"reward_{n}": REWARDS[n](F.col(completion), F.col(solution)) for n in names}
    weights = weights or {}
    total = sum(
        (F.coalesce(F.nanvl(F.col(f"reward_{n}"), F.lit(None)), F.lit(0.0)) * float(weights.get(n, 1.0)) for n in names),
        F.lit(0.0),
    )
    return df.withColumns(built).withColumn("reward", total)


def group_stats(df: DataFrame, group: str = "prompt_id", reward: str = "reward") -> DataFrame:
    return df.groupBy(group).agg(F.avg(reward).alias("group_mean"), F.stddev_samp(reward).alias("group_std"))


def advantages(df: DataFrame, group: str = "prompt_id", reward: str = "reward", scale: bool = True) -> DataFrame:
    """``(reward - group mean) / (group deviation + 1e-4)``.

    Group statistics are aggregated map-side and joined back, so a prompt with very many completions is not
    gathered in one task (adaptive execution splits its side of the join).
    """
    joined = df.join(group_stats(df, group, reward), group)
    gap = F.col(reward) - F.col("group_mean")
    return joined.withColumn("advantage", gap / (F.col("group_std") + 1e-4) if scale else gap)


def reward_means(df: DataFrame, names: list[str], group: str = "prompt_id") -> DataFrame:
    """Mean per reward over the rows where it is defined, mean total reward, mean group deviation: one row."""
    per_group = df.groupBy(group).agg(
        *[F.sum(F.nanvl(F.col(f"reward_{n}"), F.lit(None))).alias(f"_s_{n}") for n in names],
        *[F.count(F.nanvl(F.col(f"reward_{n}"), F.lit(None))).alias(f"_c_{n}") for n in names],
        F.sum("reward").alias("_s"),
        F.count("reward").alias("_c"),
        F.stddev_samp("reward").alias("_d"),
    )
    return per_group.agg(
        *[F.try_divide(F.sum(f"_s_{n}"), F.sum(f"_c_{n}")).alias(f"mean_{n}") for n in names],
        F.try_divide(F.sum("_s"), F.sum("_c")).alias("mean_reward"),
        F.avg("_d").alias("mean_group_std"),
    )
