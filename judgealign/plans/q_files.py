"""Registered queries: texts and summaries that go through files, bucketed truth, registered rewards."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.functions.scores import parse_scores
from judgealign.operators import align, moments, rewards
from judgealign.operators import prompts as P
from judgealign.plans import fixtures as X
from judgealign.plans import q_align as A
from judgealign.plans import reports
from judgealign.plans.fixtures import DIMS3, sql
from judgealign.plans.q_align import q6, rounded
from judgealign.session import shared_dir, ship_with_tasks
from judgealign.sources import readers, sinks

ship_with_tasks(__name__)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


# ---- prompt texts from files -----------------------------------------------------------------------------------------


@query("source_phrasings", sql("select dim, cast(ord as int) as ord, variant, name, description, scale_1, scale_2, scale_3, scale_4, scale_5 from phrasings", "phrasings"))
def source_phrasings(spark, sf):
    """Rubric phrasings written as JSON lines and read back."""
    base = shared_dir(spark, "phrasings")
    sinks.write_results(X.phrasings(spark, sf), f"{base}/phrasings.jsonl")
    return readers.read_phrasings(spark, f"{base}/phrasings.jsonl")


_RUBRIC = """select n_name as rubric, r_name as dim, cast(r_regionkey as int) as ord, v as version, concat(v, ' ', n_name, ' in ', r_name) as text
    from nation, region, (select unnest(['simple', 'detailed']) as v) as w where v = 'simple' or r_regionkey % 2 = 0"""


@query(
    "source_rubric_texts",
    f"""with t as ({_RUBRIC}) select c_custkey as item_id, coalesce(d.text, s.text, '') as prompt from customer left join region on r_regionkey = c_custkey % 5 and c_custkey % 7 <> 0
        left join t s on s.rubric = 'NATION_3' and s.version = 'simple' and s.dim = r_name
        left join t d on d.rubric = 'NATION_3' and d.version = 'detailed' and d.dim = s.dim""",
)
def source_rubric_texts(spark, sf):
    """A table of rubric texts written as JSON lines and read back; every item gets the detailed text of its dimension."""
    base = shared_dir(spark, "rubric")
    nation, region = X.table(spark, sf, "nation"), X.table(spark, sf, "region")
    versions = nation.select("n_name", F.explode(F.array(F.lit("simple"), F.lit("detailed"))).alias("version"))
    every = versions.select("n_name", "version", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r_regionkey")).join(region, "r_regionkey")
    rows = every.where("version = 'simple' or r_regionkey % 2 = 0").select(
        F.col("n_name").alias("rubric"), F.col("r_name").alias("dim"), F.col("r_regionkey").cast("int").alias("ord"), "version",
        F.concat("version", F.lit(" "), "n_name", F.lit(" in "), "r_name").alias("text"),
    )
    sinks.write_results(rows, f"{base}/rubric.jsonl")
    rubric = P.rubric_from_table(readers.read_rubric_table(spark, f"{base}/rubric.jsonl"), "NATION_3")
    names = F.create_map(*[F.lit(x) for k, name in region.select("r_regionkey", "r_name").collect() for x in (int(k), name)])  # five regions
    items = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 7 == 0, F.lit("NOWHERE")).otherwise(names[(F.col("c_custkey") % 5).cast("int")]).alias("dim"))
    return items.select("item_id", P.rubric_lookup(F.col("dim"), rubric, True).alias("prompt"))


@query(
    "source_choices",
    sql(
        """select audio_path, md5(concat(question_text, ' Please choose the answer from the following options: [''', array_to_string(multi_choice, ''', '''),
            ''']. Output the final answer in <answer> </answer>.')) as text_md5, concat('<answer>', multi_choice[answer + 1], '</answer>') as solution from choices""",
        "choices",
    ),
)
def source_choices(spark, sf):
    """Multiple-choice items read from JSON lines; the question keeps its own words."""
    base = shared_dir(spark, "choices")
    sinks.write_results(X.choices(spark, sf).drop("item_id"), f"{base}/items.jsonl")
    items = readers.read_mcq_items(spark, f"{base}/items.jsonl")
    text = P.choice_prompt(F.col("question_text"), F.col("multi_choice"), audio_words=False)
    return items.select("audio_path", F.md5(text).alias("text_md5"), P.choice_solution(F.col("multi_choice"), F.col("answer")).alias("solution"))


# ---- summaries as CSV ------------------------------------------------------------------------------------------------


def _through_csv(df: DataFrame, path: str) -> DataFrame:
    """A summary of a few rows as one CSV file with a header, read back with its own types."""
    sinks.write_csv(df, path, single_file=True)
    return df.sparkSession.read.option("header", True).option("enforceSchema", False).schema(df.schema).csv(path)


@query("sink_evaluation_summary", A.ORACLES["folder_report"])
def sink_evaluation_summary(spark, sf):
    """The comparison of both predictors per dimension, as the summary file of a report."""
    return _through_csv(A.folder_report(spark, sf), f"{shared_dir(spark, 'summary')}/evaluation_summary.csv")


@query("sink_prediction_statistics", A.ORACLES["describe_predictions"])
def sink_prediction_statistics(spark, sf):
    """The statistics of both score series, as the summary file of a report."""
    return _through_csv(A.describe_predictions(spark, sf), f"{shared_dir(spark, 'statistics')}/prediction_statistics_summary.csv")


# ---- truth that stays where it is ------------------------------------------------------------------------------------


def bucketed_pairs(spark, sf) -> DataFrame:
    """Means of judge trials against a truth table that was bucketed by item once."""
    base = shared_dir(spark, "truth")
    truth = align.truth_means_wide(X.ann_wide(spark, sf), DIMS3, "fill1")
    kept = sinks.write_bucketed(truth, f"truth_{uuid.uuid4().hex}", f"{base}/truth", "item_id")
    pred = align.trial_means(parse_scores(X.judge(spark, sf), DIMS3), DIMS3)
    return align.pair_up(pred, kept, DIMS3)


@query(
    "align_bucketed_truth",
    sql(f"select dim, count(*) as n, {q6('corr(pred, truth)')} as pearson, {q6('avg(abs(pred - truth))')} as mae from pooled group by dim", "pairs", pooled=A._POOLED),
)
def align_bucketed_truth(spark, sf):
    """Agreement where only the judge's side is shuffled."""
    return rounded(moments.agreement(bucketed_pairs(spark, sf), ["dim"]).select("dim", "n", "pearson", "mae"), "pearson", "mae")


# ---- registered rewards ----------------------------------------------------------------------------------------------


def _brief(completion: pd.Series, solution: pd.Series) -> pd.Series:
    """A user's own reward: 1 for an answer that is at most twice as long as the solution, falling from there."""
    room = 2.0 * solution.fillna("").str.len().clip(lower=1)
    return (room / completion.fillna("").str.len().clip(lower=1)).clip(upper=1.0)


@query(
    "reward_registered",
    sql(
        f"""select c.prompt_id, c.gen_id, {q6("least(1.0, 2.0 * greatest(length(s.solution), 1) / greatest(length(c.completion), 1))")} as reward_brief,
            cast(regexp_matches(c.completion, 'answer') as int) + 0e0 as reward_tagged from completions c join solutions s using (prompt_id)""",
        "completions", "solutions",
    ),
)
def reward_registered(spark, sf):
    """Two rewards that a user registers: a pandas function and an expression."""
    rewards.register_reward("brief", lambda c, s: F.pandas_udf(_brief, "double")(c, s))
    rewards.register_reward("tagged", lambda c, s: c.contains("answer").cast("double"))
    rows = X.completions(spark, sf).join(X.solutions(spark, sf), "prompt_id")
    out = rewards.add_rewards(rows, ["brief", "tagged"], {"tagged": 0.5})
    return rounded(out.select("prompt_id", "gen_id", "reward_brief", "reward_tagged"), "reward_brief")
