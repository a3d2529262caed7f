"""Registered queries: resumed evaluation and running metrics over arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.operators.judge import run_judge
from judgealign.plans import fixtures as X
from judgealign.plans import q_align as A
from judgealign.plans import q_corpus as C
from judgealign.plans.fixtures import sql
from judgealign.plans.q_align import q6, rounded
from judgealign.session import shared_dir, ship_with_tasks
from judgealign.streaming import incremental

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


# ---- resumed evaluation ----------------------------------------------------------------------------------------------

_PROMPT = "concat('Rate ', event_type, ' of user ', cast(user_id as varchar), ' in ', cast(event_id as varchar))"
_STEPS = """with e as (select event_id, length({p}) as len from events),
    a as (select count(*) as n, count(*) filter (event_id % 3 = 0) as third,
        cast(sum(case when len % 17 = 0 then 0 else 1 + len % 5 end) as bigint) as total,
        cast(coalesce(sum(case when len % 17 = 0 then 0 else 1 + len % 5 end) filter (event_id % 3 = 0), 0) as bigint) as total_third from e)
    select * from (
        select 'batch' as step, third as arrived, third as judged, third as stored, total_third as score_sum from a
        union all select 'stream', n, n - third, n, total from a
        union all select 'replay', n, 0, n, total from a
        union all select 'batch again', n, 0, n, total from a)"""


@query("resume_judge_calls", _STEPS.format(p=_PROMPT))
def resume_judge_calls(spark, sf):
    """Judge calls of a batch over a third of the items, a stream over all, its replay, and a batch over all once more."""
    base = shared_dir(spark, "resume")
    out = f"{base}/out"
    done: list[tuple] = []

    def requests(rows: DataFrame) -> DataFrame:
        prompt = F.concat(F.lit("Rate "), "event_type", F.lit(" of user "), F.col("user_id").cast("string"), F.lit(" in "), F.col("event_id").cast("string"))
        return rows.select(F.col("event_id").alias("item_id"), prompt.alias("prompt"), F.lit("").alias("audio_path"))

    def evaluate(fresh: DataFrame) -> DataFrame:
        return run_judge(fresh, C._open_stub, "stub").select("item_id", F.try_to_number("response", F.lit("9")).cast("long").alias("score"))

    def finish(step: str, counts: list[incremental.Counts]) -> None:
        score = F.coalesce(F.sum("score"), F.lit(0))
        n, total = incremental.stored(spark, out, schema).agg(F.count(F.lit(1)), score).first()
        done.append((step, sum(c.arrived for c in counts), sum(c.judged for c in counts), n, total))

    events = X.table(spark, sf, "events")
    schema = spark.createDataFrame([], "item_id long, score long").schema
    finish("batch", [incremental.evaluate_pending(requests(events.where("event_id % 3 = 0")), out, evaluate)])
    for step in ("stream", "replay"):  # each has a checkpoint of its own, so it sees every file
        counts: list[incremental.Counts] = []
        stream = requests(C._stream(spark, sf, "events"))
        incremental.run_increment(stream, out, f"{base}/cp-{step}", evaluate, on_batch=lambda number, c, to=counts: to.append(c)).awaitTermination()
        finish(step, counts)
    finish("batch again", [incremental.evaluate_pending(requests(events), out, evaluate)])
    return spark.createDataFrame(done, "step string, arrived long, judged long, stored long, score_sum long")


# ---- running metrics of all kinds ------------------------------------------------------------------------------------


def _arriving(spark, rows: DataFrame, base: str, files: int) -> DataFrame:
    """The rows as a stream of so many part files, one per batch."""
    rows.repartition(files).write.parquet(f"{base}/in")
    return incremental.stream_rows(spark, f"{base}/in", rows.schema, "parquet", files=1)


_RUNNING = """select dim, pred, truth from dimres_pairs union all select 'OVERALL', pred, truth from dimres_pairs"""
_DIMRES_PAIRS = "select dim, probability_score as pred, cast(r1 as double) as truth from dimres"


@query(
    "stream_rank_metrics",
    sql(
        f"""select m.dim, m.n, {q6('m.pearson')} as pearson, {q6('m.mae')} as mae, {q6('m.spearman')} as spearman, t.kendall
            from (select dim, count(*) as n, corr(pred, truth) as pearson, avg(abs(pred - truth)) as mae, corr(rp, rg) as spearman from ranked group by dim) m
            join (select dim, {q6('(c.conc - c.disc) / (sqrt(n.n0 - tx.t) * sqrt(n.n0 - ty.t))')} as kendall
                from n join c using (dim) join tx using (dim) join ty using (dim)) t using (dim)""",
        "dimres",
        dimres_pairs=_DIMRES_PAIRS,
        pooled=_RUNNING,
        ranked=A._RANKED.replace("select dim,", "select dim, pred, truth,", 1),
        **A.TAU_PARTS,
    ),
)
def stream_rank_metrics(spark, sf):
    """Pearson, Spearman and Kendall over four arriving batches of pairs, folded after every second one."""
    base = shared_dir(spark, "running-ranks")
    pairs = X.table(spark, sf, "events").select(
        F.col("event_type").alias("dim"), F.expr("round(1 + (value - 4 * floor(value / 4)), 4)").alias("pred"),
        F.expr("cast(1 + (event_id + user_id) % 5 as double)").alias("truth"),
    )
    incremental.run_pairs(_arriving(spark, pairs, base, 4), f"{base}/out", f"{base}/cp", ["dim"], fold_every=2).awaitTermination()
    # four decimals on a scale of 1 to 5: at most 40,000 values per group
    out = incremental.running_agreement(spark, f"{base}/out", ["dim"], bounded=True)
    return rounded(out.select("dim", "n", "pearson", "mae", "spearman", "kendall"), "pearson", "mae", "spearman", "kendall")


@query(
    "stream_auc",
    f"""with s as (select event_type as dim, round(value, 1) as v, case when (event_id * 7 + user_id) % 3 = 0 then 1 else 0 end as label from events),
        c as (select dim, v, sum(label) as n1, count(*) - sum(label) as n0 from s group by dim, v),
        r as (select *, coalesce(sum(n0) over (partition by dim order by v rows between unbounded preceding and 1 preceding), 0) as low from c)
        select dim, cast(sum(n1) as bigint) as positives, cast(sum(n0) as bigint) as negatives,
            {q6('sum(n1 * (low + n0 / 2)) / nullif(cast(sum(n1) as double) * sum(n0), 0)')} as auc from r group by dim""",
)
def stream_auc(spark, sf):
    """ROC AUC over three arriving batches."""
    base = shared_dir(spark, "running-auc")
    scored = X.table(spark, sf, "events").select(
        F.col("event_type").alias("dim"), F.round("value", 1).alias("score"),
        F.when((F.col("event_id") * 7 + F.col("user_id")) % 3 == 0, 1).otherwise(0).alias("label"),
    )
    incremental.run_classes(_arriving(spark, scored, base, 3), f"{base}/out", f"{base}/cp", ["dim"]).awaitTermination()
    return rounded(incremental.running_auc(spark, f"{base}/out", ["dim"]), "auc")
