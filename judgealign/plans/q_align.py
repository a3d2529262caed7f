"""Registered queries: alignment, policies, metrics, votes, statistics. Each has its SQL twin next to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.functions import ratings as R
from judgealign.functions.keys import result_key
from judgealign.functions.scores import parse_scores
from judgealign.functions.stats import p_value
from judgealign.operators import align, classify, describe, moments, ranks
from judgealign.operators.kendall import kendall
from judgealign.plans import fixtures as X
from judgealign.plans import reports
from judgealign.plans.fixtures import DIMS3, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def q6(expr: str) -> str:
    return f"round({expr}, 6) + 0e0"


# ---- the aligned pairs of the trial report --------------------------------------------------------------------


def trial_wide(spark, sf) -> DataFrame:
    return align.trial_means(parse_scores(X.judge(spark, sf), DIMS3), DIMS3)


def trial_pairs(spark, sf) -> DataFrame:
    truth = align.truth_means_wide(X.ann_wide(spark, sf), DIMS3, "fill1")
    return align.pair_up(trial_wide(spark, sf), truth, DIMS3)


_POOLED = "select dim, pred, truth from pairs union all select 'OVERALL', pred, truth from pairs"
_TRIAL_METRICS = f"""select dim, count(*) as n,
    {q6('case when stddev_pop(pred) > 0 and stddev_pop(truth) > 0 then corr(pred, truth) end')} as pearson,
    {q6('avg(abs(pred - truth))')} as mae, {q6('sqrt(avg((pred - truth) * (pred - truth)))')} as rmse"""


@query(
    "align_trials_by_dim",
    sql(f"{_TRIAL_METRICS} from pooled group by dim", "pairs", pooled=_POOLED),
)
def align_trials_by_dim(spark, sf):
    """Parse, trial mean, truth mean, join, agreement per dimension and pooled (flagship)."""
    out = moments.agreement(trial_pairs(spark, sf), ["dim"])
    return rounded(out.select("dim", "n", "pearson", "mae", "rmse"), "pearson", "mae", "rmse")


_RANKED = """select dim, rank() over (partition by dim order by pred) + (count(*) over (partition by dim, pred) - 1) / 2.0 as rp,
    rank() over (partition by dim order by truth) + (count(*) over (partition by dim, truth) - 1) / 2.0 as rg from pooled"""


@query(
    "align_spearman",
    sql(f"select dim, count(*) as n, {q6('corr(rp, rg)')} as spearman from ranked group by dim", "pairs", pooled=_POOLED, ranked=_RANKED),
)
def align_spearman(spark, sf):
    """Means of three trials on a rating scale: a bounded number of values."""
    cells = ranks.count_pairs(trial_pairs(spark, sf), ["dim"], bounded=True)
    return rounded(ranks.spearman(cells, ["dim"]), "spearman")


#: tau-b by joining compressed cells with each other, from a view ``pooled``.
TAU_PARTS = {
    "cells": "select dim, pred as x, truth as y, count(*) as k from pooled group by dim, pred, truth",
    "n": "select dim, cast(sum(k) as bigint) as n, cast(sum(k) as double) * (sum(k) - 1) / 2 as n0 from cells group by dim",
    "tx": "select dim, sum(cast(k as double) * (k - 1) / 2) as t from (select dim, x, sum(k) as k from cells group by dim, x) group by dim",
    "ty": "select dim, sum(cast(k as double) * (k - 1) / 2) as t from (select dim, y, sum(k) as k from cells group by dim, y) group by dim",
    "c": """select a.dim, coalesce(sum(case when b.y > a.y then cast(a.k as double) * b.k end), 0) as conc,
            coalesce(sum(case when b.y < a.y then cast(a.k as double) * b.k end), 0) as disc
         from cells a join cells b on a.dim = b.dim and b.x > a.x group by a.dim""",
}


def _tau_sql(source_views: tuple[str, ...], pooled: str) -> str:
    return sql(
        f"""select n.dim, n.n, {q6('(c.conc - c.disc) / (sqrt(n.n0 - tx.t) * sqrt(n.n0 - ty.t))')} as kendall
            from n join c using (dim) join tx using (dim) join ty using (dim)""",
        *source_views,
        pooled=pooled,
        **TAU_PARTS,
    )


@query("align_kendall", _tau_sql(("pairs",), _POOLED))
def align_kendall(spark, sf):
    """Means of three trials on a rating scale: a bounded number of values."""
    cells = ranks.count_pairs(trial_pairs(spark, sf), ["dim"], bounded=True)
    return rounded(kendall(cells, ["dim"]).select("dim", "n", "kendall"), "kendall")


_PROB_POOLED = """select dim, probability_score as pred, truth from dimres_truth
    union all select 'OVERALL', probability_score, truth from dimres_truth"""


@query("align_kendall_continuous", _tau_sql(("dimres_truth",), _PROB_POOLED))
def align_kendall_continuous(spark, sf):
    """Scores of four decimals on a scale of 1 to 5: at most 40,000 values per group, however large the table."""
    pairs = X.dimres_truth(spark, sf).withColumnRenamed("probability_score", "pred")
    cells = ranks.count_pairs(pairs, ["dim"], bounded=True)
    return rounded(kendall(cells, ["dim"]).select("dim", "n", "kendall"), "kendall")


_R2 = "1 - sum((truth - pred) * (truth - pred)) / nullif(sum((truth - m) * (truth - m)), 0)"


@query(
    "align_mape_r2",
    sql(
        f"select dim, count(*) as n, {q6('avg(abs((pred - truth) / truth)) * 100')} as mape, {q6('avg((pred - truth) * (pred - truth))')} as mse, {q6(_R2)} as r2 from centred group by dim",
        "pairs",
        pooled=_POOLED,
        centred="select *, avg(truth) over (partition by dim) as m from pooled",
    ),
)
def align_mape_r2(spark, sf):
    out = moments.agreement(trial_pairs(spark, sf), ["dim"]).select("dim", "n", "mape", "mse", "r2")
    return rounded(out, "mape", "mse", "r2")


@query(
    "trial_consistency",
    sql(
        f"select dim, {q6('avg(trial_std)')} as trial_std_mean, {q6('stddev_pop(trial_std)')} as trial_std_std, {q6('avg(trial_count)')} as trial_count_mean from pairs group by dim",
        "pairs",
    ),
)
def trial_consistency(spark, sf):
    out = reports.trial_consistency(trial_pairs(spark, sf))
    return rounded(out, "trial_std_mean", "trial_std_std", "trial_count_mean")


@query(
    "trial_summary",
    sql(
        f"""select {q6('c.a')} as avg_trial_count, {q6('c.s')} as std_trial_count, {q6('d.m')} as avg_std_across_dimensions
        from (select avg(trial_count) as a, stddev_pop(trial_count) as s from pred_long where dim = 'quality') c,
             (select avg(m) as m from (select dim, avg(trial_std) as m from pairs group by dim)) d""",
        "pairs",
    ),
)
def trial_summary(spark, sf):
    """Trial counts over all items, matched or not, and the mean deviation over dimensions."""
    truth = align.truth_means_wide(X.ann_wide(spark, sf), DIMS3, "fill1")
    everything = align.pair_up(trial_wide(spark, sf), truth, DIMS3, keep_unmatched=True)
    return rounded(reports.trial_summary(everything, "quality"), "avg_trial_count", "std_trial_count", "avg_std_across_dimensions")


@query(
    "trial_means",
    sql(f"select item_id, dim, {q6('pred')} as pred, {q6('trial_std')} as trial_std, trial_count from pred_long", "pred_long"),
)
def trial_means(spark, sf):
    wide = trial_wide(spark, sf)
    cells = [
        F.struct(F.lit(d).alias("dim"), F.col(d).alias("pred"), F.col(f"{d}_std").alias("trial_std"), F.col(f"{d}_count").alias("trial_count"))
        for d in DIMS3
    ]
    return rounded(wide.select("item_id", F.inline(F.array(*cells))), "pred", "trial_std")


@query(
    "parse_int_mode",
    sql(
        r"""select item_id, trial, cast(case when j is null then 1 else coalesce(trunc(try_cast(j->>'$.quality' as double)), 1) end as double) as quality,
            cast(case when j is null then 1 else coalesce(trunc(try_cast(j->>'$.emphasis' as double)), 1) end as double) as emphasis,
            cast(case when j is null then 1 else coalesce(trunc(try_cast(j->>'$.fit' as double)), 1) end as double) as fit
        from (select item_id, trial, try_cast(trim(regexp_replace(regexp_replace(response, '```json\s*', '', 'g'), '```\s*', '', 'g')) as json) as j from judge)""",
        "judge",
    ),
)
def parse_int_mode(spark, sf):
    return parse_scores(X.judge(spark, sf), DIMS3, mode="int").select("item_id", "trial", *DIMS3)


@query(
    "file_keys",
    sql("select item_id, trial, replace(split_part(audio_path, '/', -1), '.wav', '') as file_id from judge", "judge"),
)
def file_keys(spark, sf):
    return X.judge(spark, sf).select("item_id", "trial", result_key(F.col("audio_path"), F.lit("")).alias("file_id"))


@query(
    "join_coverage",
    """select count(*) filter (where p.k is not null and t.k is not null) as matched,
         count(*) filter (where t.k is null) as only_predicted, count(*) filter (where p.k is null) as only_annotated
       from (select distinct o_orderkey as k from orders) p full outer join (select distinct l_orderkey as k from lineitem) t on p.k = t.k""",
)
def join_coverage(spark, sf):
    return align.coverage(
        X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id")),
        X.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item_id")),
    )


@query(
    "last_line_wins",
    """select user_id, event_id, event_type, value from
       (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""",
)
def last_line_wins(spark, sf):
    events = X.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return align.last_wins(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "legacy_annotators",
    sql(
        f"""select id, dim, {q6('(cast(r1 as double) + coalesce(r2, 0) + r3) / (case when r2 is null then 2 else 3 end)')} as truth,
            cast(case when r2 is null then 2 else 3 end as int) as n_ratings from dimres""",
        "dimres",
    ),
)
def legacy_annotators(spark, sf):
    """Annotator columns to a rating list per dimension."""
    flat = X.dimres(spark, sf).withColumnsRenamed(
        {"r1": "annotation0_score", "r2": "annotation1_score", "r3": "final0_score"}
    )
    [score] = align.legacy_ratings(flat, {"score": "score"}, ["annotation0_", "annotation1_", "annotation2_", "final0_"])
    out = flat.select("id", "dim", score)
    return rounded(out.select("id", "dim", R.mean_of(F.col("score"), "fill1").alias("truth"), F.size("score").alias("n_ratings")), "truth")


# ---- rating policies -------------------------------------------------------------------------------------------

_COERCED = {
    "fill1": "case when raw is null or upper(raw) = 'N/A' then 1.0 else cast(raw as double) end",
    "fill1_bool": "case when raw is null or upper(raw) = 'N/A' then 1.0 else cast(raw as double) end",
    "drop_null": "case when raw is null then null when raw = 'N/A' then 'nan'::double else cast(raw as double) end",
    "drop_null_na1": "case when raw is null then null when raw = 'N/A' then 1.0 else cast(raw as double) end",
    "drop_null_na1_gate": "case when raw is null then null when raw = 'N/A' then 1.0 else cast(raw as double) end",
    "fewshot_avg": "case when raw is null or raw = 'N/A' then 1.0 else cast(raw as double) end",
}


def _policy(name: str):
    mean = "case when count(v) filter (where isnan(v)) > 0 then null else avg(v) end"
    mean = f"round_even({mean}, 0)" if name == "fewshot_avg" else mean
    oracle = sql(
        f"select item_id, dim, {q6(mean)} as truth, count(v) as n_ratings from (select item_id, dim, {_COERCED[name]} as v from ann_long) group by item_id, dim having count(v) > 0",
        "ann_long",
    )

    @query(f"ratings_policy_{name}", oracle)
    def run(spark, sf):
        return rounded(align.truth_means_long(X.ann_long(spark, sf), name), "truth")


for _name in R.POLICIES:
    _policy(_name)


# ---- two predictors: folder report --------------------------------------------------------------------------------

_PP = """select predictor, dim, pred, truth from predictor_pairs where pred is not null
    union all select predictor, 'OVERALL', pred, truth from predictor_pairs where pred is not null"""
_PR = """select *, rank() over (partition by predictor, dim order by pred) + (count(*) over (partition by predictor, dim, pred) - 1) / 2.0 as rp,
    rank() over (partition by predictor, dim order by truth) + (count(*) over (partition by predictor, dim, truth) - 1) / 2.0 as rg from pp"""
_PM = """select predictor, dim, count(*) as n, corr(pred, truth) as pearson, corr(rp, rg) as spearman, avg(abs(pred - truth)) as mae,
    sqrt(avg((pred - truth) * (pred - truth))) as rmse from pr group by predictor, dim"""


def folder_pairs(spark, sf) -> DataFrame:
    return reports.predictor_pairs(X.dimres_truth(spark, sf))


def _better(m: str, op: str, fn: str = "") -> str:
    return f"case when {fn}(m.{m}) {op} {fn}(p.{m}) then 'Model' else 'Probability' end as better_{m}"


@query(
    "folder_report",
    sql(
        "select m.dim, greatest(m.n, p.n) as count, "
        + ", ".join(f"{q6(f'{t}.{m}')} as {n}_{m}" for m in ("pearson", "spearman", "mae", "rmse") for t, n in (("m", "model"), ("p", "prob")))
        + ", " + ", ".join([_better("pearson", ">", "abs"), _better("spearman", ">", "abs"), _better("mae", "<"), _better("rmse", "<")])
        + " from pm m join pm p on m.dim = p.dim and m.predictor = 'Model' and p.predictor = 'Probability'",
        "predictor_pairs", pp=_PP, pr=_PR, pm=_PM,
    ),
)
def folder_report(spark, sf):
    """Both predictors (of at most four decimals) against the truth, per dimension and pooled, with winner flags."""
    report = reports.agreement_report(folder_pairs(spark, sf), ["predictor", "dim"], bounded=True)
    wide = reports.compare_predictors(report, ["pearson", "spearman"], ["mae", "rmse"])
    return rounded(wide, *[f"{t}_{m}" for m in ("pearson", "spearman", "mae", "rmse") for t in ("model", "prob")])


@query(
    "metric_summary",
    sql(
        f"select metric, {q6('avg(v)')} as mean, {q6('stddev_pop(v)')} as std, count(*) as dims from (select unnest(['pearson', 'spearman', 'mae', 'rmse']) as metric, unnest([pearson, spearman, mae, rmse]) as v from pm where dim <> 'OVERALL' and predictor = 'Model') group by metric",
        "predictor_pairs", pp=_PP, pr=_PR, pm=_PM,
    ),
)
def metric_summary(spark, sf):
    pairs = folder_pairs(spark, sf).where(F.col("predictor") == "Model").drop("predictor")
    report = reports.agreement_report(pairs, ["dim"], bounded=True)
    return rounded(reports.summarise_metrics(report, ["pearson", "spearman", "mae", "rmse"]), "mean", "std")


@query(
    "heatmap_table",
    sql(
        f"select dim, metric, {q6('v')} as value from (select dim, unnest(['pearson', 'spearman']) as metric, unnest([pearson, spearman]) as v from pm where dim <> 'OVERALL' and predictor = 'Model')",
        "predictor_pairs", pp=_PP, pr=_PR, pm=_PM,
    ),
)
def heatmap_table(spark, sf):
    pairs = folder_pairs(spark, sf).where(F.col("predictor") == "Model").drop("predictor")
    return rounded(reports.heatmap(reports.agreement_report(pairs, ["dim"], bounded=True), ["pearson", "spearman"]), "value")


@query(
    "correlation_p_values",
    # P(|R| > |r|) = 2 * integral of cos(t)^(n-3) over asin|r| .. pi/2, divided by Beta(1/2, (n-2)/2); Simpson's rule
    sql(
        f"""select predictor, dim, n, {q6('''sum(w * pow(greatest(cos(a + i * h), 0), n - 3)) * h / 3 * 2
              / exp(lgamma(0.5) + lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0))''')} as pearson_p
            from (select predictor, dim, n, asin(abs(pearson)) as a, (pi() / 2 - asin(abs(pearson))) / 20000 as h from pm) s,
                 (select i, case when i = 0 or i = 20000 then 1 when i % 2 = 1 then 4 else 2 end as w from range(20001) t(i)) g
            group by predictor, dim, n, h""",
        "predictor_pairs", pp=_PP, pr=_PR, pm=_PM,
    ),
)
def correlation_p_values(spark, sf):
    pairs = folder_pairs(spark, sf).where(F.col("pred").isNotNull())
    out = moments.agreement(pairs, ["predictor", "dim"])
    return rounded(out.select("predictor", "dim", "n", p_value(F.col("pearson"), F.col("n")).alias("pearson_p")), "pearson_p")


@query(
    "residuals",
    sql(
        f"select id, dim, {q6('model_score - truth')} as model_score_residual, {q6('probability_score - truth')} as probability_score_residual from dimres_truth",
        "dimres_truth",
    ),
)
def residuals(spark, sf):
    out = align.residuals(X.dimres_truth(spark, sf), ["model_score", "probability_score"])
    return rounded(
        out.select("id", "dim", "model_score_residual", "probability_score_residual"),
        "model_score_residual", "probability_score_residual",
    )


@query(
    "model_vs_probability",
    sql(
        f"select dim, count(*) as n, {q6('corr(model_score, probability_score)')} as pearson from (select dim, model_score, probability_score from dimres where model_score is not null union all select 'OVERALL', model_score, probability_score from dimres where model_score is not null) group by dim",
        "dimres",
    ),
)
def model_vs_probability(spark, sf):
    pairs = X.dimres(spark, sf).where(F.col("model_score").isNotNull())
    sums = moments.with_overall(moments.moments(pairs, ["dim"], "model_score", "probability_score"), ["dim"])
    return rounded(moments.metrics(sums).select("dim", "n", "pearson"), "pearson")


# folder rows: own ratings r1, r2, N/A-able r3 (or one null), plus a second rated dimension
_FOLDER = """select *, list_filter([v1, v2, v3], lambda x: x is not null) as vals from folder_rows where not no_own"""


@query(
    "folder_records",
    sql(
        f"""select cast(id as varchar) as id, concat('dim_', dim, '.json') as source_file, dim, cast(model_score as double) as model_score,
            probability_score, {q6('list_avg(vals)')} as truth, cast(len(vals) as int) as n_ratings,
            concat(substr(concat('profile ', id, ' of ', repeat('a long story ', cast(id % 6 as int))), 1, 50), '...') as character,
            {q6('list_avg(vals)')} as gt_avg_own, {q6('(coalesce(r2, 0) + cast(r3 as double)) / (case when r2 is null then 1 else 2 end)')} as gt_avg_story,
            cast(2 as int) as n_averages
        from f""",
        "folder_rows", f=_FOLDER,
    ),
)
def folder_records(spark, sf):
    """Records with a usable truth, averages of every rated dimension, profile preview."""
    rows = reports.prepare_folder(X.folder_results(spark, sf), "drop_null_na1", {"none": "none"})
    out = rows.select(
        "id", "source_file", "dim", "model_score", "probability_score", "truth", "n_ratings", "character",
        F.col("gt_avg")[F.col("dim")].alias("gt_avg_own"), F.col("gt_avg")["story"].alias("gt_avg_story"),
        F.size("gt_avg").alias("n_averages"),
    )
    return rounded(out, "truth", "gt_avg_own", "gt_avg_story")


# ---- pass/fail gate ----------------------------------------------------------------------------------------------------

_COUNTS = "select item_id, count(*) filter (where vote) as passes, count(*) filter (where not vote) as fails, count(*) as votes from votes group by item_id"


@query(
    "gate_vote_majority",
    sql("select *, cast(case when 2 * fails > votes then 0 else 1 end as int) as label from c", "votes", c=_COUNTS),
)
def gate_vote_majority(spark, sf):
    return classify.majority_vote(classify.vote_counts(X.votes(spark, sf)), "pass")


@query(
    "gate_vote_strict",
    sql("select *, cast(case when passes > fails then 1 when fails > passes then 0 end as int) as label from c", "votes", c=_COUNTS),
)
def gate_vote_strict(spark, sf):
    return classify.majority_vote(classify.vote_counts(X.votes(spark, sf)), "null")


def gate_scored(spark, sf, tie: str) -> DataFrame:
    labels = classify.majority_vote(classify.vote_counts(X.votes(spark, sf)), tie).select("item_id", "label")
    scores = X.gate_scores(spark, sf).select("item_id", ((F.col("model_score") - 1) / 4).alias("score"))
    return scores.join(labels, "item_id").withColumn("dim", F.lit("content_pass"))


_SCORED = """select 'content_pass' as dim, (g.model_score - 1) / 4.0 as score, {label} as label
    from gate_scores g join c on g.item_id = c.item_id"""
_MAJ = "case when 2 * fails > votes then 0 else 1 end"
_STRICT = "case when passes > fails then 1 when fails > passes then 0 end"
_TP = "count(*) filter (where score >= 0.5 and label = 1)"
_FP = "count(*) filter (where score >= 0.5 and label = 0)"
_TN = "count(*) filter (where score < 0.5 and label = 0)"
_FN = "count(*) filter (where score < 0.5 and label = 1)"
_CLASS = f"""count(*) as n, {_TP} as tp, {_FP} as fp, {_TN} as tn, {_FN} as fn, {q6(f'({_TP} + {_TN}) / count(*)')} as accuracy,
    {q6(f'coalesce({_TP} / nullif({_TP} + {_FP}, 0), 0)')} as precision, {q6(f'coalesce({_TP} / nullif({_TP} + {_FN}, 0), 0)')} as recall,
    {q6(f'coalesce(2 * {_TP} / nullif(2 * {_TP} + {_FP} + {_FN}, 0), 0)')} as f1"""
_AUC = """(sum(rk) filter (where label = 1) - cast(count(*) filter (where label = 1) as double) * (count(*) filter (where label = 1) + 1) / 2)
    / nullif(cast(count(*) filter (where label = 1) as double) * count(*) filter (where label = 0), 0)"""
_RK = "select *, rank() over (partition by dim order by score) + (count(*) over (partition by dim, score) - 1) / 2.0 as rk from s"
_CLASS_COLS = ("accuracy", "precision", "recall", "f1")


@query(
    "gate_classification",
    sql(f"select dim, {_CLASS} from s group by dim", "votes", "gate_scores", c=_COUNTS, s=_SCORED.format(label=_MAJ)),
)
def gate_classification(spark, sf):
    return rounded(classify.confusion(gate_scored(spark, sf, "pass"), ["dim"]), *_CLASS_COLS)


@query(
    "gate_auc",
    sql(f"select dim, {_CLASS}, {q6(_AUC)} as auc from rk group by dim", "votes", "gate_scores", c=_COUNTS,
        s=f"select * from ({_SCORED.format(label=_STRICT)}) where label is not null", rk=_RK),
)
def gate_auc(spark, sf):
    """Strict votes, rescaled model score (five values), with ROC AUC."""
    return rounded(classify.classification(gate_scored(spark, sf, "null"), ["dim"], bounded=True), *_CLASS_COLS, "auc")


@query(
    "gate_confusion",
    sql("select dim, cast(label as int) as truth, cast(case when score >= 0.5 then 1 else 0 end as int) as predicted, count(*) as n from s where label is not null group by all",
        "votes", "gate_scores", c=_COUNTS, s=_SCORED.format(label=_STRICT)),
)
def gate_confusion(spark, sf):
    return classify.confusion_matrix(gate_scored(spark, sf, "null"), ["dim"])


_BIN = "(doc_id * 37 % 101) / cast(100 as double)"


@query(
    "label_auc",
    sql(f"select dim, {_CLASS}, {q6(_AUC)} as auc from rk group by dim",
        s=f"select 'quality' as dim, {_BIN} as score, quality as label from labels union all select 'toxic', {_BIN}, toxic from labels", rk=_RK),
)
def label_auc(spark, sf):
    """Tied scores against two imbalanced labels."""
    labels = X.table(spark, sf, "labels")
    score = (F.col("doc_id") * 37 % 101) / 100.0
    long = labels.select(
        score.cast("double").alias("score"),
        F.inline(F.array(
            F.struct(F.lit("quality").alias("dim"), F.col("quality").alias("label")),
            F.struct(F.lit("toxic").alias("dim"), F.col("toxic").alias("label")),
        )),
    )
    return rounded(classify.classification(long, ["dim"]), *_CLASS_COLS, "auc")


_GATE_VALS = """select id, dim, model_score, probability_score, case when dim = 'content_pass'
      then list_transform(list_filter(ratings, lambda r: r is not null), lambda r: case when r = 'true' then 1.0 else 0.0 end)
      else list_transform(list_filter(ratings, lambda r: r is not null), lambda r: case when r = 'N/A' then 1.0 else cast(r as double) end) end as vals from gate_rows"""
_GATE_TRUTH = """select *, case when dim = 'content_pass' then (case when 2 * list_sum(vals) > len(vals) then 1.0 when 2 * list_sum(vals) < len(vals) then 0.0 end)
      else list_avg(vals) end as truth from gv where len(vals) > 0"""


@query(
    "archetype_report",
    sql(
        f"""select cast(id as varchar) as id, dim, {q6('truth')} as truth, cast(len(vals) as int) as n_ratings from gt where truth is not null""",
        "gate_rows", gv=_GATE_VALS, gt=_GATE_TRUTH,
    ),
)
def archetype_report(spark, sf):
    """Archetype folder records: strict vote for the gate, mean for the other dimensions."""
    rows = reports.prepare_folder(X.gate_results(spark, sf), "drop_null_na1_gate", {"none": "none"})
    return rounded(rows.select("id", "dim", "truth", "n_ratings"), "truth")


@query(
    "archetype_gate_report",
    sql(
        f"select predictor, {_CLASS}, {q6(_AUC)} as auc from rk group by predictor",
        "gate_rows", gv=_GATE_VALS, gt=_GATE_TRUTH,
        s="""select 'Model' as predictor, (model_score - 1) / 4 as score, cast(truth as int) as label from gt where dim = 'content_pass' and truth is not null
             union all select 'Probability', probability_score, cast(truth as int) from gt where dim = 'content_pass' and truth is not null""",
        rk="select *, rank() over (partition by predictor order by score) + (count(*) over (partition by predictor, score) - 1) / 2.0 as rk from s",
    ),
)
def archetype_gate_report(spark, sf):
    """Both predictors (of at most four decimals) classified against the gate votes."""
    rows = reports.prepare_folder(X.gate_results(spark, sf), "drop_null_na1_gate", {"none": "none"})
    return rounded(reports.gate_report(rows, bounded=True), *_CLASS_COLS, "auc")


# ---- descriptive statistics -----------------------------------------------------------------------------------------------

_SERIES = """select 'Model' as series, dim, cast(model_score as double) as v from dimres where model_score is not null
    union all select 'Probability', dim, probability_score from dimres"""
_SERIES_ALL = "select * from sr union all select series, 'OVERALL', v from sr"
SERIES = {"Model": "model_score", "Probability": "probability_score"}


@query(
    "describe_predictions",
    sql(
        f"""select series, dim, count(*) as count, {q6('avg(v)')} as mean, {q6('stddev_pop(v)')} as std, {q6('stddev_samp(v)')} as std_sample,
            min(v) as min, max(v) as max, {q6('max(v) - min(v)')} as range, {q6('quantile_cont(v, 0.25)')} as q25,
            {q6('quantile_cont(v, 0.5)')} as median, {q6('quantile_cont(v, 0.75)')} as q75 from sa group by series, dim""",
        "dimres", sr=_SERIES, sa=_SERIES_ALL,
    ),
)
def describe_predictions(spark, sf):
    out = reports.prediction_statistics(X.dimres(spark, sf), SERIES)
    return rounded(out, "mean", "std", "std_sample", "range", "q25", "median", "q75")


@query(
    "plot_statistics",
    sql(
        f"select series, dim, {q6('avg(v)')} as mean, {q6('coalesce(stddev_samp(v), 0)')} as std, {q6('quantile_cont(v, 0.5)')} as median, {q6('max(v) - min(v)')} as range from sr group by series, dim",
        "dimres", sr=_SERIES,
    ),
)
def plot_statistics(spark, sf):
    return rounded(reports.plot_statistics(X.dimres(spark, sf), SERIES), "mean", "std", "median", "range")


def _hist_sql(bins: int, source: str, *views: str) -> str:
    return sql(
        f"""select series, bin, {q6('a + (b - a) / ' + str(bins) + ' * bin')} as "left", {q6('a + (b - a) / ' + str(bins) + ' * (bin + 1)')} as "right", count(*) as count
            from (select series, a, b, cast(least(floor((v - a) / ((b - a) / {bins})), {bins - 1}) as bigint) as bin from s join e using (series)) group by series, bin, a, b""",
        *views, s=source, e="select series, min(v) as a, max(v) as b from s group by series",
    )


def _series(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("series"), F.col(c).cast("double").alias("v")) for n, c in cols.items()]
    return describe.count_values(df.select(F.inline(F.array(*cells))), ["series"], "v")


@query(
    "histogram20",
    _hist_sql(20, """select 'Model' as series, cast(model_score as double) as v from dimres_truth where model_score is not null
        union all select 'Probability', probability_score from dimres_truth union all select 'Truth', truth from dimres_truth""", "dimres_truth"),
)
def histogram20(spark, sf):
    values = _series(X.dimres_truth(spark, sf), {**SERIES, "Truth": "truth"})
    return rounded(describe.histogram(values, ["series"], 20), "left", "right")


@query(
    "histogram30",
    _hist_sql(30, """select 'Model' as series, cast(model_score as double) as v from dimres where model_score is not null
        union all select 'Probability', probability_score from dimres""", "dimres"),
)
def histogram30(spark, sf):
    return rounded(describe.histogram(_series(X.dimres(spark, sf), SERIES), ["series"], 30), "left", "right")


_BOX = """select dim, quantile_cont(v, 0.25) as q25, quantile_cont(v, 0.5) as median, quantile_cont(v, 0.75) as q75 from v group by dim"""


@query(
    "box_table",
    sql(
        f"""select b.dim, {q6('b.q25')} as q25, {q6('b.median')} as median, {q6('b.q75')} as q75,
            {q6('min(v) filter (where v between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25))')} as whisker_low,
            {q6('max(v) filter (where v between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25))')} as whisker_high,
            count(*) filter (where not v between q25 - 1.5 * (q75 - q25) and q75 + 1.5 * (q75 - q25)) as outliers
            from v join b on v.dim = b.dim group by b.dim, b.q25, b.median, b.q75""",
        v="select event_type as dim, value as v from events", b=_BOX,
    ),
)
def box_table(spark, sf):
    events = X.table(spark, sf, "events").withColumnRenamed("event_type", "dim")
    out = describe.box_table(describe.count_values(events, ["dim"], "value"), ["dim"])
    return rounded(out, "q25", "median", "q75", "whisker_low", "whisker_high")


@query(
    "box_outliers",
    sql(
        """select v.dim, v.v, count(*) as n from v join b on v.dim = b.dim
            where v < q25 - 1.5 * (q75 - q25) or v > q75 + 1.5 * (q75 - q25) group by v.dim, v.v""",
        v="select event_type as dim, value as v from events", b=_BOX,
    ),
)
def box_outliers(spark, sf):
    events = X.table(spark, sf, "events").withColumnRenamed("event_type", "dim")
    return describe.outliers(describe.count_values(events, ["dim"], "value"), ["dim"])


@query(
    "counts_by_dim",
    "select event_type as dim, count(*) as records, count(distinct user_id) as files from events group by event_type order by records desc, dim",
)
def counts_by_dim(spark, sf):
    events = X.table(spark, sf, "events").withColumnRenamed("event_type", "dim")
    return reports.counts_by_dim(events, "user_id")


_BAD = "case when event_id % 40 = 0 then 'nan'::double when event_id % 40 = 1 then 'inf'::double when event_id % 40 = 2 then '-inf'::double else value end"


@query(
    "nonfinite_audit",
    f"""select event_type as dim, count(*) filter (where isnan(v)) as value_nan, count(*) filter (where isinf(v)) as value_inf
        from (select event_type, {_BAD} as v from events) group by event_type""",
)
def nonfinite_audit(spark, sf):
    bad = _BAD.replace("'nan'::double", "double('nan')").replace("'inf'::double", "double('inf')").replace("'-inf'::double", "double('-inf')")
    df = X.table(spark, sf, "events").select(F.col("event_type").alias("dim"), F.expr(bad).alias("value"))
    return reports.non_finite(df, ["value"], ["dim"])


@query(
    "success_rates",
    sql(
        f"select dim, count(*) as total, count(model_score) as successful, count(*) - count(model_score) as failed, {q6('count(model_score) / count(*)')} as success_rate from dimres group by dim",
        "dimres",
    ),
)
def success_rates(spark, sf):
    return rounded(reports.success_rates(X.dimres(spark, sf), F.col("model_score"), ["dim"]), "success_rate")


@query(
    "per_label_accuracy",
    sql(
        f"""select label, {q6('accuracy')} as accuracy, n from (
            select cast(r1 as varchar) as label, avg(h) as accuracy, count(*) as n from h group by r1
            union all select 'overall', avg(h), count(*) from h
            union all select 'average', avg(a), cast(sum(n) as bigint) from (select avg(h) as a, count(*) as n from h group by r1))""",
        "dimres", h="select r1, case when model_score = r1 then 1.0 else 0.0 end as h from dimres",
    ),
)
def per_label_accuracy(spark, sf):
    df = X.dimres(spark, sf).select(F.lit("all").alias("run"), F.col("model_score").alias("pred"), F.col("r1").alias("truth"))
    return rounded(classify.per_label_accuracy(df, ["run"]).drop("run"), "accuracy")


@query(
    "finite_mask",
    f"""select dim, count(*) as n, {q6('corr(p, g)')} as pearson from (select event_type as dim, {_BAD} as p, cast(1 + user_id % 5 as double) as g from events)
        where not isnan(p) and not isinf(p) group by dim""",
)
def finite_mask(spark, sf):
    """Pairs with a non-finite side are left out before the metrics."""
    from judgealign.functions.scores import finite

    bad = _BAD.replace("'nan'::double", "double('nan')").replace("'inf'::double", "double('inf')").replace("'-inf'::double", "double('-inf')")
    df = X.table(spark, sf, "events").select(
        F.col("event_type").alias("dim"), F.expr(bad).alias("pred"), F.expr("cast(1 + user_id % 5 as double)").alias("truth")
    )
    sums = moments.moments(df.where(finite(F.col("pred")) & finite(F.col("truth"))), ["dim"])
    return rounded(moments.metrics(sums).select("dim", "n", "pearson"), "pearson")




_AP = """select predictor, dim, pred, truth from (
      select 'Model' as predictor, dim, model_score as pred, truth from gt where truth is not null and dim <> 'content_pass'
      union all select 'Probability', dim, probability_score, truth from gt where truth is not null and dim <> 'content_pass')"""
_AGE = f"select predictor, {_CLASS}, {q6(_AUC)} as auc from rk group by predictor"


@query(
    "archetype_summary",
    sql(
        "select m.dim, greatest(m.n, p.n) as count, "
        + ", ".join(f"{q6(f'{t}.{m}')} as {n}_{m}" for m in ("pearson", "spearman", "mae", "rmse") for t, n in (("m", "model"), ("p", "prob")))
        + ", " + ", ".join([_better("pearson", ">", "abs"), _better("spearman", ">", "abs"), _better("mae", "<"), _better("rmse", "<")])
        + ", " + ", ".join(f"null::double as {n}_{m}" for m in ("accuracy", "precision", "recall", "f1", "auc") for n in ("model", "prob"))
        + ", " + ", ".join(f"null::varchar as better_{m}" for m in ("accuracy", "precision", "recall", "f1", "auc"))
        + " from pm m join pm p on m.dim = p.dim and m.predictor = 'Model' and p.predictor = 'Probability' union all by name select 'content_pass' as dim, greatest(m.n, p.n) as count, "
        + ", ".join(f"{t}.{m} as {n}_{m}" for m in ("accuracy", "precision", "recall", "f1", "auc") for t, n in (("m", "model"), ("p", "prob")))
        + ", " + ", ".join(_better(m, ">") for m in ("accuracy", "precision", "recall", "f1", "auc"))
        + " from ge m join ge p on m.predictor = 'Model' and p.predictor = 'Probability'",
        "gate_rows", gv=_GATE_VALS, gt=_GATE_TRUTH, ap=_AP,
        pp="select * from ap union all select predictor, 'OVERALL', pred, truth from ap", pr=_PR, pm=_PM,
        s="""select 'Model' as predictor, (model_score - 1) / 4 as score, cast(truth as int) as label from gt where dim = 'content_pass' and truth is not null
             union all select 'Probability', probability_score, cast(truth as int) from gt where dim = 'content_pass' and truth is not null""",
        rk="select *, rank() over (partition by predictor order by score) + (count(*) over (partition by predictor, score) - 1) / 2.0 as rk from s",
        ge=_AGE,
    ),
)
def archetype_summary(spark, sf):
    """Scored dimensions and the gate in one summary, each with its own metrics and winner flags."""
    rows = reports.prepare_folder(X.gate_results(spark, sf), "drop_null_na1_gate", {"none": "none"})
    out = reports.archetype_summary(rows, bounded=True)
    names = ["pearson", "spearman", "mae", "rmse", "accuracy", "precision", "recall", "f1", "auc"]
    return rounded(out, *[f"{t}_{m}" for m in names for t in ("model", "prob")])


@query(
    "dimension_fields",
    "select p_partkey as id, case p_type when 'PROMO' then 'pitch_variation' when 'SMALL' then 'local_story_fit' else p_type end as gt_field from part",
)
def dimension_fields(spark, sf):
    """Annotation fields of prediction dimensions; unknown dimensions keep their names."""
    dim = F.when(F.col("p_type") == "PROMO", "pitch_dynamics").when(F.col("p_type") == "SMALL", "local_scene_fit").otherwise(F.col("p_type"))
    df = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), dim.alias("dim"))
    return align.rename_dims(df, "realism").select("id", "gt_field")


@query(
    "result_records",
    sql(
        r"""select o.id, o.dim, i.char_style, '' as transcript, case when a is not null then coalesce(try_cast(nullif(regexp_extract(a, '(\d+)', 1), '') as bigint), 1) end as model_score,
            coalesce(a, 'No valid score found') as evaluation_text, coalesce(array_to_string(list_transform(i.rhythmic_naturalness, lambda r: coalesce(r, '-')), ','), '') as ratings, cast(3 as int) as n_lists
        from (select *, case when regexp_matches(raw_output, '(?s)answer>(.*?)</answer>') then regexp_replace(regexp_extract(raw_output, '(?s)answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') end as a from outputs) o
        join items i on i.item_id = o.id""",
        "outputs", "items",
    ),
)
def result_records(spark, sf):
    """Raw outputs with their item's texts and ratings."""
    outputs = X.outputs(spark, sf).select(
        F.col("id").alias("item_id"), F.col("dim").alias("specific_dimension"), F.col("raw_output").alias("raw_model_output"),
        F.lit(None).cast("double").alias("probability_score"),
    )
    records = align.result_records(X.items(spark, sf), outputs, ["rhythmic_naturalness", "emotion_accuracy"])
    own = F.col("ground_truth_ratings")["rhythmic_naturalness"]
    return records.select(
        F.col("item_id").alias("id"), F.col("specific_dimension").alias("dim"), "char_style", "transcript", "model_score",
        "evaluation_text", F.array_join(own, ",", "-").alias("ratings"), F.size("ground_truth_ratings").alias("n_lists"),
    )
