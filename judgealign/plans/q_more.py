"""Registered queries: metrics at their limits, files in and out, role records, the full folder report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgealign.functions import ratings as R
from judgealign.functions import text as X_text
from judgealign.functions.keys import nested_or_top
from judgealign.functions.scores import parse_scores
from judgealign.operators import align, classify, describe, fewshot, moments, ranks
from judgealign.operators import prompts as P
from judgealign.operators.kendall import kendall
from judgealign.plans import fixtures as X
from judgealign.plans import q_align as A
from judgealign.plans import q_text as Q
from judgealign.plans import reports, texts
from judgealign.plans.fixtures import DIMS3, sql
from judgealign.plans.q_align import q6, rounded
from judgealign.plans.q_text import lit
from judgealign.schemas import REALISM_DIMS
from judgealign.session import shared_dir, ship_with_tasks
from judgealign.sources import arrays, readers, sinks

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


# ---- metrics at their limits ------------------------------------------------------------------------------------

_ODD = """case when o_orderkey % 17 = 0 then '"NaN"' when o_orderkey % 19 = 0 then '"inf"' else cast(1 + o_custkey % 5 as {text}) end"""
_ODD_PAIRS = """select t.dim, case t.dim when 'quality' then p.quality else p.fit end as pred, t.truth
    from truth_long t join (select o_orderkey as item_id, 1 + o_orderkey % 4 + 0.5 as fit,
        case when o_orderkey % 17 = 0 then 'nan'::double when o_orderkey % 19 = 0 then 'inf'::double else 1 + o_custkey % 5 end as quality from orders) p
      on p.item_id = t.item_id where t.dim in ('quality', 'fit')"""


def _if_finite(expr: str) -> str:
    return f"case when count(*) filter (where isnan(pred) or isinf(pred)) = 0 then {expr} end"


@query(
    "align_nonfinite",
    sql(
        f"""select dim, count(*) as n, count(*) filter (where isnan(pred) or isinf(pred)) as nonfinite,
            {q6(_if_finite('corr(case when isfinite(pred) then pred end, truth)'))} as pearson,
            {q6(_if_finite('avg(case when isfinite(pred) then abs(pred - truth) end)'))} as mae from pooled group by dim""",
        "truth_long", odd=_ODD_PAIRS, pooled="select * from odd union all select 'OVERALL', pred, truth from odd",
    ),
)
def align_nonfinite(spark, sf):
    """Answers with NaN and inf go through parse, mean and join; they make a metric undefined and are counted."""
    answers = X.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"),
        F.expr("concat('{\"quality\": ', " + _ODD.format(text="string") + ", ', \"fit\": ', 1 + o_orderkey % 4, '.5}')").alias("response"),
    )
    dims = ["quality", "fit"]
    pred = align.trial_means(parse_scores(answers, dims), dims)
    pairs = align.pair_up(pred, align.truth_means_wide(X.ann_wide(spark, sf), dims, "fill1"), dims)
    out = moments.agreement(pairs, ["dim"], nonfinite=True)
    return rounded(out.select("dim", "n", "nonfinite", "pearson", "mae"), "pearson", "mae")


_SHIFT = 1e9
_SHIFTED = "select dim, cast(model_score as double) as pred, cast(r1 as double) as truth from dimres where model_score is not null"


@query(
    "align_shifted",
    sql(
        f"""select dim, count(*) as n, {q6('corr(pred, truth)')} as pearson, {q6('avg(abs(pred - truth))')} as mae,
            {q6('1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*))')} as r2 from pooled group by dim""",
        "dimres", s=_SHIFTED, pooled="select * from s union all select 'OVERALL', pred, truth from s",
    ),
)
def align_shifted(spark, sf):
    """Values around a billion have the metrics of the same values around zero."""
    pairs = X.dimres(spark, sf).where("model_score is not null").select(
        "dim", (F.col("model_score") + _SHIFT).alias("pred"), (F.col("r1") + _SHIFT).alias("truth")
    )
    return rounded(moments.agreement(pairs, ["dim"]).select("dim", "n", "pearson", "mae", "r2"), "pearson", "mae", "r2")


@query("align_spearman_large", A.ORACLES["align_spearman"])
def align_spearman_large(spark, sf):
    """The way for any number of distinct values."""
    cells = ranks.count_pairs(A.trial_pairs(spark, sf), ["dim"])
    return rounded(ranks.spearman(cells, ["dim"]), "spearman")


@query("align_kendall_large", A.ORACLES["align_kendall"])
def align_kendall_large(spark, sf):
    """The way for any number of distinct values."""
    cells = ranks.count_pairs(A.trial_pairs(spark, sf), ["dim"])
    return rounded(kendall(cells, ["dim"]).select("dim", "n", "kendall"), "kendall")


@query("align_kendall_continuous_large", A.ORACLES["align_kendall_continuous"])
def align_kendall_continuous_large(spark, sf):
    """The way for any number of distinct values, with about as many of them as rows."""
    pairs = X.dimres_truth(spark, sf).withColumnRenamed("probability_score", "pred")
    return rounded(kendall(ranks.count_pairs(pairs, ["dim"]), ["dim"]).select("dim", "n", "kendall"), "kendall")


@query("gate_auc_large", A.ORACLES["gate_auc"])
def gate_auc_large(spark, sf):
    """The way for any number of score values."""
    return rounded(classify.classification(A.gate_scored(spark, sf, "null"), ["dim"]), *A._CLASS_COLS, "auc")


_WIDE = "select event_type as series, cast(event_id * 1.0e6 + user_id as double) as v from events union all select 'times', cast(epoch(ts) as double) from events"


@query(
    "describe_large",
    sql(
        f"""select series, count(*) as count, min(v) as min, max(v) as max, {q6('quantile_cont(v, 0.25)')} as q25, {q6('quantile_cont(v, 0.5)')} as median,
            {q6('quantile_cont(v, 0.75)')} as q75 from w group by series""",
        w=_WIDE,
    ),
)
def describe_large(spark, sf):
    """Quartiles of values far outside of any scale, such as times in seconds."""
    events = X.table(spark, sf, "events")
    rows = events.select(F.col("event_type").alias("series"), F.expr("cast(event_id * 1.0e6 + user_id as double)").alias("v")).union(
        events.select(F.lit("times"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    )
    out = describe.describe(describe.count_values(rows, ["series"], "v"), ["series"])
    return rounded(out.select("series", "count", "min", "max", "q25", "median", "q75"), "q25", "median", "q75")


# ---- the full folder report -----------------------------------------------------------------------------------------

_FULL = """select predictor, dim, count(*) as n, corr(pred, truth) as pearson, corr(rp, rg) as spearman, avg(abs(pred - truth)) as mae,
    avg((pred - truth) * (pred - truth)) as mse, sqrt(avg((pred - truth) * (pred - truth))) as rmse,
    1 - sum((truth - pred) * (truth - pred)) / (var_pop(truth) * count(*)) as r2 from pr group by predictor, dim"""
_P = """sum(w * pow(greatest(cos(a + i * h), 0), n - 3)) * h / 3 * 2 / exp(lgamma(0.5) + lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0))"""
_PV = f"""select predictor, dim, m, {_P} as p from (
      select predictor, dim, n, m, asin(abs(r)) as a, (pi() / 2 - asin(abs(r))) / 4000 as h
      from (select predictor, dim, n, 'pearson' as m, pearson as r from pm union all select predictor, dim, n, 'spearman', spearman from pm)) s,
    (select i, case when i = 0 or i = 4000 then 1 when i % 2 = 1 then 4 else 2 end as w from range(4001) t(i)) g
    group by predictor, dim, m, n, h"""
_ALL = ("pearson", "spearman", "r2", "mae", "mse", "rmse")


@query(
    "folder_report_full",
    sql(
        "select m.dim, greatest(m.n, p.n) as count, "
        + ", ".join(f"{q6(f'{t}.{m}')} as {n}_{m}" for m in _ALL for t, n in (("m", "model"), ("p", "prob")))
        + ", "
        + ", ".join(
            f"(select {q6('p')} from pv where pv.predictor = '{name}' and pv.dim = m.dim and pv.m = '{m}') as {n}_{m}_p"
            for m in ("pearson", "spearman") for name, n in (("Model", "model"), ("Probability", "prob"))
        )
        + ", "
        + ", ".join(
            [A._better("pearson", ">", "abs"), A._better("spearman", ">", "abs"), A._better("r2", ">"), A._better("mae", "<"), A._better("mse", "<"), A._better("rmse", "<")]
        )
        + " from pm m join pm p on m.dim = p.dim and m.predictor = 'Model' and p.predictor = 'Probability'",
        "predictor_pairs", pp=A._PP, pr=A._PR, pm=_FULL, pv=_PV,
    ),
)
def folder_report_full(spark, sf):
    """Every metric of both predictors with p-values and winner flags."""
    report = reports.agreement_report(A.folder_pairs(spark, sf), ["predictor", "dim"], with_p=True)
    wide = reports.compare_predictors(report, ["pearson", "spearman", "r2"], ["mae", "mse", "rmse"], plain=["pearson_p", "spearman_p"])
    return rounded(wide, *[f"{t}_{m}" for m in (*_ALL, "pearson_p", "spearman_p") for t in ("model", "prob")])


@query(
    "heatmap_predictors",
    sql(
        f"""select dim, concat(case predictor when 'Model' then 'Model' else 'Prob' end, '_', metric) as metric, {q6('v')} as value
        from (select predictor, dim, unnest(['Pearson', 'Spearman']) as metric, unnest([pearson, spearman]) as v from pm where dim <> 'OVERALL')""",
        "predictor_pairs", pp=A._PP, pr=A._PR, pm=A._PM,
    ),
)
def heatmap_predictors(spark, sf):
    """Both correlations of both predictors per dimension."""
    report = reports.agreement_report(A.folder_pairs(spark, sf), ["predictor", "dim"])
    return rounded(reports.heatmap_predictors(report), "value")


@query(
    "scored_records",
    sql("select id, dim, model_score, probability_score from r where coalesce(model_score, probability_score) is not null", "dimres",
        r="select id, dim, model_score, case when id % 25 = 0 then null else probability_score end as probability_score from dimres"),
)
def scored_records(spark, sf):
    """Records with at least one of the two scores."""
    rows = X.dimres(spark, sf).select("id", "dim", "model_score", F.expr("case when id % 25 = 0 then null else probability_score end").alias("probability_score"))
    return reports.with_any_score(rows)


@query(
    "describe_with_truth",
    sql(
        f"""select series, dim, count(*) as count, {q6('avg(v)')} as mean, {q6('stddev_samp(v)')} as std_sample, min(v) as min, max(v) as max,
            {q6('quantile_cont(v, 0.25)')} as q25, {q6('quantile_cont(v, 0.5)')} as median, {q6('quantile_cont(v, 0.75)')} as q75 from sa group by series, dim""",
        "dimres_truth",
        sr=A._SERIES.replace("from dimres", "from dimres_truth") + " union all select 'Truth', dim, truth from dimres_truth", sa=A._SERIES_ALL,
    ),
)
def describe_with_truth(spark, sf):
    """The two scores and the truth mean side by side, with the sample deviation."""
    out = reports.prediction_statistics(X.dimres_truth(spark, sf), {**A.SERIES, "Truth": "truth"})
    return rounded(out.select("series", "dim", "count", "mean", "std_sample", "min", "max", "q25", "median", "q75"), "mean", "std_sample", "q25", "median", "q75")


# ---- role records ---------------------------------------------------------------------------------------------------

_TAGS = X_text.REPORT_TAGS


def _records_all(spark, sf) -> DataFrame:
    outputs = X.eval_texts(spark, sf).select(F.col("id").alias("item_id"), F.col("text").alias("raw_model_output"))
    return align.result_records(X.items(spark, sf), outputs, ["rhythmic_naturalness"], dims=_TAGS)


@query(
    "result_records_all_dims",
    sql(
        "select i.item_id as id, unnest([" + ", ".join(lit(t) for t in _TAGS) + "]) as dim, unnest([" + ", ".join(f"cast({Q._tag_sql(t)} as double)" for t in _TAGS)
        + "]) as score, i.char_style, cast(2 as int) as n_lists from eval_texts e join items i on i.item_id = e.id",
        "eval_texts", "items",
    ),
)
def result_records_all_dims(spark, sf):
    """Comprehensive records: a map of scores over all dimensions next to the item's ratings."""
    return _records_all(spark, sf).select(
        F.col("item_id").alias("id"), F.explode("dimension_scores").alias("dim", "score"), "char_style", F.size("ground_truth_ratings").alias("n_lists")
    )


@query(
    "success_rates_multi",
    sql(
        f"""select evaluation_type, count(*) as total, count(*) filter (where ok) as successful, count(*) filter (where not ok) as failed,
            {q6('avg(ok::int)')} as success_rate from (
              select 'specific_dimension' as evaluation_type, model_score is not null as ok from dimres
              union all select 'comprehensive', id % 7 <> 0 from dimres) group by evaluation_type""",
        "dimres",
    ),
)
def success_rates_multi(spark, sf):
    """Usable records of both kinds: a score, or a non-empty map of scores."""
    base = X.dimres(spark, sf)
    one = base.select(
        F.lit("specific_dimension").alias("evaluation_type"), F.col("dim").alias("specific_dimension"), F.col("model_score").cast("double").alias("model_score"),
        F.lit(None).cast("map<string,double>").alias("dimension_scores"),
    )
    scores = F.expr("case id % 7 when 0 then cast(map() as map<string,double>) when 1 then map('pitch_dynamics', cast(null as double)) else map('pitch_dynamics', 1D) end")
    many = base.select(F.lit("comprehensive"), F.lit(""), F.lit(None).cast("double"), scores)
    out = reports.success_rates(one.union(many), reports.usable_score(), ["evaluation_type"])
    return rounded(out, "success_rate")


_FIELDS_OF = {c: f for c, f in reports.category_fields().items() if c in _TAGS or c in X_text.REPORT_LABELS}


@query(
    "category_pairs",
    sql(
        "select pair, count(*) as n, " + q6("case when stddev_pop(rating) > 0 and stddev_pop(truth) > 0 then corr(rating, truth) end") + " as pearson from ("
        + " union all ".join(
            f"select {lit(f'{c}_vs_{f}')} as pair, r.rating, list_avg(list_transform(list_filter(i.{d}, lambda x: x is not null), lambda x: case when x = 'N/A' then 1.0 else cast(x as double) end)) as truth"
            f" from r join items i on i.item_id = r.id where r.category = {lit(c)}"
            for c, f in _FIELDS_OF.items() for d, g, _ in REALISM_DIMS if g == f
        )
        + ") where truth is not null group by pair",
        "eval_texts", "items", r=Q._patterns_sql(),
    ),
)
def category_pairs(spark, sf):
    """Each extracted category against the human ratings of its own field, over the whole data set."""
    ratings = Q.extract_report_patterns(spark, sf)
    items = X.items(spark, sf)
    cells = [F.struct(F.lit(f).alias("field"), R.mean_of(F.col(d), "drop_null_na1").alias("truth")) for d, f, _ in REALISM_DIMS]
    truth = items.select(F.col("item_id").alias("id"), F.inline(F.array(*cells))).where("truth is not null")
    return rounded(reports.category_pairs(ratings, truth), "pearson")


@query(
    "rating_summary_truth",
    sql(
        f"""select kind, category, {q6('avg(v)')} as mean, {q6('stddev_pop(v)')} as std, min(v) as min, max(v) as max, count(*) as count from (
            select 'probability' as kind, dim as category, probability_score as v from dimres union all select 'truth', category, v from t) group by kind, category""",
        "dimres", "items",
        t=" union all ".join(
            f"select {lit(f)} as category, case when x = 'N/A' then 1.0 else cast(x as double) end as v from (select unnest({d}) as x from items) where x is not null"
            for d, f, _ in REALISM_DIMS
        ),
    ),
)
def rating_summary_truth(spark, sf):
    """Summaries of the probability scores per dimension and of all human ratings per field."""
    cells = [F.struct(F.lit(f).alias("category"), R.clean(F.col(d), "drop_null_na1").alias("r")) for d, f, _ in REALISM_DIMS]
    human = X.items(spark, sf).select(F.inline(F.array(*cells))).select("category", F.explode("r").alias("rating"))
    prob = X.dimres(spark, sf).select(F.col("dim").alias("category"), F.col("probability_score").alias("rating"))
    out = reports.rating_summary(prob).withColumn("kind", F.lit("probability")).unionByName(reports.rating_summary(human).withColumn("kind", F.lit("truth")))
    return rounded(out, "mean", "std")


# ---- JSON answers ------------------------------------------------------------------------------------------------------

_TWICE = """concat('{"a": 9, "a": ', 1 + event_id % 5, ', "b": ', case event_id % 3 when 0 then 'NaN' when 1 then '"3"' else '2.5' end, '}', case when event_id % 11 = 0 then ' tail' else '' end)"""


@query(
    "parse_loose_json",
    """select event_id as item_id, cast(case when event_id % 11 = 0 then 1 else 1 + event_id % 5 end as double) as a,
         cast(case when event_id % 11 = 0 then 1.0 else case event_id % 3 when 1 then 3.0 when 2 then 2.5 end end as double) as b,
         event_id % 11 <> 0 and event_id % 3 = 0 as b_is_nan from events""",
)
def parse_loose_json(spark, sf):
    """Of equal keys the last one counts, a bare NaN is a number, a tail behind the object is an error."""
    rows = X.table(spark, sf, "events").select(F.col("event_id").alias("item_id"), F.expr(_TWICE).alias("response"))
    out = parse_scores(rows, ["a", "b"])
    nan = F.isnan("b")
    return out.select("item_id", "a", F.when(~nan, F.col("b")).alias("b"), nan.alias("b_is_nan"))


_ANSWERS = "case event_id % 4 when 0 then concat('```json', chr(10), '{\"a\": ', event_id, '}', chr(10), '```') when 1 then concat('{ \"a\" : [1, ', user_id, '] }') when 2 then 'no json' else '```json {broken ```' end"


@query(
    "normalised_answers",
    """select event_id as id, case event_id % 4 when 0 then concat('{"a":', event_id, '}') when 1 then concat('{"a":[1,', user_id, ']}')
         when 2 then 'no json' else '```json {broken ```' end as answer from events""",
)
def normalised_answers(spark, sf):
    """Valid JSON is written in one form; any other answer stays as it is."""
    rows = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_ANSWERS).alias("response"))
    return rows.select("id", X_text.normal_answer(F.col("response")).alias("answer"))


# ---- prompts -------------------------------------------------------------------------------------------------------------


@query(
    "request_archetype",
    sql(
        f"""select item_id, md5(concat({lit(texts.GENERAL)}, chr(10), 'Prompt’s role & scene: ', char_profile)) as prefixed,
            md5(concat({lit(texts.GENERAL)}, chr(10), char_profile)) as plain from items""",
        "items",
    ),
)
def request_archetype(spark, sf):
    """Archetype questions in both forms: with its heading (judging) and alone (training)."""
    items = X.items(spark, sf)
    question = F.col("char_profile")
    both = P.combined_requests(items, texts.GENERAL, P.archetype_prompt(question)).withColumnRenamed("prompt", "a").join(
        P.combined_requests(items, texts.GENERAL, P.archetype_prompt(question, heading=False)).withColumnRenamed("prompt", "b"), "item_id"
    )
    return both.select("item_id", F.md5("a").alias("prefixed"), F.md5("b").alias("plain"))


@query(
    "fewshot_conversations_empty",
    sql(
        f"""select item_id, 0 as turn, 'system' as role, 'You judge speech.' as text from fewshot_items
            union all select item_id, 1, 'user', concat({lit(texts.GENERAL)}, {Q._W['intro']}, 0) from fewshot_items
            union all select item_id, 2, 'user', {Q._CUR} from fewshot_items""",
        "fewshot_items",
    ),
)
def fewshot_conversations_empty(spark, sf):
    """Without any example every item still has its conversation."""
    items = X.fewshot_items(spark, sf)
    pool = X.fewshot_pool(spark, sf).where("false")
    selected = fewshot.similar(items, pool, ["char_profile"], 3)
    examples = pool.select("example_id", F.col("char_profile").alias("prompt"), F.lit("a").alias("audio"), F.lit("b").alias("annotation_prompt"))
    asked = items.select("item_id", F.col("char_profile").alias("prompt"), F.lit("x.wav").alias("audio"))
    talks = fewshot.conversations(asked, selected, examples, texts.GENERAL, "You judge speech.")
    return talks.select("item_id", F.posexplode_outer("messages").alias("turn", "m")).select("item_id", "turn", F.col("m.role").alias("role"), F.col("m.content")[0]["text"].alias("text"))


# ---- files ---------------------------------------------------------------------------------------------------------------


@query(
    "source_trials",
    sql(f"select item_id, dim, {q6('pred')} as pred, trial_count from (select cast(item_id as varchar) as item_id, dim, pred, trial_count from pred_long)", "pred_long"),
)
def source_trials(spark, sf):
    """Trials written as result files and read back by model and trial number; a twelfth file is beyond the limit."""
    base = shared_dir(spark, "trials")
    rows = X.judge(spark, sf)
    for trial in range(3):
        part = rows.where(F.col("trial") == trial).select(F.col("item_id").cast("string").alias("id"), "response", "audio_path")
        sinks.write_results(part, f"{base}/m_trial{(2, 7, 10)[trial]}.jsonl", if_exists="error")
    sinks.write_results(rows.select(F.lit("stray").alias("id"), "response"), f"{base}/m_trial12.jsonl")
    sinks.write_results(rows.select(F.lit("other").alias("id"), "response"), f"{base}/m2_trial1.jsonl")
    wide = align.trial_means(parse_scores(readers.read_trials(spark, base, "m", trials=10), DIMS3), DIMS3)
    cells = [F.struct(F.lit(d).alias("dim"), F.col(d).alias("pred"), F.col(f"{d}_count").alias("trial_count")) for d in DIMS3]
    return rounded(wide.select("item_id", F.inline(F.array(*cells))), "pred")


@query(
    "source_items",
    sql(
        "select cast(item_id as varchar) as item_id, char_style, "
        + ", ".join(
            q6(f"list_avg(list_transform({d}, lambda r: case when r is null or upper(r) = 'N/A' then 1.0 else cast(r as double) end))") + f" as {d}"
            for d in ("pitch_dynamics", "rhythmic_naturalness")
        )
        + " from items",
        "items",
    ),
)
def source_items(spark, sf):
    """Annotated items written as JSON lines, nested and flat, with an older version of each: the last line wins."""
    base = shared_dir(spark, "items")
    items = X.items(spark, sf)
    ident = F.concat(F.col("item_id").cast("string"), F.lit(".wav")).alias("id")
    nested = F.struct(F.col("pitch_dynamics").alias("pitch_variation"), "rhythmic_naturalness").alias("annotations")
    old = items.select(ident, F.lit("old").alias("char_style"), F.array(F.lit("5")).alias("pitch_variation"))
    sinks.write_results(old, f"{base}/a-old.jsonl")
    sinks.write_results(items.where("item_id % 2 = 0").select(ident, "char_style", nested), f"{base}/b-nested.jsonl")
    flat = items.where("item_id % 2 = 1").select(ident, "char_style", F.col("pitch_dynamics").alias("pitch_variation"), "rhythmic_naturalness")
    sinks.write_results(flat, f"{base}/b-top.jsonl")
    read = readers.read_items(spark, [f"{base}/a-old.jsonl", f"{base}/b-nested.jsonl", f"{base}/b-top.jsonl"])
    fields = {"pitch_dynamics": "pitch_variation", "rhythmic_naturalness": "rhythmic_naturalness"}
    means = [R.mean_of(nested_or_top(read, f), "fill1").alias(d) for d, f in fields.items()]
    return rounded(read.select("item_id", "char_style", *means), *fields)


@query(
    "source_examples",
    sql("select cast(item_id as varchar) as item_id, concat('{\"pitch_dynamics\":', " + Q._gold("pitch_dynamics") + ", '}') as annotation_prompt from items", "items"),
)
def source_examples(spark, sf):
    """Few-shot examples read from JSON lines, with their gold scores."""
    base = shared_dir(spark, "examples")
    items = X.items(spark, sf).select(F.col("item_id").cast("string").alias("id"), F.struct(F.col("pitch_dynamics").alias("pitch_variation")).alias("annotations"))
    sinks.write_results(items, f"{base}/examples.jsonl")
    return fewshot.load_examples(spark, f"{base}/examples.jsonl", {"pitch_dynamics": "pitch_variation"}).select("item_id", "annotation_prompt")


_CHUNK = 500


@query(
    "source_folder",
    sql(
        f"""select cast(id as varchar) as id, dim, model_score, probability_score from (
              select *, row_number() over (partition by dim, id // {_CHUNK} order by cast(id as varchar)) as k, count(*) over (partition by dim, id // {_CHUNK}) as n from dimres)
            where (id // {_CHUNK}) % 3 <> 0 or k < n""",
        "dimres",
    ),
)
def source_folder(spark, sf):
    """A folder of JSON arrays, every third one cut inside its last object: whole objects survive."""
    base = shared_dir(spark, "folder")
    rows = X.dimres(spark, sf).select(
        F.col("dim").alias("specific_dimension"), (F.floor(F.col("id") / _CHUNK)).alias("chunk"),
        F.struct(F.col("id").cast("string").alias("id"), F.col("dim").alias("specific_dimension"), F.col("model_score").cast("double").alias("model_score"), "probability_score").alias("o"),
    )
    arrays = rows.groupBy("specific_dimension", "chunk").agg(F.to_json(F.array_sort(F.collect_list("o"))).alias("value"))
    cut = F.when(F.col("chunk") % 3 == 0, F.expr("substring(value, 1, length(value) - 4)")).otherwise(F.col("value"))
    arrays.select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(f"{base}/arrays")
    read = readers.read_folder(spark, f"{base}/arrays", pattern="*.txt")
    return read.select("id", F.col("specific_dimension").alias("dim"), F.col("model_score").cast("bigint").alias("model_score"), "probability_score")


@query(
    "source_array_records",
    r"""select id, kind, note, user_id from (
          select event_id as id, event_type as kind, user_id, concat('a"}{[', event_type, case when event_id % 7 = 0 then chr(92) else '' end) as note,
            event_id // 5000 as chunk, row_number() over (partition by event_id // 5000 order by event_id desc) as k from events)
        where chunk % 2 = 0 or k > 1""",
)
def source_array_records(spark, sf):
    """Array files of thousands of records with braces in their texts; every second one ends inside its last record."""
    base = shared_dir(spark, "records")
    note = F.concat(F.lit('a"}{['), "event_type", F.when(F.col("event_id") % 7 == 0, F.lit("\\")).otherwise(F.lit("")))
    record = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), note.alias("note"), F.struct("user_id", F.array(F.lit(1)).alias("list")).alias("who")))
    rows = X.table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 5000).alias("chunk"), record.alias("record"))
    w = Window.partitionBy("chunk").orderBy("event_id")
    begin = F.when(F.lag("event_id").over(w).isNull(), F.lit("[")).otherwise(F.lit(""))
    ends = F.lead("event_id").over(w).isNull()
    short = F.expr("substring(record, 1, length(record) - 9)")
    line = F.when(ends & (F.col("chunk") % 2 == 1), F.concat(begin, short)).when(ends, F.concat(begin, "record", F.lit("]"))).otherwise(F.concat(begin, "record", F.lit(",")))
    lines = rows.select("chunk", "event_id", line.alias("value")).repartition("chunk").sortWithinPartitions("chunk", "event_id")
    lines.select("chunk", "value").write.partitionBy("chunk").text(f"{base}/arrays")
    found = arrays.read_records(spark, f"{base}/arrays/chunk=*/*.txt")
    parsed = found.select(F.from_json("record", "id long, kind string, note string, who struct<user_id:long>").alias("r"))
    return parsed.select("r.id", "r.kind", "r.note", "r.who.user_id")


@query(
    "source_logs",
    """select cast(user_id % 40 as varchar) as iter, cast(count(*) * 0.5 as double) as sound, null::double as music, cast(max(event_id) / 4.0 as double) as speech,
         cast((user_id % 40 * 3 % 7) / 5.0 as double) as total_accuracy from events group by user_id % 40""",
)
def source_logs(spark, sf):
    """Accuracy logs of several iterations, written by one partitioned write and read by one scan, one row each, best first."""
    base = shared_dir(spark, "logs")
    runs = X.table(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("test")).agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    lines = runs.select(
        "test",
        F.explode(F.array(F.expr("concat('sound : ', n * 0.5)"), F.lit("music : n/a"), F.expr("concat('speech : ', top / 4.0)"),
                          F.expr("concat('Total Accuracy: ', (test * 3 % 7) / 5.0)"))).alias("value"),
    )
    lines.write.partitionBy("test").text(f"{base}/runs")
    return readers.leaderboard(readers.read_accuracy_logs(spark, f"{base}/runs", name="*", mark="test="))


@query(
    "source_checkpoints",
    """select 'm' || (user_id % 3) as model_name, count(*) as processed, cast(max(user_id) - min(user_id) as double) as duration, cast(3 as int) as preview
       from events group by user_id % 3 order by model_name""",
)
def source_checkpoints(spark, sf):
    """Checkpoint files with processed count, run time and the first three results."""
    base = shared_dir(spark, "checkpoints")
    events = X.table(spark, sf, "events").withColumn("model", F.col("user_id") % 3)
    rows = events.groupBy("model").agg(
        F.count("*").alias("total_processed"), F.max("user_id").cast("double").alias("timestamp"), F.min("user_id").cast("double").alias("start_time")
    )
    for model in range(3):
        one = rows.where(F.col("model") == model).select(
            F.create_map(F.lit("model_name"), F.lit(f"m{model}"), F.lit("prompt_type"), F.lit("all")).alias("args"),
            F.array(*[F.lit(str(i)) for i in range(5)]).alias("results"), "total_processed", "timestamp", "start_time",
        )
        sinks.write_results(one, f"{base}/checkpoint_{model}.json", if_exists="error")
    read = readers.read_checkpoints(spark, base, prompt_type="all").where(~readers.is_older("modified", 1))
    return read.select("model_name", "processed", "duration", F.size("preview").alias("preview"))


@query(
    "sink_epochs",
    """select event_id % 3 as epoch, event_type as kind, count(*) as n, cast(sum(event_id) as bigint) as ids from events group by event_id % 3, event_type""",
)
def sink_epochs(spark, sf):
    """Three epochs; one is replayed with other rows, one stops before its commit and is written again. Each counts once."""
    base = shared_dir(spark, "epochs")
    events = X.table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    epochs = [events.where(F.col("event_id") % 3 == e) for e in range(3)]
    sinks.write_epoch(epochs[0].unionAll(epochs[1]), base, 0)
    sinks.stage_epoch(epochs[1], base, 1)
    for number, rows in enumerate(epochs):
        sinks.write_epoch(rows, base, number)
    sinks.stage_epoch(epochs[2], base, 2)
    return sinks.read_epochs(spark, base).groupBy("epoch", "kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "sink_report",
    sql(f"select dim, count(*) as n, {q6('corr(pred, truth)')} as pearson, {q6('avg(abs(pred - truth))')} as mae from pooled group by dim", "pairs", pooled=A._POOLED),
)
def sink_report(spark, sf):
    """The nested JSON report is written as one file and read back."""
    base = shared_dir(spark, "report")
    metrics = moments.agreement(A.trial_pairs(spark, sf), ["dim"]).select("dim", "n", "pearson", "mae")
    sinks.write_report(sinks.nested_report(metrics), f"{base}/report.json")
    kind = T.StructType().add("n", "long").add("pearson", "double").add("mae", "double")
    schema = T.StructType().add("overall", kind).add("dimensions", T.MapType(T.StringType(), kind))
    text = spark.read.text(f"{base}/report.json").select(F.from_json("value", schema).alias("j"))
    rows = text.select(F.explode(F.map_concat("j.dimensions", F.create_map(F.lit("OVERALL"), F.col("j.overall")))).alias("dim", "m"))
    return rounded(rows.select("dim", "m.*"), "pearson", "mae")


@query(
    "sink_csv",
    sql(f"select cast(id as varchar) as id, dim, cast(model_score as double) as model_score, {q6('list_avg(vals)')} as gt_avg_own from f where dim = 'click'", "folder_rows", f=A._FOLDER),
)
def sink_csv(spark, sf):
    """Records as CSV with map entries as columns; a second write without force leaves the file as it is."""
    base = shared_dir(spark, "csv")
    rows = reports.prepare_folder(X.folder_results(spark, sf), "drop_null_na1", {"none": "none"}).where("dim = 'click'")
    flat = align.flatten_map(rows.select("id", "dim", "model_score", "gt_avg"), "gt_avg", ["click"], "gt_avg_")
    sinks.write_csv(flat, f"{base}/rows")
    sinks.write_csv(flat.where("false"), f"{base}/rows", if_exists="skip")
    read = spark.read.option("header", True).schema("id string, dim string, model_score double, gt_avg_click double").csv(f"{base}/rows")
    return rounded(read.withColumnRenamed("gt_avg_click", "gt_avg_own"), "gt_avg_own")


@query("sink_variations", "select count(*) * 2 as total_variations, count(*) * 2 as rows_read from part")
def sink_variations(spark, sf):
    """Prompt variations written as JSON lines, with the count that the writer saw."""
    base = shared_dir(spark, "variations")
    made = P.dimension_variations(X.phrasings(spark, sf), ["Rate.", "Score."], 7)
    meta = sinks.write_variations(made, f"{base}/variations")
    read = readers.read_variations(spark, f"{base}/variations").agg(F.count("*").alias("rows_read"))
    return meta.select("total_variations", read.scalar().alias("rows_read"))


@query("age_filter", "select event_id from events where ts < current_date - interval 1 day")
def age_filter(spark, sf):
    """Rows older than a number of days."""
    return readers.older_than(X.table(spark, sf, "events"), 1, "ts").select("event_id")


@query("report_preview", "select event_id, event_type, value from events order by value desc, event_id limit 5")
def report_preview(spark, sf):
    """The first rows of a report."""
    return align.preview_rows(X.table(spark, sf, "events").select("event_id", "event_type", "value"), [F.desc("value"), "event_id"])
