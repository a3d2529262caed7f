"""Judge-alignment tables derived from the driver tables, as DataFrames and as the same SQL.

Each view covers whole tables. The modulo terms derive values, they do not select rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.schemas import ARCHETYPE_DIMS, REALISM_DIMS
from judgealign.session import spread

DIMS3 = ["quality", "emphasis", "fit"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- human ratings -----------------------------------------------------------------------------------------


def ann_wide(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (item, annotator): a raw rating per dimension, with N/A and null."""
    def rating(v: str) -> str:
        return (
            "case when l_returnflag = 'R' and l_linenumber = 1 then 'N/A'"
            " when l_linestatus = 'O' and l_linenumber = 2 then null"
            f" else cast(1 + cast(round({v}) as bigint) % 5 as string) end"
        )

    return spread(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")).select(
        F.col("l_orderkey").alias("item_id"),
        F.col("l_linenumber").alias("annotator"),
        F.expr(rating("l_quantity")).alias("quality"),
        F.expr(rating("l_discount * 100")).alias("emphasis"),
        F.expr(rating("l_tax * 100")).alias("fit"),
    )


def ann_long(spark: SparkSession, sf: str) -> DataFrame:
    from judgealign.operators.align import unpivot

    return unpivot(ann_wide(spark, sf), ["item_id", "annotator"], DIMS3, "raw")


def judge(spark: SparkSession, sf: str) -> DataFrame:
    """Three trials of JSON answers; some are fenced, some failed, some lack a key."""
    response = """
      case when o_orderkey % 11 = 0 and trial = 0 then 'Error: timeout'
           else concat(case when o_orderkey % 7 = 0 then concat('```json', chr(10)) else '' end,
             '{"quality": ', 1 + cast(round(o_totalprice) as bigint) % 5,
             case when o_orderkey % 13 = 0 then '' else concat(', "emphasis": ', 1 + (o_custkey + trial) % 5) end,
             ', "fit": ', 1 + (o_orderkey + trial) % 4, '.5}',
             case when o_orderkey % 7 = 0 then concat(chr(10), '```') else '' end) end"""
    return (
        spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 8)  # three answers to parse per row
        .select("o_orderkey", "o_custkey", "o_totalprice", F.explode(F.array(*[F.lit(t) for t in range(3)])).alias("trial"))
        .select(
            F.col("o_orderkey").alias("item_id"),
            "trial",
            F.expr("concat('audio/x/', o_orderkey, '.wav')").alias("audio_path"),
            F.expr(response).alias("response"),
        )
    )


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), (F.col("l_returnflag") != "R").alias("vote")
    )


def gate_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A 1..5 gate score per item."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.expr("1 + (o_custkey + o_orderkey) % 5").alias("model_score")
    )


# ---- dimension results ----------------------------------------------------------------------------------------


def dimres(spark: SparkSession, sf: str) -> DataFrame:
    """One dimension per row, two predictors, three ratings."""
    return spread(table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")).select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("dim"),
        F.expr("case when event_id % 50 = 0 then null else 1 + cast(round(value) as bigint) % 5 end").alias("model_score"),
        F.expr("round(1 + (value - 4 * floor(value / 4)), 4)").alias("probability_score"),
        F.expr("1 + (event_id + user_id) % 5").alias("r1"),
        F.expr("case when event_id % 9 = 0 then null else 1 + (event_id + 2 * user_id) % 5 end").alias("r2"),
        F.expr("1 + (event_id * 3 + user_id) % 5").alias("r3"),
    )


def dimres_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension results with the mean of the non-null ratings as truth."""
    from judgealign.functions.ratings import mean_of

    arr = F.array(*[F.col(c).cast("string") for c in ("r1", "r2", "r3")])
    return dimres(spark, sf).withColumn("truth", mean_of(arr, "drop_null_na1"))


def folder_results(spark: SparkSession, sf: str) -> DataFrame:
    """Dimension results with a ratings map, as folder files hold them; every rating list may be null-only."""
    text = lambda c: F.col(c).cast("string")
    na = F.when(F.col("id") % 8 == 0, "N/A").otherwise(text("r3"))
    own = F.when(F.col("id") % 10 == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array(text("r1"), text("r2"), na))
    return dimres(spark, sf).select(
        F.col("id").cast("string").alias("id"),
        F.concat(F.lit("dim_"), F.col("dim"), F.lit(".json")).alias("source_file"),
        F.col("dim").alias("specific_dimension"),
        F.col("model_score").cast("double").alias("model_score"),
        "probability_score",
        F.concat(F.lit("profile "), F.col("id"), F.lit(" of "), F.repeat(F.lit("a long story "), (F.col("id") % 6).cast("int"))).alias("char_profile"),
        F.create_map(
            F.col("dim"), own,
            F.lit("story"), F.array(text("r2"), text("r3")),
            F.lit("annotator_confidence_rating"), F.array(text("r1")),
        ).alias("ground_truth_ratings"),
    )


def gate_results(spark: SparkSession, sf: str) -> DataFrame:
    """Archetype folder records: clicks carry the pass/fail gate, the other event types are scored dimensions."""
    is_gate = F.col("event_type") == "click"
    vote = lambda e: F.expr(f"case when ({e}) % 3 = 0 then 'false' when ({e}) % 7 = 0 then 'N/A' when ({e}) % 11 = 0 then null else 'true' end")
    score = lambda e: F.expr(f"case when ({e}) % 7 = 0 then 'N/A' when ({e}) % 11 = 0 then null else cast(1 + ({e}) % 5 as string) end")
    args = ["event_id + user_id", "event_id + 2 * user_id", "event_id * 3 + user_id", "event_id * 5 + 3 * user_id"]
    dim = F.when(is_gate, "content_pass").otherwise(F.col("event_type"))
    ratings = F.when(is_gate, F.array(*[vote(a) for a in args])).otherwise(F.array(*[score(a) for a in args]))
    return spread(table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")).select(
        F.col("event_id").cast("string").alias("id"),
        dim.alias("specific_dimension"),
        F.expr("cast(1 + cast(round(value) as bigint) % 5 as double)").alias("model_score"),
        F.expr("round((value - 4 * floor(value / 4)) / 4, 4)").alias("probability_score"),
        F.lit("").alias("char_profile"),
        F.create_map(dim, ratings).alias("ground_truth_ratings"),
    )


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw judge text in six shapes."""
    return spread(table(spark, sf, "events").select("event_id", "event_type", "user_id")).select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("dim"),
        F.expr("""
          case event_id % 6 when 0 then concat('<think>ok</think><answer> ', 1 + event_id % 5, ' </answer>')
            when 1 then concat('<answer>', chr(10), 1 + user_id % 5, '/5', chr(10), '</answer>')
            when 2 then '<answer>N/A</answer>'
            when 3 then '<answer>good</answer>'
            when 4 then concat('score ', 1 + user_id % 5)
            else concat('answer>', 1 + user_id % 5, '</answer> <answer>9</answer>') end""").alias("raw_output"),
    )


def eval_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Free-text evaluations with labelled ratings and tags."""
    return spread(table(spark, sf, "events").select("event_id", "event_type", "user_id")).select(
        F.col("event_id").alias("id"),
        F.expr("""
          concat('Voice: ok', chr(10), 'Rhythmic Naturalness: ', 1 + event_id % 5, chr(10),
            'pitch variation:  ', 1 + user_id % 5, chr(10),
            case when event_id % 3 = 0 then concat('Style Consistency: ', 1 + (event_id + user_id) % 5, chr(10)) else '' end,
            '<pitch_dynamics>', 1 + (event_id * 2) % 5, '</pitch_dynamics>',
            case when event_id % 4 = 0 then '<stress_emphasis>n/a</stress_emphasis>'
                 else concat('<Stress_Emphasis>', 1 + (user_id * 3) % 5, '</Stress_Emphasis>') end,
            '<trait_embodiment>', 1 + (event_id + 2) % 5, ' of 5</trait_embodiment>',
            '<local_scene_fit>', 1 + (user_id + 3) % 5, '</local_scene_fit>')""").alias("text"),
    )


# ---- items and few-shot -----------------------------------------------------------------------------------------


def _ratings_expr(j: int) -> list[str]:
    """Four ratings of dimension j as SQL: 0 -> null, 6 -> N/A, 1..5 as they are."""
    out = []
    for a in range(4):
        v = f"((doc_id * {j + 3} + {a * 5} + n_chars) % 7)"
        out.append(f"case when {v} = 0 then null when {v} = 6 then 'N/A' else cast({v} as {{text}}) end")
    return out


def _gate_expr() -> list[str]:
    out = []
    for a in range(4):
        v = f"((doc_id * 2 + {a * 3} + n_chars) % 5)"
        out.append(f"case when {v} = 0 then null when {v} < 3 then 'true' else 'false' end")
    return out


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated items: whole document texts as profiles, four ratings for every dimension of both rubrics."""
    cols = [F.expr("array(" + ", ".join(_ratings_expr(j)).format(text="string") + ")").alias(d) for j, (d, _, _) in enumerate(REALISM_DIMS)]
    cols += [
        F.expr("array(" + ", ".join(_ratings_expr(j + 20)).format(text="string") + ")").alias(d)
        for j, (d, _, _) in enumerate(ARCHETYPE_DIMS[:3])
    ]
    cols.append(F.expr("array(" + ", ".join(_gate_expr()) + ")").alias("content_pass"))
    return spread(table(spark, sf, "documents")).select(
        F.col("doc_id").alias("item_id"),
        F.col("text").alias("char_profile"),
        F.expr("concat(lang, ' ', source)").alias("char_style"),
        F.expr("concat('scene ', source)").alias("local_scene"),
        F.expr("concat('audio/', source, '/', doc_id, '.wav')").alias("wav_path"),
        F.expr("case when doc_id % 4 = 0 then null else concat('a voice in ', lang) end").alias("caption"),
        *cols,
    )


#: Labels whose ids are sent to every task, so that no document is shuffled to find its label.
LABELS_SENT = 1 << 21


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of labelled documents, to be sent to the tasks up to a checked number."""
    labels = table(spark, sf, "labels")
    ids = labels.select("doc_id").distinct()
    return F.broadcast(ids) if labels.count() <= LABELS_SENT else ids


def fewshot_pool(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents are the annotated examples."""
    labels = _labelled(spark, sf)
    return (
        table(spark, sf, "documents")
        .join(labels, "doc_id", "left_semi")
        .select(
            F.col("doc_id").alias("example_id"), F.col("doc_id").alias("pos"), F.col("text").alias("char_profile"),
            F.expr("concat(lang, ' ', source)").alias("char_style"),
        )
    )


def fewshot_items(spark: SparkSession, sf: str) -> DataFrame:
    """Unlabelled documents are the items to judge."""
    labels = _labelled(spark, sf)
    return (
        spread(table(spark, sf, "documents"))
        .join(labels, "doc_id", "left_anti")
        .select(
            F.col("doc_id").alias("item_id"), F.col("text").alias("char_profile"),
            F.expr("concat(lang, ' ', source)").alias("char_style"),
        )
    )


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completions per prompt with a solution."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("prompt_id"),
        F.col("o_orderkey").alias("gen_id"),
        F.expr("""
          case o_orderkey % 4 when 0 then concat(' ', 1 + o_custkey % 5)
            when 1 then concat('<answer>', 1 + o_custkey % 5, '</answer>')
            when 2 then concat('<answer>', 1 + o_orderkey % 5, '</answer>')
            else concat('well <answer>', 1 + o_orderkey % 5, '</answer>') end""").alias("completion"),
    )


def solutions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("prompt_id"), F.expr("concat('<answer>', 1 + c_custkey % 5, '</answer>')").alias("solution")
    )


def phrasings(spark: SparkSession, sf: str) -> DataFrame:
    """Rubric phrasings: part types are the dimensions, parts the phrasings of a dimension.

    ``variant`` numbers the phrasings of a dimension 0..m-1.
    """
    from pyspark.sql import Window

    parts = table(spark, sf, "part")
    # parts of one type are numbered in fixed key ranges, so that no window holds a whole type
    counted = parts.withColumn("_bk", F.floor(F.col("p_partkey") / 65536))
    sizes = counted.groupBy("p_type", "_bk").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("p_type").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select("p_type", "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("p_type", "_bk").orderBy("p_partkey")
    return (
        counted.withColumn("_r", F.row_number().over(within))
        .join(start, ["p_type", "_bk"])
        .select(
            F.col("p_type").alias("dim"),
            F.expr("case p_type when 'ECONOMY' then 0 when 'LARGE' then 1 when 'MEDIUM' then 2 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end").alias("ord"),
            (F.col("_start") + F.col("_r") - 1).alias("variant"),
            F.col("p_name").alias("name"),
            F.expr("concat(p_brand, ' no ', p_partkey)").alias("description"),
            *[F.expr(f"concat('size ', p_size + {i})").alias(f"scale_{i}") for i in range(1, 6)],
        )
    )


def choices(spark: SparkSession, sf: str) -> DataFrame:
    """Multiple-choice questions about parts."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("item_id"),
        F.expr("concat('Which video shows part ', p_partkey, '?')").alias("question_text"),
        F.array("p_name", "p_brand", "p_type").alias("multi_choice"),
        F.expr("cast(p_partkey % 3 as int)").alias("answer"),
        F.expr("concat('audio/', p_partkey, '.wav')").alias("audio_path"),
    )


# ==== the same views as SQL ==========================================================================================


def _sql_rating(v: str) -> str:
    return (
        "case when l_returnflag = 'R' and l_linenumber = 1 then 'N/A'"
        " when l_linestatus = 'O' and l_linenumber = 2 then null"
        f" else cast(1 + cast(round({v}) as bigint) % 5 as varchar) end"
    )


def _sql_list(exprs: list[str]) -> str:
    return "[" + ", ".join(exprs).format(text="varchar") + "]"


_VOTE = "case when ({e}) % 3 = 0 then 'false' when ({e}) % 7 = 0 then 'N/A' when ({e}) % 11 = 0 then null else 'true' end"
_SCORE = "case when ({e}) % 7 = 0 then 'N/A' when ({e}) % 11 = 0 then null else cast(1 + ({e}) % 5 as varchar) end"
_ARGS = ["event_id + user_id", "event_id + 2 * user_id", "event_id * 3 + user_id", "event_id * 5 + 3 * user_id"]

VIEWS: dict[str, str] = {
    "ann_wide": f"""select l_orderkey as item_id, l_linenumber as annotator, {_sql_rating('l_quantity')} as quality,
        {_sql_rating('l_discount * 100')} as emphasis, {_sql_rating('l_tax * 100')} as fit from lineitem""",
    "ann_long": """select item_id, annotator, d.dim, case d.dim when 'quality' then quality when 'emphasis' then emphasis else fit end as raw
        from ann_wide cross join (values ('quality'), ('emphasis'), ('fit')) as d(dim)""",
    "judge": """select o_orderkey as item_id, t.trial, concat('audio/x/', o_orderkey, '.wav') as audio_path,
        case when o_orderkey % 11 = 0 and t.trial = 0 then 'Error: timeout'
           else concat(case when o_orderkey % 7 = 0 then concat('```json', chr(10)) else '' end,
             '{"quality": ', 1 + cast(round(o_totalprice) as bigint) % 5,
             case when o_orderkey % 13 = 0 then '' else concat(', "emphasis": ', 1 + (o_custkey + t.trial) % 5) end,
             ', "fit": ', 1 + (o_orderkey + t.trial) % 4, '.5}',
             case when o_orderkey % 7 = 0 then concat(chr(10), '```') else '' end) end as response
        from orders cross join (values (0), (1), (2)) as t(trial)""",
    "parsed": r"""select item_id, trial, coalesce(try_cast(j->>'$.quality' as double), 1.0) as quality,
        coalesce(try_cast(j->>'$.emphasis' as double), 1.0) as emphasis, coalesce(try_cast(j->>'$.fit' as double), 1.0) as fit
        from (select item_id, trial, try_cast(trim(regexp_replace(regexp_replace(response, '```json\s*', '', 'g'), '```\s*', '', 'g')) as json) as j from judge)""",
    "pred_long": """select item_id, d.dim, avg(v) as pred, stddev_pop(v) as trial_std, count(v) as trial_count
        from (select item_id, d.dim, case d.dim when 'quality' then quality when 'emphasis' then emphasis else fit end as v
              from parsed cross join (values ('quality'), ('emphasis'), ('fit')) as d(dim)) as d group by item_id, d.dim""",
    "truth_long": """select item_id, dim, avg(case when raw is null or upper(raw) = 'N/A' then 1.0 else cast(raw as double) end) as truth
        from ann_long group by item_id, dim""",
    "pairs": """select p.item_id, p.dim, p.pred, t.truth, p.trial_std, p.trial_count
        from pred_long p join truth_long t on p.item_id = t.item_id and p.dim = t.dim""",
    "votes": "select l_orderkey as item_id, l_returnflag <> 'R' as vote from lineitem",
    "gate_scores": "select o_orderkey as item_id, 1 + (o_custkey + o_orderkey) % 5 as model_score from orders",
    "dimres": """select event_id as id, event_type as dim,
        case when event_id % 50 = 0 then null else 1 + cast(round(value) as bigint) % 5 end as model_score,
        round(1 + (value - 4 * floor(value / 4)), 4) as probability_score,
        1 + (event_id + user_id) % 5 as r1,
        case when event_id % 9 = 0 then null else 1 + (event_id + 2 * user_id) % 5 end as r2,
        1 + (event_id * 3 + user_id) % 5 as r3 from events""",
    "dimres_truth": """select *, (cast(r1 as double) + coalesce(r2, 0) + r3) / (case when r2 is null then 2 else 3 end) as truth from dimres""",
    "predictor_pairs": """select 'Model' as predictor, dim, cast(model_score as double) as pred, truth from dimres_truth
        union all select 'Probability', dim, probability_score, truth from dimres_truth""",
    "folder_rows": """select id, dim, model_score, probability_score, id % 10 = 0 as no_own, cast(r1 as double) as v1,
        cast(r2 as double) as v2, case when id % 8 = 0 then 1.0 else cast(r3 as double) end as v3, r2, r3 from dimres""",
    "gate_rows": f"""select event_id as id, case when event_type = 'click' then 'content_pass' else event_type end as dim,
        cast(1 + cast(round(value) as bigint) % 5 as double) as model_score,
        round((value - 4 * floor(value / 4)) / 4, 4) as probability_score,
        case when event_type = 'click' then [{', '.join(_VOTE.format(e=a) for a in _ARGS)}]
             else [{', '.join(_SCORE.format(e=a) for a in _ARGS)}] end as ratings from events""",
    "outputs": """select event_id as id, event_type as dim,
        case event_id % 6 when 0 then concat('<think>ok</think><answer> ', 1 + event_id % 5, ' </answer>')
          when 1 then concat('<answer>', chr(10), 1 + user_id % 5, '/5', chr(10), '</answer>')
          when 2 then '<answer>N/A</answer>' when 3 then '<answer>good</answer>'
          when 4 then concat('score ', 1 + user_id % 5)
          else concat('answer>', 1 + user_id % 5, '</answer> <answer>9</answer>') end as raw_output from events""",
    "eval_texts": """select event_id as id, concat('Voice: ok', chr(10), 'Rhythmic Naturalness: ', 1 + event_id % 5, chr(10),
            'pitch variation:  ', 1 + user_id % 5, chr(10),
            case when event_id % 3 = 0 then concat('Style Consistency: ', 1 + (event_id + user_id) % 5, chr(10)) else '' end,
            '<pitch_dynamics>', 1 + (event_id * 2) % 5, '</pitch_dynamics>',
            case when event_id % 4 = 0 then '<stress_emphasis>n/a</stress_emphasis>'
                 else concat('<Stress_Emphasis>', 1 + (user_id * 3) % 5, '</Stress_Emphasis>') end,
            '<trait_embodiment>', 1 + (event_id + 2) % 5, ' of 5</trait_embodiment>',
            '<local_scene_fit>', 1 + (user_id + 3) % 5, '</local_scene_fit>') as text from events""",
    "items": "select doc_id as item_id, text as char_profile, concat(lang, ' ', source) as char_style, concat('scene ', source) as local_scene,"
    " concat('audio/', source, '/', doc_id, '.wav') as wav_path,"
    " case when doc_id % 4 = 0 then null else concat('a voice in ', lang) end as caption, "
    + ", ".join(f"{_sql_list(_ratings_expr(j))} as {d}" for j, (d, _, _) in enumerate(REALISM_DIMS))
    + ", "
    + ", ".join(f"{_sql_list(_ratings_expr(j + 20))} as {d}" for j, (d, _, _) in enumerate(ARCHETYPE_DIMS[:3]))
    + f", {_sql_list(_gate_expr())} as content_pass from documents",
    "fewshot_pool": """select doc_id as example_id, doc_id as pos, text as char_profile, concat(lang, ' ', source) as char_style
        from documents where doc_id in (select doc_id from labels)""",
    "fewshot_items": """select doc_id as item_id, text as char_profile, concat(lang, ' ', source) as char_style
        from documents where doc_id not in (select doc_id from labels)""",
    "completions": """select o_custkey as prompt_id, o_orderkey as gen_id,
        case o_orderkey % 4 when 0 then concat(' ', 1 + o_custkey % 5) when 1 then concat('<answer>', 1 + o_custkey % 5, '</answer>')
          when 2 then concat('<answer>', 1 + o_orderkey % 5, '</answer>') else concat('well <answer>', 1 + o_orderkey % 5, '</answer>') end as completion
        from orders""",
    "solutions": "select c_custkey as prompt_id, concat('<answer>', 1 + c_custkey % 5, '</answer>') as solution from customer",
    "phrasings": "select p_type as dim, case p_type when 'ECONOMY' then 0 when 'LARGE' then 1 when 'MEDIUM' then 2 when 'PROMO' then 3 when 'SMALL' then 4 else 5 end as ord,"
    " row_number() over (partition by p_type order by p_partkey) - 1 as variant, p_name as name, concat(p_brand, ' no ', p_partkey) as description, "
    + ", ".join(f"concat('size ', p_size + {i}) as scale_{i}" for i in range(1, 6))
    + " from part",
    "choices": """select p_partkey as item_id, concat('Which video shows part ', p_partkey, '?') as question_text,
        [p_name, p_brand, p_type] as multi_choice, cast(p_partkey % 3 as int) as answer, concat('audio/', p_partkey, '.wav') as audio_path from part""",
}

_NEEDS = {
    "ann_long": ["ann_wide"],
    "parsed": ["judge"],
    "pred_long": ["parsed"],
    "truth_long": ["ann_long"],
    "pairs": ["pred_long", "truth_long"],
    "dimres_truth": ["dimres"],
    "predictor_pairs": ["dimres_truth"],
    "folder_rows": ["dimres"],
}


def sql(body: str, *views: str, **ctes: str) -> str:
    """``body`` with the named views (and what they need) and further CTEs in front."""
    order: list[str] = []

    def visit(v: str) -> None:
        for n in _NEEDS.get(v, []):
            visit(n)
        if v not in order:
            order.append(v)

    for v in views:
        visit(v)
    parts = [f"{v} as ({VIEWS[v]})" for v in order] + [f"{n} as ({t})" for n, t in ctes.items()]
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
