"""Registered queries: score and answer extraction, prompts, few-shot selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.functions import scores as S
from judgealign.functions import text as T
from judgealign.operators import align, fewshot
from judgealign.operators import prompts as P
from judgealign.plans import fixtures as X
from judgealign.plans import reports, texts
from judgealign.plans.fixtures import sql
from judgealign.plans.q_align import q6, rounded
from judgealign.schemas import REALISM_DIMS
from judgealign.sources.readers import salvage_arrays

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SEED = 7


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def num(*parts: str, seed: int = SEED) -> str:
    """The pick number of :mod:`judgealign.functions.picks` in SQL; parts are SQL expressions."""
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 15) as bigint)"


# ---- extraction ---------------------------------------------------------------------------------------------

_ANSWER = r"""case when regexp_matches(raw_output, '(?s)answer>(.*?)</answer>') then regexp_replace(regexp_extract(raw_output, '(?s)answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') end"""


@query(
    "extract_answer_score",
    sql(
        r"select id, dim, a as answer, case when a is not null then coalesce(try_cast(nullif(regexp_extract(a, '(\d+)', 1), '') as bigint), 1) end as score from (select *, "
        + _ANSWER + " as a from outputs)",
        "outputs",
    ),
)
def extract_answer_score(spark, sf):
    out = X.outputs(spark, sf)
    return out.select("id", "dim", T.answer_text(F.col("raw_output")).alias("answer"), T.answer_score(F.col("raw_output")).alias("score"))


def _tag_sql(dim: str) -> str:
    return rf"try_cast(nullif(regexp_extract(regexp_extract(text, '(?s){dim}>(.*?)</{dim}>', 1), '(\d+)', 1), '') as bigint)"


@query(
    "extract_dim_tags",
    sql(
        "select id, unnest([" + ", ".join(lit(t) for t in T.REPORT_TAGS) + "]) as dim, unnest([" + ", ".join(_tag_sql(t) for t in T.REPORT_TAGS) + "]) as score from eval_texts",
        "eval_texts",
    ),
)
def extract_dim_tags(spark, sf):
    return X.eval_texts(spark, sf).select("id", F.explode(T.tagged_scores(F.col("text"), T.REPORT_TAGS)).alias("dim", "score"))


def _patterns_sql() -> str:
    p = T.report_patterns()
    vals = ", ".join(f"try_cast(nullif(regexp_extract(text, {lit(x)}, 1), '') as double)" for x in p.values())
    return f"select * from (select id, unnest([{', '.join(lit(c) for c in p)}]) as category, unnest([{vals}]) as rating from eval_texts) where rating is not null"


@query("extract_report_patterns", sql(_patterns_sql(), "eval_texts"))
def extract_report_patterns(spark, sf):
    return T.explode_report_ratings(X.eval_texts(spark, sf), ["id"])


@query(
    "rating_summary",
    sql(
        f"select category, {q6('avg(rating)')} as mean, {q6('stddev_pop(rating)')} as std, min(rating) as min, max(rating) as max, count(*) as count from r group by category",
        "eval_texts", r=_patterns_sql(),
    ),
)
def rating_summary(spark, sf):
    return rounded(reports.rating_summary(extract_report_patterns(spark, sf)), "mean", "std")


@query(
    "category_correlation",
    sql(
        f"select category, count(*) as n, {q6('case when stddev_pop(rating) > 0 then corr(rating, truth) end')} as pearson from r join (select event_id as id, value as truth from events) t using (id) group by category",
        "eval_texts", r=_patterns_sql(),
    ),
)
def category_correlation(spark, sf):
    """Correlation of each extracted category with one truth, over the whole data set."""
    from judgealign.operators import moments

    rated = extract_report_patterns(spark, sf)
    truth = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("truth"))
    sums = moments.moments(rated.join(truth, "id"), ["category"], "rating", "truth")
    return rounded(moments.metrics(sums).select("category", "n", "pearson"), "pearson")


_MARKED = "select id, concat(case when id % 2 = 0 then concat('user', chr(10), 'assistant', chr(10)) else '' end, raw_output) as t from outputs"
_CONTENT = "case when instr(t, 'assistant' || chr(10)) > 0 then substr(t, instr(t, 'assistant' || chr(10)) + 10)"
_FIRST = r"try_cast(nullif(regexp_extract({c}, '(\b\d+\.?\d*\b)', 1), '') as double)"


@query(
    "extract_first_float",
    sql(
        f"select id, {_FIRST.format(c=_CONTENT + ' else t end')} as optional_marker, {_FIRST.format(c=_CONTENT + ' end')} as required_marker from m",
        "outputs", m=_MARKED,
    ),
)
def extract_first_float(spark, sf):
    marked = X.outputs(spark, sf).select(
        "id", F.expr("concat(case when id % 2 = 0 then concat('user', chr(10), 'assistant', chr(10)) else '' end, raw_output)").alias("t")
    )
    return marked.select(
        "id", T.first_float(F.col("t"), False).alias("optional_marker"), T.first_float(F.col("t"), True).alias("required_marker")
    )


@query(
    "extract_mcq_answer",
    sql(
        r"""select id, regexp_replace(case when regexp_matches(raw_output, '(?s)<answer>(.*?)</answer>') then regexp_extract(raw_output, '(?s)<answer>(.*?)</answer>', 1) else raw_output end, '^\s+|\s+$', '', 'g') as answer from outputs""",
        "outputs",
    ),
)
def extract_mcq_answer(spark, sf):
    return X.outputs(spark, sf).select("id", T.mcq_answer(F.col("raw_output")).alias("answer"))


@query(
    "extract_fenced_json",
    sql(
        r"""select item_id, trial, case when json_valid(t) then t end as json_text from (select item_id, trial,
            regexp_replace(case when regexp_matches(response, '(?s)```json(.*?)```') then regexp_extract(response, '(?s)```json(.*?)```', 1) else response end, '^\s+|\s+$', '', 'g') as t from judge)""",
        "judge",
    ),
)
def extract_fenced_json(spark, sf):
    return X.judge(spark, sf).select("item_id", "trial", T.first_fenced_json(F.col("response")).alias("json_text"))


_NUMTEXT = "case event_id % 6 when 0 then cast(user_id as {s}) when 1 then concat(' ', user_id, '.5 ') when 2 then concat(user_id, 'd') when 3 then 'N/A' when 4 then concat(user_id, ',5') else concat('1e', user_id % 3) end"


@query(
    "validate_float_text",
    rf"""select id, t, regexp_matches(trim(t), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') as is_float,
        case when regexp_matches(trim(t), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') then try_cast(trim(t) as double) end as number
        from (select event_id as id, {_NUMTEXT.format(s='varchar')} as t from events)""",
)
def validate_float_text(spark, sf):
    df = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.expr(_NUMTEXT.format(s="string")).alias("t"))
    return df.select("id", "t", T.is_float_text(F.col("t")).alias("is_float"), T.as_float(F.col("t")).alias("number"))


_SCORE = "case when event_id % 30 = 0 then null when event_id % 3 = 0 then value else round(value) % 9 end"


@query(
    "validate_scores",
    f"""select id, dim, case when s is null then 'missing' when s < 1 or s > 5 then 'range' when s <> floor(s) then 'fraction' end as reason
        from (select event_id as id, event_type as dim, {_SCORE} as s from events)""",
)
def validate_scores(spark, sf):
    df = X.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("dim"), F.expr(_SCORE).alias("s"))
    return df.select("id", "dim", S.range_check(F.col("s"), F.lit(1), F.lit(5)).alias("reason"))


@query(
    "validate_form",
    """select p_partkey as id, case when p_type in ('SMALL', 'LARGE') then 'unknown' when s < (case when p_type = 'PROMO' then 0 else 1 end) or s > (case when p_type = 'PROMO' then 1 else 5 end) then 'range' end as reason
        from (select p_partkey, p_type, p_size % 8 as s from part)""",
)
def validate_form(spark, sf):
    """Scores against the form of their dimension: gate 0..1, scores 1..5."""
    dim = F.when(F.col("p_type").isin("SMALL", "LARGE"), "other").when(F.col("p_type") == "PROMO", "content_pass").otherwise("audio_quality")
    df = X.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), dim.alias("dim"), (F.col("p_size") % 8).alias("score"))
    return align.validate(df, "archetype").select("id", "reason")


_TOKENS = [4, 5, 6, 7, 8]


@query(
    "expected_score",
    f"""select vec_id, {q6(' + '.join(f'{i + 1} * exp(l[{i + 1}] - m)' for i in range(5)).join(['(', ')']) + ' / (' + ' + '.join(f'exp(l[{i + 1}] - m)' for i in range(5)) + ')')} as score
        from (select vec_id, l, list_max(l) as m from (select vec_id, [{', '.join(f'cast(embedding[{t + 1}] as double)' for t in _TOKENS)}] as l from embeddings))""",
)
def expected_score(spark, sf):
    """Vectors as vocabulary logits; five positions are the score tokens."""
    logits = S.pick_tokens(F.col("embedding"), _TOKENS)
    df = X.table(spark, sf, "embeddings").select("vec_id", logits.alias("l"))
    return rounded(df.select("vec_id", S.expected_score(F.col("l")).alias("score")), "score")


@query(
    "gate_probability",
    f"""select vec_id, case when f <= p then 1.0::double else 0.0::double end as gate, {q6('1 / (1 + exp(f - p))')} as p_pass
        from (select vec_id, cast(embedding[10] as double) as f, cast(embedding[11] as double) as p from embeddings)""",
)
def gate_probability(spark, sf):
    df = X.table(spark, sf, "embeddings").select("vec_id", S.pick_tokens(F.col("embedding"), [9, 10]).alias("l"))
    return rounded(
        df.select("vec_id", S.gate_score(F.col("l")).alias("gate"), S.expected_score(F.col("l"), low=0).alias("p_pass")), "p_pass"
    )


_SEP = """select o_orderkey as item_id, d.dim, (o_orderkey + d.k) % 7 = 0 as error,
    case when (o_orderkey + d.k) % 5 = 0 then 'no score' else concat(' ', 1 + (o_custkey + d.k) % 5, '.5') end as response
    from orders cross join (values ('quality', 1), ('emphasis', 2), ('fit', 3)) as d(dim, k)"""
_SEPV = "case when error then 1.0 else coalesce(try_cast(trim(response) as double), 1.0) end"


@query(
    "separate_merge",
    sql(
        "select item_id, " + ", ".join(f"cast(max(case when dim = '{d}' then {_SEPV} end) as double) as {d}" for d in X.DIMS3) + " from s group by item_id",
        s=_SEP,
    ),
)
def separate_merge(spark, sf):
    """One-dimension answers, errors and non-numbers as 1, merged to a row per item."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(k).alias("k")) for d, k in zip(X.DIMS3, (1, 2, 3))])
    long = X.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.inline(dims)).select(
        F.col("o_orderkey").alias("item_id"), "dim",
        F.expr("(o_orderkey + k) % 7 = 0").alias("error"),
        F.expr("case when (o_orderkey + k) % 5 = 0 then 'no score' else concat(' ', 1 + (o_custkey + k) % 5, '.5') end").alias("response"),
    )
    scored = long.select("item_id", "dim", S.separate_score(F.col("response"), F.col("error")).alias("score"))
    return align.merge_dimensions(scored, X.DIMS3)


def _salvage(spark, sf, rule: str) -> DataFrame:
    rows = X.table(spark, sf, "orders").selectExpr(*[c for c in (
        "o_orderkey as k",
        """concat('[{"id":"', o_orderkey, '","model_score":', 1 + o_custkey % 5, '},{"id":"', o_orderkey, 'b","model_score":2}',
           case o_orderkey % 4 when 0 then ']' when 1 then ',{"id":' when 2 then ',{"id":"z","m' else '' end) as t""",
    )])
    from pyspark.sql import types as Ty

    schema = Ty.StructType([Ty.StructField("id", Ty.StringType()), Ty.StructField("model_score", Ty.DoubleType())])
    return salvage_arrays(rows, "t", schema, rule)


def _salvage_sql(cut_inside: str, bracket_only: str) -> str:
    """Expected objects per text: both, the first one or none, by the way the text ends."""
    both = "[{'id': cast(o_orderkey as varchar), 'model_score': cast(1 + o_custkey % 5 as double)}, {'id': concat(o_orderkey, 'b'), 'model_score': 2.0::double}]"
    kept = {"both": both, "first": f"{both}[1:1]", "none": f"{both}[1:0]"}
    return f"""select k, o.id, o.model_score from (select o_orderkey as k, unnest(case o_orderkey % 4 when 0 then {both} when 1 then {both}
        when 2 then {kept[cut_inside]} else {kept[bracket_only]} end) as o from orders)"""


@query("salvage_boundary", _salvage_sql("both", "first"))
def salvage_boundary(spark, sf):
    """Truncated arrays: whole objects before the cut are kept."""
    return _salvage(spark, sf, "boundary")


@query("salvage_last_comma", _salvage_sql("none", "none"))
def salvage_last_comma(spark, sf):
    """Truncated arrays by the last-comma rule: a cut inside an object leaves nothing."""
    return _salvage(spark, sf, "last_comma")


# ---- prompts --------------------------------------------------------------------------------------------------

_USER = "concat('Global Profile: ', char_profile, ', Local Scene: ', local_scene, ', Available Traits: ', char_style)"


def user_column():
    return P.user_prompt(F.col("char_profile"), F.col("local_scene"), F.col("char_style"))


@query("request_combined", sql(f"select item_id, concat({lit(texts.GENERAL)}, chr(10), {_USER}) as prompt from items", "items"))
def request_combined(spark, sf):
    return P.combined_requests(X.items(spark, sf), texts.GENERAL, user_column())


@query(
    "request_separate",
    sql(
        f"""select item_id, d.dim, md5(concat({_USER}, chr(10), d.text)) as prompt_md5, length(concat({_USER}, chr(10), d.text)) as prompt_chars
        from items cross join (values {', '.join(f'({lit(d)}, {lit(texts.REALISM.text(d, True))})' for d in texts.REALISM.dims)}) as d(dim, text)""",
        "items",
    ),
)
def request_separate(spark, sf):
    out = P.separate_requests(X.items(spark, sf), texts.REALISM, True, user_column())
    return out.select("item_id", "dim", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("prompt_chars"))


@query(
    "rubric_lookup",
    "select event_id as id, event_type as dim, case event_type when 'click' then 'Rate the click in detail.' when 'view' then 'Rate the view.' when 'error' then 'Rate the error.' else '' end as prompt from events",
)
def rubric_lookup(spark, sf):
    """Detailed text where there is one, else the simple one, else empty."""
    events = X.table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("dim"),
        P.rubric_lookup(F.col("event_type"), texts.EVENTS, True).alias("prompt"),
    )


_KINDS = ["ROLE", "RoleVariation", "RoleCaption", "RoleVariationCaption", "RoleEmotion", "RoleAllFixOrder"]
_KIND = "case item_id % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " end"
_Q = "concat('Please evaluate the audio based on the following criteria:', chr(10), chr(10), {b}, chr(10), chr(10), 'Output the answer in <answer> </answer>.')"
_DP = texts.REALISM.text("emotion_accuracy", True)
_TAIL = f"case when kind like '%Caption' then {lit(chr(10) * 2 + texts.CAPTION)} when kind = 'RoleEmotion' then {lit(chr(10) * 2 + texts.EMOTION)} else '' end"
_CTAIL = f"case when kind = 'RoleCaption' then {lit(chr(10) * 2 + texts.CAPTION)} when kind = 'RoleEmotion' then {lit(chr(10) * 2 + texts.EMOTION)} else '' end"
_SINGLE_BODY = f"concat({lit(_DP)}, chr(10), chr(10), {_USER}, {_TAIL})"
_COMP_BODY = f"concat({_USER}, chr(10), chr(10), case when kind = 'RoleAllFixOrder' then {lit(texts.GENERAL_DETAILED)} else {lit(texts.GENERAL)} end)"


@query(
    "evaluation_messages",
    sql(
        f"""select item_id, kind, case when kind <> 'RoleAllFixOrder' then {_Q.format(b=_SINGLE_BODY)} end as question,
            concat({_Q.format(b=_COMP_BODY)}, {_CTAIL}) as comprehensive,
            case when kind like '%Caption' or kind = 'RoleEmotion' then concat('<think>', coalesce(caption, 'N/A'), '</think><') else '' end as prefill,
            cast(case when kind like '%Caption' or kind = 'RoleEmotion' then 2 else 1 end as int) as turns
        from (select *, {_KIND} as kind from items)""",
        "items",
    ),
)
def evaluation_messages(spark, sf):
    """Evaluation questions per dataset kind, with the known caption as prefill."""
    items = X.items(spark, sf).withColumn("kind", F.expr(_KIND))
    question = P.evaluation_text(F.col("kind"), F.lit(_DP), user_column(), texts.CAPTION, texts.EMOTION)
    prefill = P.think_prefill(F.col("kind"), F.col("caption"))
    return items.select(
        "item_id", "kind", question.alias("question"),
        P.comprehensive_text(F.col("kind"), user_column(), texts.GENERAL, texts.GENERAL_DETAILED, texts.CAPTION, texts.EMOTION).alias("comprehensive"),
        prefill.alias("prefill"),
        F.size(P.evaluation_messages(F.col("wav_path"), question, prefill)).alias("turns"),
    )


_VAR_ID = "concat_ws('_', 'dimension', dim, h.h, variant)"


@query(
    "prompt_variations",
    sql(
        f"""select id, dim as dimension_name, concat(t, 'Dimension: ', name, ' — ', description, chr(10), chr(10),
            '5: ', scale_5, chr(10), '4: ', scale_4, chr(10), '3: ', scale_3, chr(10), '2: ', scale_2, chr(10), '1: ', scale_1, chr(10),
            'Example output: <answer>', {num("'example'", 'id')} % 5 + 1, '</answer>') as prompt_text
        from (select *, {_VAR_ID} as id, h.t as t from phrasings cross join (values {', '.join(f'({i}, {lit(t)})' for i, t in enumerate(texts.HEADERS))}) as h(h, t))""",
        "phrasings",
    ),
)
def prompt_variations(spark, sf):
    """Every header with every phrasing of every dimension."""
    return P.dimension_variations(X.phrasings(spark, sf), texts.HEADERS, SEED)


def _combo_sql(style: str, row: str) -> str:
    return sql(
        f"""select concat('{style}_', i) as id, ({_choice(texts.SYSTEMS)})[{num(lit(style), "'system'", 'i')} % {len(texts.SYSTEMS)} + 1] as system_prompt,
            concat(string_agg({row}, '' order by ord), ({_choice(texts.OUTPUTS)})[{num(lit(style), "'schema'", 'i')} % {len(texts.OUTPUTS)} + 1]) as prompt_text
        from (select d.i, p.* from d join phrasings p on p.dim = d.dim and p.variant = d.variant) group by i""",
        "phrasings",
        d=f"select dim, i, {num(lit(style), 'i', 'dim')} % m as variant from (select dim, count(*) as m from phrasings group by dim) cross join (select i from range(1, 101) r(i))",
    )


def _choice(options: list[str]) -> str:
    return "[" + ", ".join(lit(o) for o in options) + "]"


@query("rubric_combinations_simple", _combo_sql("simple", "concat('• ', name, '  ', description, '  ', chr(10))"))
def rubric_combinations_simple(spark, sf):
    return P.rubric_combinations(X.phrasings(spark, sf), 100, SEED, texts.SYSTEMS, texts.OUTPUTS, "simple")


@query(
    "rubric_combinations_detailed",
    _combo_sql(
        "detailed",
        "concat('### ', ord + 1, '. ', name, '  ', chr(10), " + ", ".join(f"'|{k}|', scale_{k}, '|', chr(10)" for k in (5, 4, 3, 2, 1)) + ", chr(10))",
    ),
)
def rubric_combinations_detailed(spark, sf):
    return P.rubric_combinations(X.phrasings(spark, sf), 100, SEED, texts.SYSTEMS, texts.OUTPUTS, "detailed")


# ---- few-shot -----------------------------------------------------------------------------------------------------

K = 3


def _words(col: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({col}), '\s+'), lambda x: x <> ''))"


_SIMILAR = dict(
    wi=f"select item_id, f, unnest(w) as w from (select item_id, 1 as f, {_words('char_profile')} as w from fewshot_items union all select item_id, 2, {_words('char_style')} from fewshot_items)",
    we=f"select example_id, f, unnest(w) as w from (select example_id, 1 as f, {_words('char_profile')} as w from fewshot_pool union all select example_id, 2, {_words('char_style')} from fewshot_pool)",
    ov="select item_id, example_id, count(*) as score from wi join we on wi.f = we.f and wi.w = we.w group by item_id, example_id",
    sel=f"""select item_id, cast(rank as int) as rank, example_id, score from (select i.item_id, p.example_id, coalesce(o.score, 0) as score,
        row_number() over (partition by i.item_id order by coalesce(o.score, 0) desc, p.pos) as rank
        from (select item_id from fewshot_items) i cross join (select example_id, pos from fewshot_pool) p left join ov o on o.item_id = i.item_id and o.example_id = p.example_id) where rank <= {K}""",
)


@query("fewshot_similar", sql("select * from sel", "fewshot_items", "fewshot_pool", **_SIMILAR))
def fewshot_similar(spark, sf):
    """The labelled documents with the greatest word overlap for every unlabelled one."""
    return fewshot.similar(X.fewshot_items(spark, sf), X.fewshot_pool(spark, sf), ["char_profile", "char_style"], K)


@query("fewshot_similar_sharded", sql("select * from sel", "fewshot_items", "fewshot_pool", **_SIMILAR))
def fewshot_similar_sharded(spark, sf):
    """The same with many small shards and two slices of the items."""
    return fewshot.similar(X.fewshot_items(spark, sf), X.fewshot_pool(spark, sf), ["char_profile", "char_style"], K, shards=7, slices=2)


_RND = ", ".join(f"{num(lit('fewshot'), 'item_id', str(j))} % (m - {j}) as d{j}" for j in range(3))


@query(
    "fewshot_random",
    sql(
        """select item_id, unnest([1, 2, 3]) as rank, e.example_id from (
              select item_id, unnest([x0, x1, x2]) as x, unnest([1, 2, 3]) as rk from (
                select *, d2 + (case when d2 >= least(x0, x1) then 1 else 0 end) + (case when d2 + (case when d2 >= least(x0, x1) then 1 else 0 end) >= greatest(x0, x1) then 1 else 0 end) as x2
                from (select *, d0 as x0, d1 + (case when d1 >= d0 then 1 else 0 end) as x1 from draws))) s
            join idx e on e.x = s.x""".replace("select item_id, unnest([1, 2, 3]) as rank, e.example_id", "select item_id, cast(rk as int) as rank, e.example_id"),
        "fewshot_items", "fewshot_pool",
        idx="select example_id, row_number() over (order by pos) - 1 as x from fewshot_pool",
        draws=f"select item_id, {_RND} from (select item_id, (select count(*) from fewshot_pool) as m from fewshot_items)",
    ),
)
def fewshot_random(spark, sf):
    return fewshot.random_examples(X.fewshot_items(spark, sf), X.fewshot_pool(spark, sf), K, SEED)


@query(
    "fewshot_diverse",
    sql(
        """select cast(rank as int) as rank, example_id, filler from (select example_id, filler, row_number() over (order by filler, pos, h) as rank from (
              select example_id, false as filler, pos, '' as h from firsts union all
              select * from (select example_id, true, 0, md5(concat_ws('|', '7', 'diverse', example_id)) as h from fewshot_pool where example_id not in (select example_id from firsts) order by h, example_id limit 200))) where rank <= 200""",
        "fewshot_pool",
        firsts="select example_id, pos from (select example_id, pos, row_number() over (partition by substr(coalesce(char_profile, ''), 1, 50) order by pos) as r from fewshot_pool) where r = 1 order by pos limit 200",
    ),
)
def fewshot_diverse(spark, sf):
    """First example per profile start in file order, filled up at random."""
    return fewshot.diverse(X.fewshot_pool(spark, sf), 200, SEED)


def _gold(d: str) -> str:
    return f"round_even(list_avg(list_transform({d}, lambda r: case when r is null or r = 'N/A' then 1.0 when r = 'true' then 1.0 when r = 'false' then 0.0 else cast(r as double) end)), 0)::int"


_GOLD_DIMS = [d for d, _, _ in REALISM_DIMS] + ["content_pass"]


@query(
    "fewshot_gold",
    sql("select item_id, concat('{', " + ", ',', ".join(f"'\"{d}\":', {_gold(d)}" for d in _GOLD_DIMS) + ", '}') as annotation_prompt from items", "items"),
)
def fewshot_gold(spark, sf):
    return fewshot.gold_scores(X.items(spark, sf), {d: F.col(d) for d in _GOLD_DIMS})


_W = {k: lit(v).replace("\n", "' || chr(10) || '") for k, v in fewshot.WORDING.items()}
_EX = f"concat({_W['example']}, rank, {_W['listen']}, e.char_profile)"
_CUR = f"concat({_W['current']}, char_profile)"


@query(
    "fewshot_conversations",
    sql(
        f"""select item_id, 0 as turn, 'system' as role, 'You judge speech.' as text, null::varchar as audio from fewshot_items
            union all select item_id, 1, 'user', concat({lit(texts.GENERAL)}, {_W['intro']}, 3), null from fewshot_items
            union all select s.item_id, 2 * s.rank, 'user', {_EX}, concat('audio/', s.example_id, '.wav') from sel s join fewshot_pool e on e.example_id = s.example_id
            union all select s.item_id, 2 * s.rank + 1, 'assistant', concat({_W['gold']}, '{{"quality":', l.quality, ',"toxic":', l.toxic, '}}'), null from sel s join labels l on l.doc_id = s.example_id
            union all select item_id, 8, 'user', {_CUR}, concat('audio/', item_id, '.wav') from fewshot_items""",
        "fewshot_items", "fewshot_pool", **_SIMILAR,
    ),
)
def fewshot_conversations(spark, sf):
    """System, rubric, example turns with gold answers, current item; one row per turn."""
    wav = lambda c: F.concat(F.lit("audio/"), F.col(c).cast("string"), F.lit(".wav"))
    items = X.fewshot_items(spark, sf)
    pool = X.fewshot_pool(spark, sf)
    labels = X.table(spark, sf, "labels").select(
        F.col("doc_id").alias("example_id"), F.to_json(F.struct("quality", "toxic")).alias("annotation_prompt")
    )
    examples = pool.join(labels, "example_id").select(
        "example_id", F.col("char_profile").alias("prompt"), wav("example_id").alias("audio"), "annotation_prompt"
    )
    selected = fewshot.similar(items, pool, ["char_profile", "char_style"], K)
    asked = items.select("item_id", F.col("char_profile").alias("prompt"), wav("item_id").alias("audio"))
    talks = fewshot.conversations(asked, selected, examples, texts.GENERAL, "You judge speech.")
    return talks.select("item_id", F.posexplode_outer("messages").alias("turn", "m")).select(
        "item_id", "turn", F.col("m.role").alias("role"), F.col("m.content")[0]["text"].alias("text"),
        F.get(F.col("m.content"), F.lit(1))["audio"].alias("audio"),
    )
