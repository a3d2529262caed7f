"""Registered queries: training rows, rewards, attempts, resume, logs, streaming, judge calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_types

from judgealign.functions import text as T
from judgealign.operators import align, corpus, moments, rewards
from judgealign.operators.judge import run_judge
from judgealign.operators.prompts import archetype_prompt
from judgealign.plans import fixtures as X
from judgealign.plans import texts
from judgealign.plans.fixtures import sql
from judgealign.plans.q_align import q6, rounded
from judgealign.plans.q_text import _ANSWER, SEED, lit, num, user_column
from judgealign.schemas import ARCHETYPE_DIMS, REALISM_DIMS
from judgealign.session import shared_dir, ship_with_tasks
from judgealign.sources import readers
from judgealign.streaming import incremental

ship_with_tasks(__name__)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_DIMS = [d for d, _, _ in REALISM_DIMS]
_LABELS = {d: label for d, _, label in REALISM_DIMS}
_ARCHE = [d for d, _, _ in ARCHETYPE_DIMS]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def _fields(dims: list[str]):
    return {d: F.col(d) for d in dims}


def _rows(df: DataFrame, *names: str) -> DataFrame:
    """Training rows as flat columns: audio, md5 of the prompt text, solution."""
    return df.select(
        "item_id", *names, F.col("prompt")[0]["content"][0]["audio_url"].alias("audio_url"),
        F.md5(corpus.message_text(F.col("prompt"))).alias("text_md5"), "solution",
    )


# ---- SQL building blocks ----------------------------------------------------------------------------------

_USER = "concat('Global Profile: ', char_profile, ', Local Scene: ', local_scene, ', Available Traits: ', char_style)"
_ASK = "concat('Please evaluate the audio based on the following criteria:', chr(10), chr(10), {b}, chr(10), chr(10), 'Output the answer in <answer> </answer>.')"


def _case(dim_sql: str, values: dict[str, str]) -> str:
    return f"case {dim_sql} " + " ".join(f"when {lit(d)} then {v}" for d, v in values.items()) + " end"


def _pick_one(ratings: str, dim: str) -> str:
    v = f"list_filter({ratings}, lambda r: r is not null)"
    chosen = f"({v})[{num(lit('rating'), 'item_id', dim)} % len({v}) + 1]"
    return f"case when len({v}) = 0 then '1' when {chosen} = 'N/A' then '1' else {chosen} end"


def _pick_arche(ratings: str, dim: str) -> str:
    v = f"list_transform({ratings}, lambda r: coalesce(r, '1'))"
    chosen = f"({v})[{num(lit('rating'), 'item_id', dim)} % len({v}) + 1]"
    return f"case {chosen} when 'true' then '1' when 'false' then '0' else {chosen} end"


def _list(options: list[str]) -> str:
    return "[" + ", ".join(lit(o) for o in options) + "]"


def _single_sql(dims, rubric, extra="", caption=None, arche=False) -> str:
    user = "char_profile" if arche else _USER
    dim = f"({_list(dims)})[{num(lit('dim'), 'item_id')} % {len(dims)} + 1]"
    ratings = _case("dim", {d: d for d in dims})
    body = f"concat({_case('dim', {d: lit(rubric.text(d, True)) for d in dims})}, chr(10), chr(10), {user}{', ' + lit(chr(10) * 2 + extra) if extra else ''})"
    rating = _pick_arche("ratings", "dim") if arche else _pick_one("ratings", "dim")
    solution = f"concat('<answer>', {rating}, '</answer>')"
    if caption:
        solution = f"concat('<think>', coalesce({caption}, 'N/A'), '</think>', {solution})"
    return sql(
        f"select item_id, dim, wav_path as audio_url, md5({_ASK.format(b=body)}) as text_md5, {solution} as solution from (select *, {ratings} as ratings from (select *, {dim} as dim from items))",
        "items",
    )


@query("corpus_role", _single_sql(_DIMS, texts.REALISM))
def corpus_role(spark, sf):
    """One random dimension and one random rating per item."""
    rows = corpus.single_dimension(X.items(spark, sf), _fields(_DIMS), texts.REALISM, SEED, user_column(), F.col("wav_path"))
    return _rows(rows, "dim")


@query("corpus_role_caption", _single_sql(_DIMS, texts.REALISM, texts.CAPTION, "caption"))
def corpus_role_caption(spark, sf):
    rows = corpus.single_dimension(
        X.items(spark, sf), _fields(_DIMS), texts.REALISM, SEED, user_column(), F.col("wav_path"), texts.CAPTION, F.col("caption")
    )
    return _rows(rows, "dim")


@query("corpus_role_emotion", _single_sql(_DIMS, texts.REALISM, texts.EMOTION, "caption"))
def corpus_role_emotion(spark, sf):
    rows = corpus.single_dimension(
        X.items(spark, sf), _fields(_DIMS), texts.REALISM, SEED, user_column(), F.col("wav_path"), texts.EMOTION, F.col("caption")
    )
    return _rows(rows, "dim")


@query("corpus_archetype", _single_sql(_ARCHE, texts.ARCHETYPE, arche=True))
def corpus_archetype(spark, sf):
    rows = corpus.single_dimension(
        X.items(spark, sf), _fields(_ARCHE), texts.ARCHETYPE, SEED, archetype_prompt(F.col("char_profile"), heading=False), F.col("wav_path"), policy="pick_one_arche"
    )
    return _rows(rows, "dim")


def _all_sql(flexible: bool, consistent: bool) -> str:
    general = texts.GENERAL if flexible else texts.GENERAL_DETAILED
    if consistent:
        def score(d):
            r = f"({d})[pos + 1]"
            return f"case when {r} = 'N/A' then '1' else coalesce({r}, '1') end"
    else:
        def score(d):
            return _pick_one(d, lit(d))
    pieces = [f"{{'h': {'md5(concat_ws(chr(124), ' + lit(str(SEED)) + ', ' + lit('order') + ', item_id, ' + lit(d) + '))' if flexible else lit(f'{i:02d}')}, 'o': concat('[{_LABELS[d]}]', {score(d)})}}" for i, d in enumerate(_DIMS)]
    most = "greatest(" + ", ".join(f"len(list_filter({d}, lambda r: r is not null))" for d in _DIMS) + ")"
    at = f"case when {most} > 0 then {num(lit('annotator'), 'item_id')} % {most} else 0 end"
    return sql(
        f"""select item_id, wav_path as audio_url, md5({_ASK.format(b=f"concat({_USER}, chr(10), chr(10), {lit(general)})")}) as text_md5,
            concat('<answer>', array_to_string(list_transform(list_sort([{', '.join(pieces)}]), lambda s: s.o), ''), '</answer>') as solution
        from (select *, {at} as pos from items)""",
        "items",
    )


def _all(spark, sf, flexible: bool, consistent: bool) -> DataFrame:
    general = texts.GENERAL if flexible else texts.GENERAL_DETAILED
    rows = corpus.all_dimensions(
        X.items(spark, sf), _fields(_DIMS), _LABELS, general, SEED, user_column(), F.col("wav_path"), flexible, consistent
    )
    return _rows(rows)


@query("corpus_all_fixed", _all_sql(False, False))
def corpus_all_fixed(spark, sf):
    return _all(spark, sf, False, False)


@query("corpus_all_fixed_consistent", _all_sql(False, True))
def corpus_all_fixed_consistent(spark, sf):
    return _all(spark, sf, False, True)


@query("corpus_all_flexible", _all_sql(True, False))
def corpus_all_flexible(spark, sf):
    return _all(spark, sf, True, False)


@query("corpus_all_flexible_consistent", _all_sql(True, True))
def corpus_all_flexible_consistent(spark, sf):
    return _all(spark, sf, True, True)


_VARIATIONS = f"""select concat('v', p_partkey) as id, ({_list(_DIMS)})[p_partkey % {len(_DIMS)} + 1] as dimension_name,
    concat('Rate ', p_name, ' of ', p_brand) as prompt_text from part"""


def variations(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(d) for d in _DIMS])
    return X.table(spark, sf, "part").select(
        F.expr("concat('v', p_partkey)").alias("id"),
        F.get(names, F.expr(f"cast(p_partkey % {len(_DIMS)} as int)")).alias("dimension_name"),
        F.expr("concat('Rate ', p_name, ' of ', p_brand)").alias("prompt_text"),
    )


def _variation_sql(extra: str = "", caption: str | None = None) -> str:
    text = f"concat(prompt_text, chr(10), chr(10), {_USER}{', ' + lit(chr(10) * 2 + extra) if extra else ''}, chr(10), chr(10))"
    solution = f"concat('<answer>', {_pick_one('ratings', 'dim')}, '</answer>')"
    if caption:
        solution = f"concat('<think>', coalesce({caption}, 'N/A'), '</think>', {solution})"
    return sql(
        f"""select item_id, dim, id as variation, wav_path as audio_url, md5({text}) as text_md5, {solution} as solution
        from (select i.*, v.id, v.prompt_text, v.dimension_name as dim, {_case('v.dimension_name', {d: 'i.' + d for d in _DIMS})} as ratings
              from items i join numbered v on v.v = {num(lit('variation'), 'i.item_id')} % (select count(*) from numbered))""",
        "items",
        variations=_VARIATIONS,
        numbered="select *, row_number() over (order by md5(id), id) - 1 as v from variations",
    )


@query("corpus_role_reasoning", _variation_sql())
def corpus_role_reasoning(spark, sf):
    rows = corpus.with_variation(X.items(spark, sf), _fields(_DIMS), variations(spark, sf), SEED, user_column(), F.col("wav_path"))
    return _rows(rows, "dim", "variation")


@query("corpus_role_variation", _variation_sql())
def corpus_role_variation(spark, sf):
    return corpus_role_reasoning(spark, sf)


@query("corpus_variation_caption", _variation_sql(texts.CAPTION, "caption"))
def corpus_variation_caption(spark, sf):
    rows = corpus.with_variation(
        X.items(spark, sf), _fields(_DIMS), variations(spark, sf), SEED, user_column(), F.col("wav_path"), texts.CAPTION, F.col("caption")
    )
    return _rows(rows, "dim", "variation")


@query(
    "corpus_multiple_choice",
    sql(
        """select item_id, audio_path as audio_url, md5(concat(replace(question_text, 'video', 'audio'), ' Please choose the answer from the following options: [''',
            array_to_string(multi_choice, ''', '''), ''']. Output the final answer in <answer> </answer>.')) as text_md5,
            concat('<answer>', multi_choice[answer + 1], '</answer>') as solution from choices""",
        "choices",
    ),
)
def corpus_multiple_choice(spark, sf):
    return _rows(corpus.multiple_choice(X.choices(spark, sf)))


_KINDS = [
    "AVQA", "ROLE", "RoleAllFixOrder", "RoleAllFixOrderConsistent", "RoleAllFlexOrder", "RoleAllFlexOrderConsistent",
    "RoleCaption", "RoleEmotion", "RoleReasoning", "RoleVariation", "RoleVariationCaption", "Arche", None, "Other",
]
_KIND = "case item_id % 14 " + " ".join(f"when {i} then {lit(k) if k else 'null'}" for i, k in enumerate(_KINDS)) + " end"


def _kind_sql(name: str, sub: str, dim: str = "null::varchar", variation: str = "null::varchar") -> str:
    numbers = ", ".join(str(i) for i, k in enumerate(_KINDS) if (k or "ROLE") == name)
    return (
        f"select item_id, '{name}' as dataset_name, {dim} as dim, {variation} as variation, text_md5, solution"
        f" from ({sub}) where item_id % 14 in ({numbers})"
    )


_CHOICE_SQL = """select doc_id as item_id, md5(concat('Which audio shows ', doc_id, '? Please choose the answer from the following options: [''',
    lang, ''', ''', source, ''']. Output the final answer in <answer> </answer>.')) as text_md5,
    concat('<answer>', case when doc_id % 2 = 0 then lang else source end, '</answer>') as solution from documents"""


@query(
    "corpus_dispatch",
    " union all ".join([
        _kind_sql("AVQA", _CHOICE_SQL),
        _kind_sql("ROLE", _single_sql(_DIMS, texts.REALISM), "dim"),
        *[_kind_sql(f"RoleAll{'Flex' if flex else 'Fix'}Order{'Consistent' if same else ''}", _all_sql(flex, same)) for flex in (False, True) for same in (False, True)],
        _kind_sql("RoleCaption", _single_sql(_DIMS, texts.REALISM, texts.CAPTION, "caption"), "dim"),
        _kind_sql("RoleEmotion", _single_sql(_DIMS, texts.REALISM, texts.EMOTION, "caption"), "dim"),
        _kind_sql("RoleReasoning", _variation_sql(), "dim", "variation"),
        _kind_sql("RoleVariation", _variation_sql(), "dim", "variation"),
        _kind_sql("RoleVariationCaption", _variation_sql(texts.CAPTION, "caption"), "dim", "variation"),
        _kind_sql("Arche", _single_sql(_ARCHE, texts.ARCHETYPE, arche=True), "dim"),
        "select doc_id, 'Other', null, null, null, null from documents where doc_id % 14 = 13",
    ]),
)
def corpus_dispatch(spark, sf):
    """Mixed items of all kinds, an unset kind (ROLE) and an unknown one (kept, without a prompt), in one scan."""
    items = X.items(spark, sf).withColumns(
        {
            "dataset_name": F.expr(_KIND),
            "audio_path": F.col("wav_path"),
            "question_text": F.expr("concat('Which video shows ', item_id, '?')"),
            "multi_choice": F.split("char_style", " "),
            "answer": F.expr("cast(item_id % 2 as int)"),
        }
    )
    user, audio, cap = user_column(), F.col("wav_path"), F.col("caption")
    fields = _fields(_DIMS)

    def single(extra="", caption=None):
        return corpus.single_dimension_row(fields, texts.REALISM, SEED, user, audio, extra, caption)

    def every(flexible, consistent):
        general = texts.GENERAL if flexible else texts.GENERAL_DETAILED
        return corpus.all_dimensions_row(fields, _LABELS, general, SEED, user, audio, flexible, consistent)

    kinds = {
        "AVQA": corpus.multiple_choice_row(),
        "ROLE": single(),
        "RoleAllFixOrder": every(False, False),
        "RoleAllFixOrderConsistent": every(False, True),
        "RoleAllFlexOrder": every(True, False),
        "RoleAllFlexOrderConsistent": every(True, True),
        "RoleCaption": single(texts.CAPTION, cap),
        "RoleEmotion": single(texts.EMOTION, cap),
        "RoleReasoning": corpus.variation_row(fields, SEED, user, audio),
        "RoleVariation": corpus.variation_row(fields, SEED, user, audio),
        "RoleVariationCaption": corpus.variation_row(fields, SEED, user, audio, texts.CAPTION, cap),
        "Arche": corpus.single_dimension_row(_fields(_ARCHE), texts.ARCHETYPE, SEED, archetype_prompt(F.col("char_profile"), heading=False), audio, policy="pick_one_arche"),
    }
    rows = corpus.dispatch(corpus.join_variations(items, variations(spark, sf), SEED), kinds)
    return rows.select("item_id", "dataset_name", "dim", "variation", F.md5(corpus.message_text(F.col("prompt"))).alias("text_md5"), "solution")


@query(
    "repeat_sampler",
    f"""select ((i // 16 * 2 + r) * 16 + i % 16) * 3 + c as position, o_orderkey
        from (select o_orderkey, row_number() over (order by md5(concat_ws('|', '{SEED}', 'sampler', o_orderkey)), o_orderkey) - 1 as i, count(*) over () // 16 as whole from orders),
             (values (0), (1)) as t(r), (values (0), (1), (2)) as u(c) where i // 16 < whole""",
)
def repeat_sampler(spark, sf):
    return corpus.repeat_sampler(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", batch=16, repeats=2, copies=3, seed=SEED)


# ---- rewards ----------------------------------------------------------------------------------------------------

_BODY = r"trim(case when regexp_matches({t}, '<answer>(.*?)</answer>') then regexp_extract({t}, '<answer>(.*?)</answer>', 1) else {t} end)"
_REWARDED = rf"""select c.prompt_id, c.gen_id, case when {_BODY.format(t='completion')} = {_BODY.format(t='solution')} then 1.0::double else 0.0::double end as reward_accuracy,
    case when regexp_full_match(completion, '(?s)<answer>.*?</answer>') then 1.0::double else 0.0::double end as reward_format
    from completions c join solutions s on c.prompt_id = s.prompt_id"""
_WEIGHTED = "select *, reward_accuracy + 0.5 * reward_format as reward from rewarded"


def rewarded(spark, sf) -> DataFrame:
    joined = X.completions(spark, sf).join(X.solutions(spark, sf), "prompt_id")
    return rewards.add_rewards(joined, ["accuracy", "format"], {"format": 0.5})


@query(
    "reward_columns",
    sql("select prompt_id, gen_id, reward_accuracy, reward_format, cast(reward as double) as reward from weighted", "completions", "solutions", rewarded=_REWARDED, weighted=_WEIGHTED),
)
def reward_columns(spark, sf):
    return rewarded(spark, sf).select("prompt_id", "gen_id", "reward_accuracy", "reward_format", "reward")


@query(
    "reward_advantage",
    sql(
        f"""select prompt_id, gen_id, {q6('(reward - avg(reward) over (partition by prompt_id)) / (stddev_samp(reward) over (partition by prompt_id) + 1e-4)')} as advantage from weighted""",
        "completions", "solutions", rewarded=_REWARDED, weighted="select prompt_id, gen_id, cast(reward_accuracy + 0.5 * reward_format as double) as reward from rewarded",
    ),
)
def reward_advantage(spark, sf):
    return rounded(rewards.advantages(rewarded(spark, sf)).select("prompt_id", "gen_id", "advantage"), "advantage")


@query(
    "reward_means",
    sql(
        f"""select {q6('avg(reward_accuracy)')} as mean_accuracy, {q6('avg(reward_format)')} as mean_format, {q6('avg(reward)')} as mean_reward,
            {q6('(select avg(s) from (select stddev_samp(reward) as s from weighted group by prompt_id))')} as mean_group_std from weighted""",
        "completions", "solutions", rewarded=_REWARDED, weighted=_WEIGHTED,
    ),
)
def reward_means(spark, sf):
    out = rewards.reward_means(rewarded(spark, sf), ["accuracy", "format"])
    return rounded(out, "mean_accuracy", "mean_format", "mean_reward", "mean_group_std")


# ---- attempts, resume, logs, checkpoints ----------------------------------------------------------------------------

_ATTEMPTS = """select event_id // 3 as item_id, event_id % 3 as attempt,
    case when (event_id + user_id) % 4 = 0 then null when (event_id + user_id) % 4 < 3 then 'nan'::double else 1.0 + event_id % 5 end as score,
    case when (event_id + user_id) % 8 = 1 then 'N/A here' else 'text' end as response,
    case when (event_id // 3) % 2 = 0 then 2.5::double end as fallback from events"""


@query(
    "attempt_merge",
    sql(
        """select item_id, cast(coalesce(min_by(u, attempt) filter (where u is not null), max(fallback), 3.0) as double) as score,
            count(u) > 0 as succeeded, count(*) as n_attempts
        from (select *, case when score is not null and not isnan(score) then score when response like '%N/A%' then 1.0 end as u from a) group by item_id""",
        a=_ATTEMPTS,
    ),
)
def attempt_merge(spark, sf):
    """First usable of up to three attempts, then a fallback, then 3.0."""
    log = X.table(spark, sf, "events").selectExpr(
        "event_id div 3 as item_id", "event_id % 3 as attempt",
        "case when (event_id + user_id) % 4 = 0 then null when (event_id + user_id) % 4 < 3 then double('nan') else 1.0D + event_id % 5 end as score",
        "case when (event_id + user_id) % 8 = 1 then 'N/A here' else 'text' end as response",
        "case when (event_id div 3) % 2 = 0 then 2.5D end as fallback",
    )
    return align.merge_attempts(log, fallback="fallback")


@query(
    "first_usable_source",
    """select event_id as id, coalesce(nullif(a, ''), nullif(b, ''), '') as text from
       (select event_id, case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then '' end as a, case when event_id % 2 = 0 then props end as b from events)""",
)
def first_usable_source(spark, sf):
    df = X.table(spark, sf, "events").selectExpr(
        "event_id as id", "case when event_id % 3 = 0 then event_type when event_id % 3 = 1 then '' end as a",
        "case when event_id % 2 = 0 then props end as b",
    )
    return df.select("id", align.first_source(df, ["a", "b"]).alias("text"))


@query("resume_pending", "select doc_id, lang, source from documents where doc_id not in (select doc_id from labels)")
def resume_pending(spark, sf):
    """Items without a stored result: documents without labels."""
    done = X.table(spark, sf, "labels").select("doc_id")
    return align.pending(X.table(spark, sf, "documents").select("doc_id", "lang", "source"), done, "doc_id")


_LINE = "case event_type when 'click' then concat('sound : ', value, ' %') when 'view' then concat('music : ', value) when 'purchase' then concat('speech : ', value) when 'error' then concat('Total Accuracy: ', value) else 'progress' end"


@query(
    "accuracy_leaderboard",
    """select user_id as iter, max(value) filter (where event_type = 'click') as sound, max(value) filter (where event_type = 'view') as music,
        max(value) filter (where event_type = 'purchase') as speech, max(value) filter (where event_type = 'error') as total_accuracy
       from events group by user_id order by total_accuracy desc nulls last, iter""",
)
def accuracy_leaderboard(spark, sf):
    """Runs by total accuracy from log lines."""
    lines = X.table(spark, sf, "events").select(F.col("user_id").alias("iter"), F.expr(_LINE).alias("value"))
    return readers.leaderboard(readers.parse_accuracy_lines(lines))


@query(
    "checkpoint_latest",
    "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as r from events) where r = 1",
)
def checkpoint_latest(spark, sf):
    """The newest record per model and prompt type."""
    df = X.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return readers.latest_per(df, ["user_id", "event_type"], "ts", "event_id").drop("ts")


# ---- streaming and judge ---------------------------------------------------------------------------------------------


def _stream(spark, sf, name: str) -> DataFrame:
    """The table, a file or a folder of part files, as a stream."""
    return incremental.stream_rows(spark, f"{sf}/{name}.parquet*", X.table(spark, sf, name).schema, "parquet")


_RAW = """case event_id % 6 when 0 then concat('<think>ok</think><answer> ', 1 + event_id % 5, ' </answer>')
    when 1 then concat('<answer>', chr(10), 1 + user_id % 5, '/5', chr(10), '</answer>')
    when 2 then '<answer>N/A</answer>' when 3 then '<answer>good</answer>' when 4 then concat('score ', 1 + user_id % 5)
    else concat('answer>', 1 + user_id % 5, '</answer> <answer>9</answer>') end"""


@query(
    "stream_increment",
    sql(
        r"select id as item_id, case when a is not null then coalesce(try_cast(nullif(regexp_extract(a, '(\d+)', 1), '') as bigint), 1) end as score from (select *, " + _ANSWER + " as a from outputs)",
        "outputs",
    ),
)
def stream_increment(spark, sf):
    """Arriving judge answers are scored once; a second run over the same files adds nothing."""
    base = shared_dir(spark, "increment")

    def evaluate(batch: DataFrame) -> DataFrame:
        raw = batch.select("item_id", F.expr(_RAW.replace("event_id", "item_id")).alias("raw"))
        return raw.select("item_id", T.answer_score(F.col("raw")).alias("score"))

    stream = _stream(spark, sf, "events").withColumnRenamed("event_id", "item_id")

    for run in ("a", "b"):  # the second run has a new checkpoint, so it sees every file again
        incremental.run_increment(stream, f"{base}/out", f"{base}/cp-{run}", evaluate).awaitTermination()
    schema = T_types.StructType().add("item_id", "long").add("score", "long")
    return incremental.stored(spark, f"{base}/out", schema)


def _stream_pairs(spark, sf) -> DataFrame:
    return _stream(spark, sf, "events").select(
        F.col("event_type").alias("dim"), F.expr("round(1 + (value - 4 * floor(value / 4)), 4)").alias("pred"),
        F.expr("cast(1 + (event_id + user_id) % 5 as double)").alias("truth"),
    )


@query(
    "stream_moments",
    sql(
        f"""select dim, count(*) as n, {q6('corr(pred, truth)')} as pearson, {q6('avg(abs(pred - truth))')} as mae from (
            select dim, probability_score as pred, cast(r1 as double) as truth from dimres union all select 'OVERALL', probability_score, r1 from dimres) group by dim""",
        "dimres",
    ),
)
def stream_moments(spark, sf):
    """Agreement kept up from the sums of each arriving batch."""
    base = shared_dir(spark, "moments")
    incremental.run_moments(_stream_pairs(spark, sf), f"{base}/out", f"{base}/cp", ["dim"]).awaitTermination()
    out = incremental.running_metrics(spark, f"{base}/out", ["dim"])
    return rounded(out.select("dim", "n", "pearson", "mae"), "pearson", "mae")


@query("stream_moments_table", ORACLES["stream_moments"])
def stream_moments_table(spark, sf):
    """The same moments as one streaming aggregate in complete mode."""
    base = shared_dir(spark, "moments-table")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    table = incremental.moments_table(_stream_pairs(spark, sf), ["dim"])
    writer = table.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{base}/cp")
    writer.trigger(availableNow=True).start().awaitTermination()
    out = moments.metrics(moments.with_overall(spark.read.parquet(f"{base}/out"), ["dim"]))
    return rounded(out.select("dim", "n", "pearson", "mae"), "pearson", "mae")


def _open_stub():
    """A deterministic judge: a score from the prompt length; some prompts fail."""
    def judge(prompts, paths):
        out = []
        for p in prompts:
            if len(p) % 17 == 0:
                raise ValueError("no audio")
            out.append(1 + len(p) % 5)
        return out

    return judge


@query(
    "judge_map",
    sql(
        f"select item_id, case when length(p) % 17 = 0 then 'Error: no audio' else cast(1 + length(p) % 5 as varchar) end as response, length(p) % 17 = 0 as error, wav_path as audio_path from (select item_id, wav_path, {_USER} as p from items)",
        "items",
    ),
)
def judge_map(spark, sf):
    """A judge function over request partitions; failed calls become error records."""
    requests = X.items(spark, sf).select("item_id", user_column().alias("prompt"), F.col("wav_path").alias("audio_path"))
    return run_judge(requests, _open_stub, "stub").select("item_id", "response", "error", "audio_path")


