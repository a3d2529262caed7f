"""Hand-written edge rows of parsing, extraction and rating policies."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from judgealign.functions import keys, picks, ratings, scores
from judgealign.functions import text as T

F3 = "```json\n"


def _parse(spark, response, mode="float", **top):
    df = spark.createDataFrame([(response,)], "response string")
    for d, v in top.items():
        df = df.withColumn(d, F.lit(v))
    return tuple(scores.parse_scores(df, ["d1", "d2"], mode).select("d1", "d2").first())


@pytest.mark.parametrize(
    "response, as_float, as_int",
    [
        (F3 + '{"d1":4}\n```', (4.0, 1.0), (4.0, 1.0)),
        ("Error: timeout", (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":null,"d2":5}', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":"3.7","d2":2}', (3.7, 2.0), (1.0, 1.0)),
        ('{"d1":3.7,"d2":2}', (3.7, 2.0), (3.0, 2.0)),
        ('{"d1":-3.7,"d2":"4"}', (-3.7, 4.0), (-3.0, 4.0)),
        ("[1]", (1.0, 1.0), (1.0, 1.0)),
        ("4", (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":true,"d2":false}', (1.0, 0.0), (1.0, 0.0)),
        ('{"d1":"true","d2":3}', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":"5d","d2":3}', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":[2],"d2":3}', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":2,"d2":3} trailing', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":2}{"d1":3}', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":2}]', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":2},3', (1.0, 1.0), (1.0, 1.0)),
        ('{"d1":2,"x":{"y":[1]}}', (2.0, 1.0), (2.0, 1.0)),
        ('{"d1":2,"x":"}"}', (2.0, 1.0), (2.0, 1.0)),
        ("{}", (1.0, 1.0), (1.0, 1.0)),
        ("", (1.0, 1.0), (1.0, 1.0)),
    ],
)
def test_parse_rows(spark, response, as_float, as_int):
    assert _parse(spark, response) == as_float
    assert _parse(spark, response, "int") == as_int


def test_missing_response_uses_the_row(spark):
    assert _parse(spark, None, d1=2.0) == (2.0, None)


def test_casts_of_values_do_not_grow_with_the_dimensions(spark):
    """Every row would run through the code of all of them; numbers take none, so one lambda holds them for the other rows."""
    answers = spark.createDataFrame([('{"d0":2.5,"d1":"3.7"}',), ('{"d0":1e2,"d1":-0.25,"d3":4}',), ('{"d0":NaN,"d1":2}',)], "response string")

    def casts(n):
        plan = scores.parse_scores(answers, [f"d{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("DoubleType")

    assert 0 < casts(2) == casts(4)
    rows = sorted(str(tuple(r)) for r in scores.parse_scores(answers, ["d0", "d1", "d2", "d3"]).select("d0", "d1", "d2", "d3").collect())
    assert rows == ["(100.0, -0.25, 1.0, 4.0)", "(2.5, 3.7, 1.0, 1.0)", "(nan, 2.0, 1.0, 1.0)"]


def _policy(spark, raw, policy, gate=False):
    schema = "r array<string>"
    return spark.createDataFrame([(raw,)], schema).select(ratings.clean(F.col("r"), policy, gate)).first()[0]


def _same(a, b):
    return len(a) == len(b) and all(x == y or (math.isnan(x) and math.isnan(y)) for x, y in zip(a, b))


NAN = float("nan")


@pytest.mark.parametrize(
    "policy, raw, want",
    [
        ("fill1", [None, "N/A", "n/a", "", "x", "[4]", "[]", "3", " 5 "], [1, 1, 1, 1, 1, 4, 1, 3, 5]),
        ("fill1_bool", [None, "true", "false", "N/A"], [1, 1, 0, 1]),
        ("drop_null", [None, "3", "N/A"], [3, NAN]),
        ("drop_null_na1", [None, "N/A", "3"], [1, 3]),
        ("fewshot_avg", [None, "N/A", "true", "false", "4"], [1, 1, 1, 0, 4]),
    ],
)
def test_policies(spark, policy, raw, want):
    assert _same(_policy(spark, raw, policy), want)


def test_gate_policy(spark):
    assert _policy(spark, ["true", "N/A", None], "drop_null_na1_gate", gate=True) == [1, 0]
    assert _policy(spark, ["4", "N/A", None], "drop_null_na1_gate") == [4, 1]


@pytest.mark.parametrize("raw, want", [(["2", "3"], 2.0), (["3", "4"], 4.0), ([], 1.0), (["x"], None)])
def test_fewshot_mean_is_half_even(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r array<string>").select(ratings.mean_of(F.col("r"), "fewshot_avg")).first()[0] == want


def test_unknown_policy():
    with pytest.raises(ValueError):
        ratings.coerce(None, "guess")


@pytest.mark.parametrize(
    "passes, fails, majority, strict", [(3, 1, 1, 1), (1, 3, 0, 0), (2, 2, 1, None), (1, 0, 1, 1)]
)
def test_votes(spark, passes, fails, majority, strict):
    df = spark.createDataFrame([(passes, fails)], "p int, f int")
    args = (F.col("p"), F.col("f"), F.col("p") + F.col("f"))
    row = df.select(ratings.majority(*args, "pass").alias("a"), ratings.majority(*args, "null").alias("b")).first()
    assert (row.a, row.b) == (majority, strict)


@pytest.mark.parametrize(
    "path, item, loose, strict",
    [("a/b/x.wav", "y", "x", "x"), ("", "y.wav", "y", "y.wav"), (None, "y.wav", "y", "y.wav"), ("x.wav", None, "x", "x")],
)
def test_result_key(spark, path, item, loose, strict):
    df = spark.createDataFrame([(path, item)], "p string, i string")
    row = df.select(
        keys.result_key(F.col("p"), F.col("i")).alias("a"), keys.result_key(F.col("p"), F.col("i"), True).alias("b")
    ).first()
    assert (row.a, row.b) == (loose, strict)


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<answer> 4 </answer>", 4), ("<answer>N/A</answer>", 1), ("<answer></answer>", 1), ("4", None),
        ("answer>\n3/5</answer> <answer>9</answer>", 3), ("<answer>good</answer>", 1),
    ],
)
def test_answer_score(spark, text, want):
    assert _one(spark, text, T.answer_score) == want


@pytest.mark.parametrize(
    "text, optional, required",
    [("x assistant\n3.5 of 5", 3.5, 3.5), ("4", 4.0, None), ("assistant\n", None, None), ("none", None, None), ("'2.0'", 2.0, None)],
)
def test_first_float(spark, text, optional, required):
    assert _one(spark, text, lambda c: T.first_float(c, False)) == optional
    assert _one(spark, text, lambda c: T.first_float(c, True)) == required


def test_report_ratings_of_one_pass_equal_those_of_each_pattern(spark):
    labels = [*T.REPORT_LABELS.values()]
    assert not [(a, b) for a in labels for b in labels if a != b and a.lower().endswith(b.lower())]
    texts = [
        None, "", "no number: here", "Naturalness: 4Naturalness: 2\nemotional RANGE:\n\t7", "rhythmic naturalness:5", "Naturalness : 3",
        "<pitch_dynamics>3</Pitch_Dynamics><trait_embodiment>4</pitch_dynamics>", "<local_scene_fit> 4</local_scene_fit><local_scene_fit>9</local_scene_fit>",
        "Character Consistency: 12 Style Consistency: x Style Consistency: 8", "Consistency: 4 <stress_emphasis>\u0663</stress_emphasis>", ": 5 <>4</>",
        " ".join(f"{label.upper()}: {k}" for k, label in enumerate(labels)) + "".join(f"<{t}>{k}</{t}>" for k, t in enumerate(T.REPORT_TAGS)),
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    each = df.select("id", F.explode(T.report_ratings(F.col("text"))).alias("category", "rating")).where("rating is not null")
    got = sorted(map(tuple, T.explode_report_ratings(df, ["id"]).collect()))
    assert got == sorted(map(tuple, each.collect())) and len(got) > 30


def test_report_ratings(spark):
    got = _one(spark, "rhythmic naturalness: 4\nTrait: 2\n<TRAIT_EMBODIMENT>3</TRAIT_EMBODIMENT>", T.report_ratings)
    assert {k: v for k, v in got.items() if v is not None} == {"naturalness": 4.0, "trait_embodiment": 3.0}


def test_fenced_json(spark):
    assert _one(spark, 'say ```json\n{"a": 1}\n``` bye', T.first_fenced_json) == '{"a": 1}'
    assert _one(spark, '{"a": 1}', T.first_fenced_json) == '{"a": 1}'
    assert _one(spark, "```json\n{a}\n```", T.first_fenced_json) is None


@pytest.mark.parametrize("text, want", [("", ""), (None, ""), ("abcdef", "abc..."), ("ab", "ab...")])
def test_preview(spark, text, want):
    assert _one(spark, text, lambda c: T.preview(c, 3)) == want


def test_expected_score_and_gate(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.0, 0.0, 0.0], [1.0, 1.0]), ([1000.0, 0.0, 0.0, 0.0, 0.0], [2.0, 1.0])], "l array<double>, g array<double>")
    rows = df.select(scores.expected_score(F.col("l")).alias("e"), scores.gate_score(F.col("g")).alias("g")).collect()
    assert [round(r.e, 9) for r in rows] == [3.0, 1.0]
    assert [r.g for r in rows] == [1.0, 0.0]


def test_range_check(spark):
    df = spark.createDataFrame([(None,), (0.0,), (3.0,), (3.5,), (6.0,)], "s double")
    got = [r[0] for r in df.select(scores.range_check(F.col("s"), F.lit(1), F.lit(5))).collect()]
    assert got == ["missing", "range", None, "fraction", "range"]


def test_separate_score(spark):
    df = spark.createDataFrame([("4", False), ("4", True), ("bad", None), (None, None), (" 2.5 ", False)], "r string, e boolean")
    assert [r[0] for r in df.select(scores.separate_score(F.col("r"), F.col("e"))).collect()] == [4.0, 1.0, 1.0, 1.0, 2.5]


@pytest.mark.parametrize("size", [0, 1, 3, 4, 50])
def test_distinct_indices(spark, size):
    df = spark.range(200).select(picks.distinct_indices(F.lit(size).cast("bigint"), 3, 1, F.col("id")).alias("d"))
    rows = [r.d for r in df.collect()]
    if size == 0:
        assert all(d is None for d in rows)
        return
    assert all(len(d) == min(3, size) == len(set(d)) and set(d) <= set(range(size)) for d in rows)
    if size == 4:  # every choice comes up
        assert len({tuple(sorted(d)) for d in rows}) == 4


def test_permute(spark):
    df = spark.range(50).select(picks.permute(F.array(*map(F.lit, "abcd")), 3, F.col("id")).alias("p"))
    rows = [tuple(r.p) for r in df.collect()]
    assert all(sorted(p) == list("abcd") for p in rows) and len(set(rows)) > 5


def test_answers_are_dealt_into_more_parts_than_cores(spark):
    """A few splits of narrow rows hold very many answers to parse, so they are not left to one task per core."""
    from judgealign.plans import fixtures

    assert fixtures.judge(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
