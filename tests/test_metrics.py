"""Rank statistics, quantiles and classification against brute force, on both ways (few and many cells)."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgealign.functions.stats import correlation_p
from judgealign.operators import align, classify, describe, moments, ranks
from judgealign.operators.kendall import kendall
from judgealign.plans import reports


def _frame(spark, groups):
    rows = [(d, float(a), float(b)) for d, (p, g) in groups.items() for a, b in zip(p, g)]
    return spark.createDataFrame(rows, "dim string, pred double, truth double").repartition(5)


def _data(seed):
    rng = np.random.default_rng(seed)
    n = 300
    return {
        "ties": (rng.integers(1, 6, n), rng.integers(1, 6, n)),
        "smooth": (rng.normal(3, 1, n), rng.normal(3, 1, n) + rng.integers(0, 2, n)),
        # a third of the rows share one value, one outlier is huge, some values are negative
        "hot": (np.where(rng.random(n) < 0.34, 2.5, rng.normal(0, 2, n)), np.r_[1e12, -7.0, rng.integers(1, 4, n - 2)]),
        "linked": (np.arange(n) / 7, (np.arange(n) / 7) ** 3),
    }


def _rank(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def _tau(p, g):
    p, g = np.asarray(p, float), np.asarray(g, float)
    s = np.sign(p[:, None] - p[None]) * np.sign(g[:, None] - g[None])
    i = np.triu_indices(len(p), 1)
    x, y = (p[:, None] != p[None])[i].sum(), (g[:, None] != g[None])[i].sum()
    return s[i].sum() / math.sqrt(x * y)


def _with_pool(groups):
    out = dict(groups)
    out["OVERALL"] = tuple(np.concatenate([np.asarray(groups[d][i], float) for d in groups]) for i in (0, 1))
    return out


WAYS = [True, False]  # plain windows, three levels over the bits


@pytest.mark.parametrize("bounded", WAYS)
@pytest.mark.parametrize("seed", [1, 2])
def test_spearman_and_kendall(spark, bounded, seed):
    groups = _data(seed)
    cells = ranks.count_pairs(_frame(spark, groups), ["dim"], bounded=bounded)
    rho = {r.dim: r.spearman for r in ranks.spearman(cells, ["dim"]).collect()}
    tau = {r.dim: r.kendall for r in kendall(cells, ["dim"]).collect()}
    for d, (p, g) in _with_pool(groups).items():
        assert rho[d] == pytest.approx(np.corrcoef(_rank(p), _rank(g))[0, 1], abs=1e-9)
        assert tau[d] == pytest.approx(_tau(p, g), abs=1e-9)


def test_constant_and_single_rows_are_undefined(spark):
    df = _frame(spark, {"flat": ([2.3, 2.3, 2.3], [1, 2, 3]), "one": ([1.0], [2.0])})
    got = {r.dim: r for r in reports.agreement_report(df, ["dim"]).collect()}
    for d in ("flat", "one"):
        assert got[d].pearson is None and got[d].spearman is None and got[d].kendall is None
    assert got["flat"].mae == pytest.approx((1.3 + 0.3 + 0.7) / 3)
    assert got["one"].n == 1 and got["one"].r2 == 0.0


def test_errors_against_numpy(spark):
    groups = {"a": ([1, 2, 4.5, 3], [2, 2, 4, 1]), "z": ([0.5, 1], [0.0, 1])}
    got = {r.dim: r for r in moments.agreement(_frame(spark, groups), ["dim"]).collect()}
    p, g = (np.asarray(x, float) for x in groups["a"])
    assert got["a"].mae == pytest.approx(np.abs(p - g).mean())
    assert got["a"].rmse == pytest.approx(np.sqrt(((p - g) ** 2).mean()))
    assert got["a"].mape == pytest.approx((np.abs(p - g) / g).mean() * 100)
    assert got["a"].r2 == pytest.approx(1 - ((p - g) ** 2).sum() / ((g - g.mean()) ** 2).sum())
    assert got["z"].mape == float("inf") and got["z"].zero_truth == 1


def test_overall_equals_pooled_and_order_does_not_matter(spark):
    df = _frame(spark, _data(3))
    a = moments.agreement(df, ["dim"]).orderBy("dim").toPandas()
    b = moments.agreement(df.repartition(11).orderBy(F.rand(1)), ["dim"]).orderBy("dim").toPandas()
    np.testing.assert_allclose(a.drop(columns="dim").astype(float), b.drop(columns="dim").astype(float), rtol=1e-9)
    pooled = moments.metrics(moments.moments(df.withColumn("dim", F.lit("all")), ["dim"])).first()
    overall = a[a.dim == "OVERALL"].iloc[0]
    assert overall.pearson == pytest.approx(pooled.pearson) and overall.n == pooled.n


def test_excluded_gate_is_not_pooled(spark):
    df = _frame(spark, {"content_pass": ([1, 0, 1], [1, 0, 0]), "q": ([1, 2, 3], [1, 3, 2])})
    got = {r.dim: r.n for r in reports.agreement_report(df, ["dim"], exclude=("content_pass",)).collect()}
    assert got == {"content_pass": 3, "q": 3, "OVERALL": 3}


@pytest.mark.parametrize(
    "r, n, p",
    # two-sided critical values of Student's t: t = 2.228 at 10 degrees, 3.169 (0.01), 1.984 at 100
    [(2.2281 / math.sqrt(2.2281**2 + 10), 12, 0.05), (3.1693 / math.sqrt(3.1693**2 + 10), 12, 0.01), (1.98397 / math.sqrt(1.98397**2 + 100), 102, 0.05)],
)
def test_p_values(r, n, p):
    assert correlation_p(r, n) == pytest.approx(p, abs=2e-5)
    assert correlation_p(-r, n) == correlation_p(r, n)
    assert correlation_p(1.0, n) == 0.0 and math.isnan(correlation_p(0.5, 2))


@pytest.mark.parametrize("bounded", WAYS)
def test_quantiles_and_description(spark, bounded):
    groups = {d: (p, p) for d, (p, _) in _data(4).items()}
    values = describe.count_values(_frame(spark, groups), ["dim"], "pred", overall_dim="dim", bounded=bounded)
    got = {r.dim: r for r in describe.describe(values, ["dim"]).collect()}
    for d, (p, _) in _with_pool(groups).items():
        p = np.asarray(p, float)
        q = np.percentile(p, [25, 50, 75])
        assert [got[d].q25, got[d].median, got[d].q75] == pytest.approx(list(q))
        assert got[d]["count"] == len(p) and got[d].mean == pytest.approx(p.mean())
        assert got[d]["std"] == pytest.approx(p.std()) and got[d].std_sample == pytest.approx(p.std(ddof=1))


def test_histogram_matches_numpy(spark):
    p = _data(5)["smooth"][0]
    values = describe.count_values(_frame(spark, {"a": (p, p), "c": ([2.0, 2.0], [1, 1])}), ["dim"], "pred")
    rows = describe.histogram(values, ["dim"], 20).collect()
    want, _ = np.histogram(p, 20)
    got = {r.bin: r["count"] for r in rows if r.dim == "a"}
    assert [got.get(i, 0) for i in range(20)] == list(want)
    assert [(r.bin, r["count"]) for r in rows if r.dim == "c"] == [(10, 2)]


@pytest.mark.parametrize("bounded", WAYS)
def test_auc(spark, bounded):
    rng = np.random.default_rng(6)
    s, y = rng.integers(0, 20, 200) / 20, rng.integers(0, 2, 200)
    df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(s, y)] + [("b", 0.3, 1)], "dim string, score double, label int")
    got = {r.dim: r.auc for r in ranks.auc(df, ["dim"], bounded=bounded).collect()}
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(want) and got["b"] is None


def test_classification_zero_division(spark):
    df = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 1)], "dim string, score double, label int")
    r = classify.classification(df, ["dim"]).first()
    assert (r.accuracy, r.precision, r.recall, r.f1, r.auc) == (0.0, 0.0, 0.0, 0.0, None)


def test_summary_is_undefined_with_one_undefined_dimension(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 3.0, None), ("OVERALL", 9.0, 9.0)], "dim string, mae double, pearson double")
    got = {r.metric: (r["mean"], r["std"]) for r in reports.summarise_metrics(df, ["mae", "pearson"]).collect()}
    assert got == {"mae": (2.0, 1.0), "pearson": (None, None)}


def test_winner_flags(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (1.0, 1.0), (None, 1.0), (float("nan"), 1.0)], "a double, b double")
    got = [r[0] for r in df.select(reports.better(F.col("a"), F.col("b"))).collect()]
    assert got == ["Probability", "Model", "Probability", "Probability", "Probability"]


def test_trials_and_pairs(spark):
    parsed = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, None), ("b", None, 4.0)], "item_id string, d1 double, d2 double")
    trials = align.trial_means(parsed, ["d1", "d2"])
    got = {r.item_id: r.asDict() for r in trials.collect()}
    assert (got["a"]["d1"], got["a"]["d1_std"], got["a"]["d1_count"]) == (2.0, 1.0, 2)
    assert (got["b"]["d1"], got["b"]["d1_std"], got["b"]["d1_count"]) == (1.0, 0.0, 0)
    truth = spark.createDataFrame([("a", 2.0, None), ("c", 1.0, 1.0)], "item_id string, d1 double, d2 double")
    assert [(r.item_id, r.dim) for r in align.pair_up(trials, truth, ["d1", "d2"]).collect()] == [("a", "d1")]
    assert align.coverage(trials, truth).first().asDict() == {"matched": 1, "only_predicted": 1, "only_annotated": 1}


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, None), ("a", 2, "z"), ("b", 1, "q")], "k string, pos int, v string")
    assert sorted((r.k, r.pos, r.v) for r in align.last_wins(df, "k", ["pos"]).collect()) == [("a", 3, None), ("b", 1, "q")]


def test_attempts(spark):
    rows = [
        ("a", 0, None, "x", None), ("a", 1, 4.0, "x", None), ("a", 2, 5.0, "x", None), ("b", 0, float("nan"), "is N/A", None),
        ("b", 1, 2.0, "x", None), ("c", 0, float("inf"), "x", 2.5), ("d", 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "item_id string, attempt int, score double, response string, fallback double")
    got = {r.item_id: (r.score, r.succeeded) for r in align.merge_attempts(df, fallback="fallback").collect()}
    assert got == {"a": (4.0, True), "b": (1.0, True), "c": (2.5, False), "d": (3.0, False)}


def test_legacy_sentinels(spark):
    df = spark.createDataFrame([(None, None), (0.5, 1.0)], "pearson double, mae double")
    rows = reports.legacy_sentinels(df, "zero_inf", ["pearson"], ["mae"]).collect()
    assert [tuple(r) for r in rows] == [(0.0, float("inf")), (0.5, 1.0)]


def test_flatten_and_preview(spark):
    df = spark.createDataFrame([("b", {"x": 1.0}), ("a", {"y": 2.0})], "id string, m map<string,double>")
    flat = align.flatten_map(df, "m", ["x", "y"], "gt_avg_")
    assert flat.columns == ["id", "gt_avg_x", "gt_avg_y"]
    assert [tuple(r) for r in align.preview_rows(flat, ["id"], 1).collect()] == [("a", None, 2.0)]


def _jobs(spark) -> int:
    """Jobs of the session so far."""
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


def test_building_reports_starts_no_job(spark):
    df = _frame(spark, {"a": ([1, 2, 3], [1, 2, 2])})
    before = _jobs(spark)
    reports.agreement_report(df, ["dim"], with_p=True)
    describe.box_table(describe.count_values(df, ["dim"], "pred"), ["dim"])
    ranks.auc(df.withColumn("label", F.lit(1)), ["dim"], "pred")
    assert _jobs(spark) == before


def test_order_bits_are_those_of_the_double(spark):
    rng = np.random.default_rng(8)
    values = np.r_[0.0, 1.0, 8.0, 2.0**29, 1e-320, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, np.inf, np.nextafter(2.0**-5, 0), np.nextafter(2.0**40, 0)]
    values = np.r_[values, rng.normal(0, 1e5, 300), 10.0 ** rng.uniform(-300, 300, 300)]
    values = np.r_[values, -values]
    frame = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in frame.select("v", ranks.order_bits(F.col("v")).alias("b")).collect():
        want = int(np.abs(np.float64(r.v)).view(np.int64))
        assert r.b == (-want if r.v < 0 else want)


def test_large_values_spread_over_many_windows(spark):
    frame = spark.range(100_000).select((F.col("id") + 100_000.0).alias("a"), (1.7e9 + F.col("id")).alias("t"))
    for c in ("a", "t"):
        bits = ranks.order_bits(F.col(c))
        rows = frame.select(F.shiftright(bits, 21).alias("k")).groupBy("k").count()
        assert rows.agg(F.max("count")).first()[0] == 1


def test_nonfinite_pairs_are_undefined_and_counted(spark):
    for odd in (float("nan"), float("inf"), float("-inf")):
        df = _frame(spark, {"a": ([1, 2, odd, 3], [1, 2, 3, 3]), "b": ([1, 2, 3], [3, 2, 2])})
        got = {r.dim: r for r in moments.agreement(df, ["dim"], nonfinite=True).collect()}
        assert got["a"].pearson is None and got["a"].mae is None and got["a"].r2 is None and got["a"].nonfinite == 1
        assert got["OVERALL"].pearson is None and got["b"].pearson == pytest.approx(-0.8660254, abs=1e-6)


def test_large_offsets_do_not_cancel(spark):
    rng = np.random.default_rng(9)
    p, g = rng.integers(1, 6, 500), rng.integers(1, 6, 500)
    for offset in (1e8, 1e9):
        got = {r.dim: r for r in moments.agreement(_frame(spark, {"a": (p + offset, g + offset), "b": (p[:40] + offset, g[:40] + offset)}), ["dim"]).collect()}
        assert got["a"].pearson == pytest.approx(np.corrcoef(p, g)[0, 1], abs=1e-6)
        assert got["a"].r2 == pytest.approx(1 - ((p - g) ** 2).sum() / ((g - g.mean()) ** 2).sum(), abs=1e-6)
        both = np.corrcoef(np.r_[p, p[:40]], np.r_[g, g[:40]])[0, 1]
        assert got["OVERALL"].pearson == pytest.approx(both, abs=1e-6)


def test_concordant_pairs_equal_a_count_of_all_pairs(spark):
    from judgealign.operators import kendall as K
    from judgealign.operators import ranks

    rng = np.random.default_rng(6)
    for size, values in ((1, 3), (40, 4), (60, 50), (200, 1)):
        x, y, n = rng.integers(0, values, size).astype(float), rng.integers(0, values + 2, size) / 3, rng.integers(1, 9, size)
        want = sum(int(n[i] * n[j]) for i in range(size) for j in range(size) if x[i] < x[j] and y[i] < y[j])
        assert K.count_concordant(x, y, n) == want
        assert K.count_concordant(x, y, n << 40) == want << 80  # beyond 64 bits
        assert K._tied_pairs(x, n << 40, int(n.sum()) << 40) == sum(v * (v - 1) // 2 for v in (int(n[x == u].sum()) << 40 for u in np.unique(x)))
    rows = [("a b", float(rng.integers(0, 5)), float(rng.integers(0, 4))) for _ in range(300)] + [("c", 1.0, float(k)) for k in range(5)] + [(None, 1.0, 2.0), (None, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "`the dim` string, pred double, truth double")
    both = [K.kendall(ranks.count_pairs(df, ["the dim"], overall=False, bounded=b), ["the dim"]) for b in (True, False)]
    got, other = ({r["the dim"]: tuple(r)[1:] for r in k.collect()} for k in both)
    assert {k: v for k, v in got.items() if k} == other  # joins of the large way leave a null group out
    assert got[None][-1] == 1.0 and got["c"][-1] is None
    empty = ranks.count_pairs(df.limit(0), ["the dim"], overall=False, bounded=True)
    assert K.kendall(empty, ["the dim"]).count() == 0


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_equal_numpy(spark, bounded):
    rng = np.random.default_rng(7)
    groups = {
        "wide": np.r_[rng.normal(0, 1e6, 400), rng.normal(0, 1e-6, 300), -0.0, 0.0], "close": 1e9 + rng.integers(0, 50, 500) / 1024,
        "ties": rng.integers(-3, 3, 700).astype(float), "one": np.array([4.25]), "two": np.array([-1.0, 1e300]), "same": np.full(40, -7.5),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("close", None), ("close", float("nan"))]
    values = describe.count_values(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bounded=bounded)
    qs = {"low": 0.0, "a": 0.1, "q25": 0.25, "median": 0.5, "q99": 0.99, "high": 1.0}
    got = {r["g"]: r for r in describe.quantiles(values, ["g"], qs).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, q in qs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-12), (g, name)


@pytest.mark.parametrize("name", ["align_spearman_large", "align_kendall_large"])
def test_pairs_behind_ranks_are_made_once(spark, name):
    """All readers of the compressed cells share one exchange, so parse, means and join run once."""
    from judgealign.plans import catalog

    report = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    report.collect()
    final = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Generate inline") == 1
