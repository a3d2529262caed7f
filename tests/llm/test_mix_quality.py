"""Mixing, the quality classifier and the pipeline."""

from __future__ import annotations

import binascii
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from judgealign.llm import minhash, mix_cube, quality_pu

SF = "/root/testdata/sf0.001"


def targets_brute(sizes: dict, cap: float = 3.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        mass = sum(weight[s] for s in order if s not in capped)
        target = {s: cap * sizes[s] if s in capped else rest * weight[s] / mass for s in order}
        over = {s for s in order if s not in capped and target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix_meets_capped_targets(spark, monkeypatch):
    monkeypatch.setattr(mix_cube, "BLOCK", 64)  # several levels
    rng = np.random.default_rng(3)
    rows = []
    for source, n in (("a", 900), ("b", 4), ("c", 20), (None, 300), ("é", 50), ("zero", 3)):
        for _ in range(n):
            size = 0 if source == "zero" else int(rng.integers(1, 300))
            rows.append((len(rows), "w " * size if size else None, source, 1))
    rows += [rows[0], rows[0], (None, "x y", "a", 1)]
    docs = frame_of(spark, rows).repartition(3)
    mix = mix_cube.mix_sources(docs)
    got = mix_cube.taken(mix).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    source = {r[0]: r[2] for r in rows}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    want = targets_brute(dict(sizes))
    assert target == pytest.approx(want)
    assert any(want[s] == 3 * sizes[s] > 0 for s in want)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 3)
    again = mix_cube.taken(mix_cube.mix_sources(docs.repartition(7))).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    out = mix_cube.apply_mix(docs, mix)
    assert out.columns == docs.columns
    assert out.groupBy("source").agg(F.sum(mix_cube.n_words(F.col("text"))).alias("n")).filter("n > 0").count() == 5
    assert {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(mix_cube.n_words(F.col("text"))).alias("n")).collect() if r["n"]} == {s: n for s, n in taken.items() if n}


def test_mix_of_empty_tables(spark):
    docs = frame_of(spark, [(1, None, None, 1)])
    assert [tuple(r) for r in mix_cube.taken(mix_cube.mix_sources(docs)).collect()] == [(1, 0, 0, 0.0, 0)]
    assert mix_cube.taken(mix_cube.mix_sources(docs.limit(0))).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(1, 1000, 500))[::-1].astype(float)
    p = np.full(500, 0.37)
    out = mix_cube.flight(p, size, rng)
    left = (out > 0) & (out < 1)
    assert left.sum() <= 2 and size[left].max(initial=0) < 50  # what stays is short
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    equal = mix_cube.landing(mix_cube.flight(np.full(50, 0.5), np.full(50, 7.0), rng), np.full(50, 7.0), rng)
    assert set(equal) <= {0.0, 1.0} and equal.sum() == 25
    odd = np.r_[1000.0, np.full(30, 7.0), np.zeros(9)]
    assert set(mix_cube.landing(mix_cube.flight(np.full(40, 0.4), odd, rng), odd, rng)) <= {0.0, 1.0}


@pytest.mark.parametrize(("share", "p"), [(0.08, 0.3), (0.15, 0.3), (0.33, 0.3), (0.33, 0.8)])
def test_every_document_keeps_its_inclusion_probability(share, p):
    """2,000 draws of 61 documents, the first with a given share of the words."""
    rest = np.random.default_rng(1).integers(50, 400, 60).astype(float)
    size = np.sort(np.r_[rest, rest.sum() * share / (1 - share)])[::-1]
    draws, seen, words = 2000, np.zeros(61), []
    for seed in range(draws):
        rng = np.random.default_rng([11, seed])
        drawn = mix_cube.landing(mix_cube.flight(np.full(61, p), size, rng), size, rng)
        seen += drawn
        words.append(float(drawn @ size))
    error = np.sqrt(p * (1 - p) / draws)
    assert np.abs(seen / draws - p).max() < 4 * error
    off = np.abs(np.array(words) - p * size.sum())
    # as near as the first document allows: without it the others have at most all their words, with it at least none
    forced = max(0.0, size[0] - p * size.sum(), p * size.sum() - rest.sum())
    assert off.max() <= forced + rest.max()


def test_blocks_keep_the_inclusion_probability(monkeypatch):
    """The same through two levels of blocks, as the operator deals them."""
    import pandas as pd

    size = np.r_[3000, np.random.default_rng(2).integers(10, 300, 59)]
    rows = pd.DataFrame({"doc_id": np.arange(60), "tk": np.arange(60), "size": size, "copies": 1, "place": np.arange(60), "p": 0.4})
    seen, draws = np.zeros(60), 500
    for seed in range(draws):
        left = rows.assign(source=f"s{seed}", n_blocks=3, block=rows["place"] % 3)
        first = pd.concat([mix_cube._fly(0)(g) for _, g in left.groupby("block")])
        done = first[first["p"].isin([0.0, 1.0])]
        last = first[~first["p"].isin([0.0, 1.0])].assign(block=0, n_blocks=1)
        if len(last):
            done = pd.concat([done, mix_cube._fly(1)(last)])
        assert len(done) == 60 and set(done["p"]) <= {0.0, 1.0}
        seen[done["doc_id"]] += done["p"]
    assert np.abs(seen / draws - 0.4).max() < 4 * np.sqrt(0.24 / draws)


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality_pu.score_documents(docs, quality_pu.train(docs, labels)).join(labels, "doc_id").filter("held_out").collect()
    assert all(binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in scored)
    good = [r["predicted"] for r in scored if r["quality"] == 1]
    bad = [r["predicted"] for r in scored if r["quality"] == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.06


def test_quality_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "word " * 50_000, "x"), (3, "word", "x"), (4, "a b c", "x")], "doc_id long, text string, positive string"
    )
    labels = spark.createDataFrame([(4, 1), (4, 1), (3, 1), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality_pu.train(docs, labels)
    rows = quality_pu.score_documents(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["held_out"] is not None and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_pu.keep_good(docs, model).columns == docs.columns
    none = quality_pu.train(docs.limit(0), labels.limit(0))
    assert {r["score"] for r in quality_pu.score_documents(docs, none).collect()} == {0.5}
    assert quality_pu.score_documents(docs.limit(0), model).count() == 0


def test_quality_where_every_document_is_labelled(spark):
    rng = np.random.default_rng(6)
    good = [" ".join(f"word{k}" for k in rng.integers(0, 500, 60)) + "." for _ in range(150)]
    bad = [" ".join(["BUY!!! $$$"] * rng.integers(10, 30)) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(300)], "doc_id long, quality int")
    model = quality_pu.train(docs, labels)
    assert len(model.weights) == quality_pu.N_FEATURES + 1
    kept = {r["doc_id"] for r in quality_pu.keep_good(docs, model).collect()}
    assert len(kept & set(range(150))) > 145 and len(kept - set(range(150))) < 5


def test_quality_is_fitted_on_one_row_per_document(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_pu, "fit", lambda p, u: seen.append((len(p), len(u))))
    ids = [k for k in range(60) if binascii.crc32(str(k).encode()) % 5][:20]
    rows = [(k, f"text {k}") for k in ids] + [(k, f"other {n % 7}") for k in ids[:2] for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in ids[:6]], "doc_id long, quality int")
    quality_pu.train(docs, labels)
    quality_pu.train(docs, labels, sample=5)
    assert seen == [(6, 20), (5, 5)]


def test_prior_estimate():
    rng = np.random.default_rng(1)
    positive, unlabelled = rng.normal(2, 1, 4000), np.r_[rng.normal(2, 1, 2800), rng.normal(-3, 1, 1200)]
    assert quality_pu.estimate_prior(positive, unlabelled) == pytest.approx(0.7, abs=0.04)


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mix", "tokens"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, steps[-1], SF).write.parquet(str(tmp_path / name))
        steps.append(spark.read.parquet(str(tmp_path / name)))
    for out in steps[1:-1]:
        assert out.columns == columns
    good, lined, near, mixed, coded = steps[1:]
    assert 0 < good.count() <= docs.count() and lined.count() <= good.count()
    groups = minhash.near_duplicates(lined)
    assert {r["doc_id"] for r in near.collect()} == {r["component_id"] for r in groups.collect()}
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in near.collect()}
    assert coded.count() == mixed.count() and "ids" in coded.columns
    assert corpus_pipeline.run(spark, SF).count() == coded.count()


def test_pipeline_of_empty_and_odd_documents(spark, tmp_path):
    sf = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", "en", "s", 5), (2, "a b c", "en", "s", 5)]
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() <= 6
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf).count() == 0, name
