"""Periodic runs of words against a brute force over all periods."""

from __future__ import annotations

import binascii
import hashlib
import re
import time

import numpy as np
import pytest

from judgealign.llm import periodic_runs, q_corpus

SF = "/root/testdata/sf0.001"


def brute_runs(w: list) -> list[tuple[int, int, int]]:
    """start, length, period of all runs, by start and period."""
    codes = np.unique(np.array(w, object).astype(str), return_inverse=True)[1] if w else np.zeros(0, int)
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        same = np.r_[False, codes[q:] == codes[:-q], False].astype(int)
        edge = np.flatnonzero(np.diff(same))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + q >= max(6, 4 * q):
                found.setdefault((a, b - a + q), q)
    return sorted(((a, length, q) for (a, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(w: list[str]) -> dict:
    runs = brute_runs(w)
    dropped = {i for a, length, q in runs for i in range(a + q, a + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return {
        "n_runs": len(runs),
        "start": best and best[0],
        "length": best and best[1],
        "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2],
        "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in dropped).encode()).hexdigest(),
    }


def brute_planted(doc_id, text) -> list[str]:
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is None:
        return w
    h, n = binascii.crc32(str(doc_id).encode()), len(w)
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_rows_of_the_table_equal_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = q_corpus.op12_periodic_runs(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    assert sum(r["n_runs"] for r in got) > 0
    for r in got:
        assert r.asDict() == {"doc_id": r["doc_id"], **brute_row(brute_planted(r["doc_id"], docs[r["doc_id"]]))}, r["doc_id"]


def test_defined_results(spark):
    block = "ein zwei drei vier fünf "
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "a a a a a"), (5, "a a a a a a"), (6, "x " * 7 + "y"), (7, "A a A a A a A a"), (None, "b c " * 5), (None, None),
        (8, block * 9), (8, block * 9), (9, "\x0b".join(["é"] * 50)), (10, "q" * 300_000), (11, "ab\n" * 3 + "ab"), (12, "u v " * 3 + "u v"), (13, ("s t " * 6 + "w ") * 6),
    ]
    frame = spark.createDataFrame([(i, t, 3, "z", "w") for i, t in rows], "doc_id long, text string, runs int, body string, collapsed string").repartition(3)
    got = periodic_runs.periodic_runs(frame).collect()
    assert len(got) == len(rows)
    mine = sorted((str(r["doc_id"]), r["n_words"], [tuple(s) for s in r["runs"]], r["collapsed"]) for r in got)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w)
        dropped = {k for a, length, q in runs for k in range(a + q, a + length)}
        want.append((str(i), len(w), runs, " ".join(x for k, x in enumerate(w) if k not in dropped)))
    assert mine == sorted(want)
    empty = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.planted(frame.limit(0)), keep_text=False))
    assert empty.count() == 0
    none = periodic_runs.digests(periodic_runs.periodic_runs(frame.filter("doc_id = 1"), keep_text=False)).first()
    assert none.asDict() == {"doc_id": 1, **brute_row([])}


def in_a_line(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    heads = np.r_[0, np.cumsum([len(d) for d in docs])].astype(np.int64)
    return periodic_runs.mix(np.array([x for d in docs for x in d], np.uint64) + np.uint64(77)), heads


def test_runs_of_made_up_rows_equal_brute_force():
    rng = np.random.default_rng(5)
    seen = 0
    for _ in range(600):
        docs = []
        for _ in range(int(rng.integers(1, 6))):
            w = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 90))).tolist()
            block = rng.integers(0, int(rng.integers(1, 30)), int(rng.integers(1, 60))).tolist()
            part = (block * 9)[: int(rng.integers(0, 400))]
            inner = rng.integers(0, 3, int(rng.integers(1, 6))).tolist() * int(rng.integers(2, 8)) + [9]
            docs.append(w + part + inner * int(rng.integers(0, 7)) + w[::-1])
        words, heads = in_a_line(docs)
        got = [tuple(r) for r in periodic_runs.runs_of(words, heads).tolist()]
        want = [(k, *r) for k, d in enumerate(docs) for r in brute_runs(d)]
        seen += len(want)
        assert got == want
    assert seen > 2000


def test_long_rows_take_little_time():
    """Fibonacci words hold very many runs; a long constant row holds one; a long period is found at its scale."""
    a, b = [0], [0, 1]
    while len(b) < 200_000:
        a, b = b, b + a
    block = np.random.default_rng(1).integers(0, 1 << 40, 60_000).tolist()
    start = time.perf_counter()
    words, heads = in_a_line([b, [1] * 300_000, block * 4 + block[:5], block])
    runs = periodic_runs.runs_of(words, heads)
    assert time.perf_counter() - start < 20
    assert runs[runs[:, 0] == 1].tolist() == [[1, 0, 300_000, 1]]
    assert runs[runs[:, 0] == 2].tolist() == [[2, 0, 240_005, 60_000]]
    assert not (runs[:, 0] == 3).any()
    short = b[:700]
    words, heads = in_a_line([short])
    assert [tuple(r[1:]) for r in periodic_runs.runs_of(words, heads).tolist()] == brute_runs(short)


def test_selected_places_are_consistent_and_dense():
    rng = np.random.default_rng(3)
    words, _ = in_a_line([rng.integers(0, 1 << 30, 4000).tolist() * 2])
    names, t = words, 1
    while t < 16:
        names, t = periodic_runs._doubled(names, t), 2 * t
    names = names[: len(words) - t + 1]
    least = periodic_runs._least_ahead(names, t + 1)
    picked = np.flatnonzero((least == names[: len(least)]) | (least == names[t : t + len(least)]))
    assert np.diff(picked).max() <= t and len(picked) < 4 * len(words) / t
    inside = picked[picked < 4000 - 2 * t]
    assert set(inside + 4000) <= set(picked)


def test_exponents_below_four_are_refused():
    with pytest.raises(ValueError):
        periodic_runs.runs_of(*in_a_line([[1, 1]]), exponent=3)
