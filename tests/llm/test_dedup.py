"""Suffix, min-max and vector dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from judgealign.llm import embedding_dedup, minhash, suffix_dedup
from judgealign.llm.components import components
from judgealign.llm.store import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- suffix dedup


def cover_none(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Bytes covered by a string of ``length`` that starts anywhere else."""
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                mark[s : s + length] = True
        out.append(mark)
    return out


def cover_first(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Bytes covered by a string of ``length`` that starts at an earlier place."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        mark = np.zeros(len(t), bool)
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                mark[s : s + length] = True
            seen.add(t[s : s + length])
        out.append(mark)
    return out


def summary(text: bytes, mark: np.ndarray) -> tuple:
    runs = int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum())
    return len(text), int(mark.sum()), runs, hashlib.sha256(bytes(b for b, m in zip(text, mark, strict=True) if not m)).hexdigest()


def corpus(seed: int = 5) -> list[str | None]:
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [make(rng.randint(0, 60)) for _ in range(60)]
    passage = make(30)
    docs += [make(rng.randint(1, 9)) + passage + make(rng.randint(1, 9)) for _ in range(40)]
    docs += [docs[60]] * 9 + [docs[61][:80] + "é" + docs[61][80:] for _ in range(3)]
    docs += [None, "", "a" * 700, "ab" * 400, "ß🙂" * 90, make(6000), passage * 3]
    return docs


@pytest.mark.parametrize("hot", [2, 512])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, keep, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = corpus()
    rows = [(k, t, 1, 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int, spans int").repartition(5)
    raw = [(t or "").encode() for t in texts]
    marks = (cover_none if keep == "none" else cover_first)(raw, 50)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.kept_digests(docs, suffix_dedup.repeated_spans(docs, 50, keep)).collect()}
    assert got == {k: summary(t, m) for k, (t, m) in enumerate(zip(raw, marks, strict=True))}


def test_suffix_dedup_repeated_rows_nulls_and_empty(spark):
    text = "".join(random.Random(3).choice("abc") for _ in range(300))
    docs = spark.createDataFrame([(1, text), (1, text), (None, "x" + text), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r)[1:3] for r in suffix_dedup.kept_digests(docs, suffix_dedup.repeated_spans(docs, keep="none")).collect())
    assert got == [(0, 0), (300, 300), (300, 300), (301, 300)]
    out = suffix_dedup.remove_spans(docs, suffix_dedup.repeated_spans(docs, keep="none")).filter("doc_id is null").first()
    assert bytes(out["kept"]) == b"x" and [tuple(s) for s in out["spans"]] == [(1, 301)]
    assert suffix_dedup.kept_digests(docs.limit(0), suffix_dedup.repeated_spans(docs.limit(0))).count() == 0


@pytest.mark.parametrize("ids", [(1, 2), (None, 2)])
def test_suffix_dedup_keeps_the_first_of_repeated_rows(spark, ids):
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefgh") for _ in range(900))
    edited = text[:430] + "#" + text[431:]
    rows = [(ids[0], text)] * 3 + [(ids[1], edited)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # the byte that was edited splits the copy in two, both longer than a window
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.kept_digests(docs, suffix_dedup.repeated_spans(docs)).collect()}
    assert got == {(ids[0], 0), (ids[1], 899)}


def test_longest_factors_are_exact():
    rng = random.Random(9)
    buffer = np.array([rng.choice(b"ab") for _ in range(400)], np.uint8)
    starts = np.sort(np.array(rng.sample(range(360), 200)))
    for later in (False, True):
        got = suffix_dedup.longest_factors(buffer, starts, 40, later)
        for k, s in enumerate(starts):
            others = [t for t in starts if t < s or (later and t > s)]
            best = 0
            for t in others:
                n = 0
                while n < 40 and buffer[s + n] == buffer[t + n]:
                    n += 1
                best = max(best, n)
            assert got[k] == best


# --- near duplicates


def shingles(text: str | None, size: int) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def groups_of(sets: list[set], percent: int = 80) -> list[int]:
    """The first row that each row is connected with."""
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    places = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            places[x].append(k)
    for k, s in enumerate(sets):
        for o, both in Counter(o for x in s for o in places[x] if o < k).items():
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                a, b = sorted((find(k), find(o)))
                root[b] = a
    return [find(k) for k in range(len(sets))]


@pytest.mark.parametrize("size", [4, 5])
def test_minhash_equals_brute_force(spark, size):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    rng = random.Random(1)
    texts = [r["text"] for r in rows]
    base = " ".join(f"w{rng.randrange(900)}" for _ in range(150))
    for k in range(60):  # edited copies, some linked only through others
        words = base.split()
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(len(words))] = f"e{k}"
        texts.append(" ".join(words))
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{passage} " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))) for _ in range(60)]
    texts += [None, "", " \n", "One", "one", "one two three", "ONE two\x0bthree", "a b c d", "a b c d", " ", "w " * 9000]
    frame = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "doc_id long, text string, n int, node int").repartition(6)
    sets = [shingles(t, size) for t in texts]
    roots = groups_of(sets)
    got = {r["doc_id"]: tuple(r)[2:] for r in minhash.near_duplicates(frame, size=size).collect()}
    assert got == {k: (len(s), r, r == k) for k, (s, r) in enumerate(zip(sets, roots, strict=True))}


def test_minhash_repeated_rows_null_ids_and_empty(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(7, text, "a"), (7, text, "a"), (None, text, "b"), (9, text + " x", "c"), (None, "alone", "d"), (4, None, "e")], "doc_id long, text string, row string")
    found = minhash.near_duplicates(docs)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in found.collect())
    assert got == {(7, 7, True): 2, (None, 7, False): 1, (9, 7, False): 1, (None, None, True): 1, (4, 4, True): 1}
    kept = minhash.keep_one(docs, found)
    assert kept.columns == docs.columns and sorted(r["row"] for r in kept.collect()) == ["a", "d", "e"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_minhash_blocks_of_short_texts_are_bounded(spark, monkeypatch):
    across = minhash._across

    def watched(percent):
        run = across(percent)

        def bounded(batches):
            held = list(batches)
            sizes = Counter(k for b in held for k in zip(*(b.column(c).to_pylist() for c in ("g", "low", "high")), strict=True))
            assert max(sizes.values(), default=0) <= 5000, sizes.most_common(1)
            yield from run(iter(held))

        return bounded

    monkeypatch.setattr(minhash, "_across", watched)
    words = [f"w{k}" for k in range(25)]
    texts = [" ".join([*words[:12], f"x{i}", *words[13:]]) for i in range(20_000)]
    copied = range(0, 20_000, 1999)
    rows = [*enumerate(texts), *((100_000 + i, texts[i] + " end") for i in copied)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == r.doc_id % 100_000 for r in got)
    assert {r.doc_id for r in got if not r.kept} == {100_000 + i for i in copied}


def test_across_equals_all_pairs():
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 1 << 60, 30) for _ in range(40)]
    sets = [np.unique(np.r_[base[k % 40][: rng.integers(24, 31)], rng.integers(0, 1 << 60, rng.integers(0, 4))]) for k in range(700)]
    batch = pa.RecordBatch.from_pydict({**{c: np.zeros(700, np.int64) for c in ("g", "low", "high", "side")}, "node": np.arange(700), "c": np.arange(700), "items": [s.tolist() for s in sets]})
    links = [(u, v) for out in minhash._across(80)(iter([batch])) for u, v in zip(out.column("u").to_pylist(), out.column("v").to_pylist(), strict=True)]
    label = list(range(700))
    for u, v in sorted(links):
        label[u] = label[v]
    assert label == groups_of([set(s.tolist()) for s in sets])


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 160)] + [(1, rng.randrange(200, 900)) for _ in range(200)] + [(950, 940), (940, 930), (5, 5)]
    root = {n: n for p in links for n in p}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    frame = spark.createDataFrame(links, "u long, v long")
    got = {r["node"]: r["component"] for r in components(frame, Scratch(spark, "test")).collect()}
    assert got == {n: r for n, r in root.items() if n != 5}
    assert components(frame.limit(0), Scratch(spark, "test")).count() == 0


# --- vectors


def vector_brute(rows: list[tuple]) -> list[tuple]:
    good = []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float)
            u /= np.abs(u).max()
            good.append((k, u / np.linalg.norm(u)))
    near = defaultdict(set)
    for i, (a, u) in enumerate(good):
        for b, v in good[:i]:
            if len(u) == len(v) and float(u @ v) >= 0.95:
                near[a].add(b)
                near[b].add(a)
    out = []
    for k, (vec_id, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for o in near[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        least = min((rows[o][0] for o in seen if rows[o][0] is not None), default=None)
        out.append((str(vec_id), len(near[k]), str(least), vec_id == least))
    return sorted(out)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((200, 24)))]
    centre = rng.standard_normal(24)
    rows += [(1000 + k, (centre + 0.12 * rng.standard_normal(24)).tolist()) for k in range(150)]  # more than a window
    rows += [(2000 + k, centre.tolist()) for k in range(60)] + [(2000, centre.tolist()), (None, centre.tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [None] + [1.0] * 23), (3005, [float("inf")] + [1.0] * 23)]
    rows += [(3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, [1e300, 2e300]), (3009, [1e-320, 2e-320]), (3010, [5.0]), (None, None)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, node int").repartition(5)
    got = embedding_dedup.near_vectors(frame, block=64, side=40).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got if r["vec_id"] is not None) == [
        r for r in vector_brute(rows) if r[0] != "None"
    ]
    assert sorted((r["n_links"], str(r["component_id"])) for r in got if r["vec_id"] is None) == sorted((r[1], r[2]) for r in vector_brute(rows) if r[0] == "None")
    assert embedding_dedup.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("exact", [embedding_dedup.EXACT, 300])
def test_isolated_pairs_in_a_dense_cone_are_found(spark, exact):
    rng = np.random.default_rng(12)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rest = unit(rng.standard_normal((14_000, 64)))
    cone = unit(np.sqrt(0.85) * unit(rng.standard_normal(64)) + np.sqrt(0.15) * unit(rng.standard_normal((7_000, 64))))
    base = np.r_[rest[:200], cone[:200]]
    across = rng.standard_normal(base.shape)
    across = unit(across - (across * base).sum(1, keepdims=True) * base)
    twins = 0.955 * base + np.sqrt(1 - 0.955**2) * across
    rows = [(k, v.tolist()) for k, v in enumerate(np.r_[rest, cone])]
    place = np.r_[np.arange(200), 14_000 + np.arange(200)]
    rows += [(100_000 + k, v.tolist()) for k, v in zip(place.tolist(), twins, strict=True)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), exact=exact).collect()}
    assert len(got) == len(rows)
    lost = [k for k in place.tolist() if got[k]["component_id"] != got[100_000 + k]["component_id"]]
    assert len(lost) <= (0 if exact > 300 else 2), lost


def test_small_tables_go_through_passes(spark, monkeypatch):
    passes, pairs = [], []
    sorted_pass, all_pairs = embedding_dedup._sorted_pass, embedding_dedup._all_pairs
    monkeypatch.setattr(embedding_dedup, "_sorted_pass", lambda active, numbers, *rest: passes.append(numbers) or sorted_pass(active, numbers, *rest))
    monkeypatch.setattr(embedding_dedup, "_all_pairs", lambda active, n, *rest: pairs.append(n) or all_pairs(active, n, *rest))
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    whole = sorted(map(tuple, embedding_dedup.near_vectors(frame).collect()))
    assert passes == [[0, 1, 2, 3]] and not pairs  # a window holds the table: no bound is left open
    small = sorted(map(tuple, embedding_dedup.near_vectors(frame, block=64).collect()))
    assert len(passes) == 2 and len(pairs) == 1 and pairs[0] <= frame.count()
    assert small == whole


def test_neighbours_across_a_border_meet(spark):
    """One pass alone finds all links up to a quarter of a block apart in its order."""
    rng = np.random.default_rng(9)
    vec = rng.standard_normal((300, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vec)], "node long, vec array<double>")
    got = {(r["u"], r["v"]) for r in embedding_dedup._sorted_pass(rows, [0], Scratch(spark, "t"), -1.0, 40).collect() if r["u"] != r["v"]}
    joined = {n: n for n in range(300)}

    def root(n):
        while joined[n] != n:
            n = joined[n]
        return n

    for u, v in got:
        joined[root(u)] = root(v)
    assert len({root(n) for n in range(300)}) == 1  # at a threshold that all pairs pass, windows chain the whole order


def test_bound_of_a_miss_holds():
    rng = np.random.default_rng(3)
    units = rng.standard_normal((6_000, 16)) + 1.5
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    across = rng.standard_normal(units.shape)
    across -= (across * units).sum(1, keepdims=True) * units
    twins = 0.95 * units + np.sqrt(1 - 0.95**2) * across / np.linalg.norm(across, axis=1, keepdims=True)
    seen, bound = [], []
    for number in range(12):
        code, other = embedding_dedup.codes(units, number), embedding_dedup.codes(twins, number)
        order = np.argsort(code, kind="stable")
        for at in range(0, 6_000, 1_000):
            part = order[at : at + 1_000]
            bound.append(embedding_dedup.missed(code[part], np.zeros(1_000, np.int64), 0.95, at == 0, at == 5_000))
            low = code[part[0]] if at else -1
            high = code[part[-1]] if at < 5_000 else 1 << 60
            seen.append((other[part] >= low) & (other[part] <= high))
    assert np.mean(seen) >= 1 - np.mean(bound) - 0.01
    assert (embedding_dedup.missed(code[:9], np.zeros(9, np.int64), 0.95, True, True) == 0).all()


def test_float_vectors_of_the_table(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = embedding_dedup.near_vectors(frame.withColumn("embedding", F.col("embedding")))
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got.collect()) == vector_brute(rows)


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repeated_rows_bring_their_contexts_once(spark, monkeypatch, keep):
    cut = []
    stay = Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: cut.append(stay(self, df, name)) or cut[-1] if name == "texts" else stay(self, df, name))
    rng = np.random.default_rng(2)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 900))
    edited = text[:450] + "#" + text[451:]
    docs = spark.createDataFrame([(1, text)] * 20_000 + [(2, edited)], "doc_id long, text string").repartition(7)
    spans = {r["doc_id"]: suffix_dedup.merged_spans(*np.array([tuple(s) for s in r["spans"]]).T) for r in suffix_dedup.repeated_spans(docs, keep=keep).collect()}
    rows = cut[0].groupBy("h").count().agg(F.max("count")).first()[0]
    assert rows is None or rows <= 2 * 8  # not one per repeated row
    assert spans[2] == [(0, 450), (451, 900)]
    assert spans.get(1) == ([(0, 900)] if keep == "none" else None)
