"""Language codes: properties of the code, n-grams against a plain count, held-out accuracy and defined results."""

from __future__ import annotations

import binascii
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgealign.llm import language_codes, q_corpus

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("n", [2, 3, 4, 7, 8, 40])
def test_codewords_are_apart(n):
    code = language_codes.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    assert (np.abs(code.sum(0)) < n).all()
    assert language_codes.least_distance(code) >= (code.shape[1] // 2 if n <= 7 else code.shape[1] // 4)
    assert (language_codes.codewords(n) == code).all()


def plain_grams(text: bytes) -> Counter:
    seen = bytearray(b" ")
    for b in text:
        c = b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or seen[-1] != 32:
            seen.append(c)
    if seen[-1] != 32:
        seen.append(32)
    return Counter(bytes(seen[i : i + n]) for n in language_codes.SIZES for i in range(len(seen) - n + 1))


def test_buckets_equal_a_plain_count(monkeypatch):
    monkeypatch.setattr(language_codes, "CHUNK", 7)
    texts = [b"", b"Ab1c", "Straße, für SIE!".encode(), b"...", b"x" * 30, b" a  b "]
    raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    got: dict = {k: Counter() for k in range(len(texts))}
    for row, bucket in language_codes.gram_buckets(*language_codes.letters_in_line(raw, offsets)):
        for r, b in zip(row.tolist(), bucket.tolist(), strict=True):
            got[r][b] += 1
    name = {}
    for k, text in enumerate(texts):
        want = plain_grams(text)
        assert sum(got[k].values()) == sum(want.values())
        assert sorted(got[k].values()) == sorted(want.values())  # no collisions among so few
        for gram in want:
            name.setdefault(gram, len(name))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = q_corpus.op11_language(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(lang) and len(got) == len(lang)
    assert all(r["held_out"] == (binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    out = [r for r in got if r["held_out"] and lang[r["doc_id"]]]
    right = np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in out])
    assert len(out) > 100 and right >= 0.97, right
    wrong = [r["score"] for r in out if r["lang_pred"] != lang[r["doc_id"]]]
    assert not wrong or np.mean(wrong) < np.mean([r["score"] for r in out])
    # labels of the held-out fold, and other columns, are no input
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    blind = docs.withColumn("lang", F.when(~fold, F.col("lang")))
    book = language_codes.train(blind)
    again = {r["doc_id"]: r["lang_pred"] for r in language_codes.predict(docs.select("doc_id", "text"), book).collect()}
    assert again == {r["doc_id"]: r["lang_pred"] for r in got}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "x", 1.0) for i, t, g in rows], "doc_id long, text string, lang string, body string, score double")


def learnable(n: int) -> list[int]:
    return [k for k in range(10_000) if binascii.crc32(str(k).encode()) % 5][:n]


def test_defined_results(spark):
    words = {"xa": "lorem ipsum dolor sit amet", "xb": "zwo drei vier fünf acht", "xc": "один два три четыре пять"}
    ids = learnable(30)
    rows = [(ids[k], words[g] * (1 + k % 4), g) for k, g in enumerate(list(words) * 10)]
    rows += [rows[0]] * 300 + [(None, "lorem", "nobody"), (40_001, None, "xa"), (40_002, None, None), (40_003, "", None), (40_004, "12 34 !?", None), (40_005, "LOREM", None)]
    rows += [(40_006, "fünf acht " * 40_000, None), (40_007, "два", None)]
    docs = frame(spark, rows).repartition(4)
    book = language_codes.train(docs)
    assert book.languages == ["xa", "xb", "xc"]
    got = language_codes.predict(docs, book).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert [of[k] for k in (40_001, 40_002, 40_003, 40_004)] == [("und", 0.0)] * 4
    assert [of[k][0] for k in (40_005, 40_006, 40_007)] == ["xa", "xb", "xc"]
    assert all(of[i][0] == g for i, _, g in rows[:30])
    assert language_codes.predict(docs.limit(0), book).count() == 0


def test_one_language_and_none(spark):
    ids = learnable(3)
    one = frame(spark, [(ids[0], "abc", "xa"), (ids[1], "abd", "xa"), (ids[2], "?", None)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_codes.predict(one, language_codes.train(one)).collect()}
    assert got == {ids[0]: ("xa", 1.0), ids[1]: ("xa", 1.0), ids[2]: ("und", 0.0)}
    none = one.withColumn("lang", F.lit(None).cast("string"))
    got = language_codes.predict(none, language_codes.train(none))
    assert {(r["lang_pred"], r["score"]) for r in got.collect()} == {("und", 0.0)}


def test_a_mixed_text_is_ambiguous(spark):
    words = {"xa": "lorem ipsum dolor sit amet ", "xb": "zwo drei vier elf acht ", "xc": "uno dos tres cuatro cinco "}
    ids = learnable(30)
    docs = frame(spark, [(ids[k], words[g] * (1 + k % 4), g) for k, g in enumerate(list(words) * 10)])
    book = language_codes.train(docs)
    asked = frame(spark, [(1, words["xa"] * 3, None), (2, words["xa"] + words["xb"] + words["xc"], None)])
    got = {r["doc_id"]: r for r in language_codes.predict(asked, book).collect()}
    assert not got[1]["ambiguous"] and got[2]["score"] < got[1]["score"]
