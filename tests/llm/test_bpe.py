from __future__ import annotations

import hashlib
import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from judgealign.llm import bpe
from judgealign.llm.q_corpus import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()
VOCABULARY = bpe.Vocabulary(bpe.read_vocabulary(PATH))
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()

HARD = [
    None, "", "   \n\t", "Hello World", "it's we'll I'D", "<|endoftext|>", "a<|startoftext|>b<|ENDOFTEXT|>c <|x", "é e\u0301 \u0301 x", "İstanbul ΣΑΣ ß ǅ",
    "a\x1cb\x1fc \x85d\xa0e\u3000f", "1234 ½ Ⅷ ٣", "!!!???...", "漢字かな🙂🙂", "\x00\x01", "x" * 5000, "ab" * 3000 + "'s", "\ufeffbom", ":\U0003d000", "tion" * 700 + "!" * 300,
]


def expected(text: str | None) -> tuple[int, str, str]:
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs", "Cn"])))
def test_encoder_equals_library(text):
    coder = bpe.Encoder(VOCABULARY, None)
    assert list(struct.unpack(f"<{len(c := coder.encode(text)) // 4}I", c)) == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 49000), min_size=1, max_size=4), max_size=60), st.lists(st.binary(max_size=6), max_size=20))
def test_lexicon_gives_back_its_words_and_no_others(words, others):
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    assert all(lexicon.get(w) == bpe.pack(ids) for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in others if w not in words)


def test_remembered_chunks_take_bounded_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "ROOM", 20_000)
    coder = bpe.Encoder(VOCABULARY, None)
    text = " ".join([f"{k}word{k * 7}.x{k}" for k in range(3000)] + ["blob" * 100 + str(k) for k in range(50)])
    assert list(struct.unpack(f"<{len(c := coder.encode(text)) // 4}I", c)) == LIBRARY.encode(text, add_special_tokens=False).ids
    for kept in (coder, coder.merged):
        assert 0 < sum(4 * len(w) + len(ids) for w, ids in kept.items()) <= 20_000
        assert max(map(len, kept)) <= bpe.KEPT


def test_only_words_of_the_lexicon_are_counted(spark):
    docs = spark.createDataFrame([("a b a " + "é" * 33 + " " + "x" * 64 + " " + "y" * 65,), (None,), ("b",)], "text string")
    got = {r["word"] for r in bpe.frequent_words(docs, 1000).collect()}
    assert got == {"a", "b", "x" * 64}


def test_special_tokens_of_any_form():
    plain = bpe.read_vocabulary(PATH)
    odd = bpe.Vocabulary(plain | {"special": {"[S]": 1, "[S]x": 2, "</s>": 3}})
    assert struct.unpack("<2I", odd.encode_chunk("[S]x</s>", bpe.Remembered())) == (2, 3)
    none = bpe.Vocabulary(plain | {"special": {}})
    assert none.encode_chunk("word", bpe.Remembered()) == VOCABULARY.encode_chunk("word", bpe.Remembered())


def test_lexicon_shares_suffixes():
    few = bpe.compile_lexicon({w: [1] for w in (b"station", b"nation", b"ration")})
    states = struct.unpack_from("<5I", few)[1]
    assert states <= 9  # separate words would need 20


def test_documents_equal_library(spark):
    rows = [(k, t, "x", k) for k, t in enumerate(HARD)] + [(None, "null id", "x", 1), (3, "Hello World", "x", 1), (3, "Hello World", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, PATH, lexicon_size=3).collect())
    assert got == sorted((r[0] is None, r[0] or 0, *expected(r[1])) for r in rows)


def test_round_trip_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "the quick fox<|endoftext|>"), (2, None)], "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH).collect()}
    assert back == {1: "the</w> quick</w> fox</w> <|endoftext|>", 2: ""}
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_whole_table_equals_library(spark):
    sf = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, PATH).drop("ids").collect()}
    assert got == {r["doc_id"]: expected(r["text"]) for r in docs.select("doc_id", F.col("text")).collect()}
