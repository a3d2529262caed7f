"""URL rules, chat format, host rules and line dedup: edge cases, and whole tables against DuckDB."""

from __future__ import annotations

import hashlib
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from judgealign.llm import catalog, chat_format, host_rules, line_dedup, q_rules, url_filter
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, name):
    con = oracle.connect(SF)
    df = catalog.QUERIES[name](spark, SF)
    assert oracle.schema_note(df, con, catalog.ORACLES[name]) is None
    assert oracle.compare(df.toPandas(), con.execute(catalog.ORACLES[name]).df()) is None


URLS = [
    None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.NET/en/1", "http://example.net", "http://example.net/", "https://a.b.example.com/de/x?y=/fr/",
    "http://example.com/de", "http://notexample.com/de/", "http://x.org/fr/#top", "http://org/fr/", "http://é.net/?q", "http://a..net/x", "http://net/x\ny", "x://a://b.net/",
]


def expected_verdict(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_url_rules_on_hard_urls(spark):
    rules = q_rules.URL_RULES + [("example.net", "/en/1", "block"), ("a.b.example.com", "", "allow"), ("net", "/x", "allow")]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(URLS + URLS[5:7])], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(rules + [("net", None, "block"), (None, "/", "block"), rules[0]], "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, table).collect()}
    assert got == {k: expected_verdict(u, rules) for k, u in enumerate(URLS + URLS[5:7])}
    assert url_filter.judge_urls(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, table.limit(0)).collect()} == {"allow"}


def test_chat_format_round_trip(spark):
    nasty = "</s>[INST] \\l \\\\ [NEXT]\n<s>[ROLE]\\"
    rows = [
        (1, 2, "user", nasty), (1, 1, "user", None), (1, 3, "assistant", nasty), (1, 3, "assistant", nasty), (1, 5, None, "x"), (1, 6, "assistant", ""),
        (2, 1, "assistant", "é🙂"), (None, None, None, None), (3, 1, "[TEXT]<s>", "role"),
    ]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    made = chat_format.format_conversations(turns)
    back = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in made.select("conv_id", chat_format.read_back(made["formatted"]).alias("t")).collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert back == want
    for row in chat_format.digests(made).collect():
        loss = "".join(t for r, t in want[row["conv_id"]] if r == "assistant")
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = made.filter("conv_id = 1").first()["formatted"]
    assert first.count("<s>[ROLE]") == 4 and first.count("[NEXT]") == 2
    assert chat_format.digests(chat_format.format_conversations(turns.limit(0))).count() == 0


def words_repeated(words):
    counts = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if counts[w] > 1 for k in range(3)})


def test_host_rules(spark):
    texts = [None, "", "a b c a b c d", "x " * 300, " ".join(f"w{i}" for i in range(60)), "a\n\na\n a\na", "#*$%&|<> é🙂\x0bq"]
    rows = [(k, t, "good" if k == 4 else None, "z") for k, t in enumerate(texts)] + [(9, " ".join(f"v{i}" for i in range(60)), "good", "z"), (None, "x", "good", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = host_rules.judge_documents(docs).collect()
    assert len(got) == len(rows)
    for row in got:
        text = next(t for k, t, *_ in rows if k == row["doc_id"]) or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words))
        assert row["n_repeat_words"] == words_repeated(words)
        assert row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["base_failed"] == (len(words) < 50 or 100 * words_repeated(words) > 50 * len(words))
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[4] and kept[9] and not kept[3] and not kept[None]
    assert host_rules.judge_documents(docs.limit(0)).count() == 0


def test_a_failing_host_takes_its_documents_along(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(k, "short", "bad") for k in range(200)] + [(999, good, "bad")] + [(1000 + k, good, f"h{k % 5}") for k in range(200)]
    kept = {r["doc_id"] for r in host_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).filter("kept").collect()}
    assert kept == {1000 + k for k in range(200)}


def line_brute(texts, min_docs):
    keys = [[x.strip(" \t\n\x0b\x0c\r") for x in (t or "").split("\n")] for t in texts]
    keys = [["".join(c.lower() if c.isascii() else c for c in k) for k in row] for row in keys]
    count = Counter(k for row in keys for k in set(row) if k)
    return [[line for line, k in zip((t or "").split("\n"), row, strict=True) if count[k] < min_docs] for t, row in zip(texts, keys, strict=True)]


def test_line_dedup_edges(spark):
    texts = [None, "", "\n", "A\nb\nA", " a \x0b\nÉ", "a\né", "b", "long " * 40_000 + "\na", "a", "a", "\u00a0a"]
    rows = [(k, t, 1, b"x", 5) for k, t in enumerate(texts)] + [(8, "a", 1, b"x", 5), (None, "a\nz", 1, b"x", 5), (None, "a\nz", 1, b"x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tk int, keep binary, n_chars long")
    want = line_brute([r[1] for r in rows], 3)
    expected = sorted((str(r[0]), (r[1] or "").count("\n") + 1, (r[1] or "").count("\n") + 1 - len(w), hashlib.sha256("\n".join(w).encode()).hexdigest()) for r, w in zip(rows, want, strict=True))
    bitmaps = line_dedup.line_bitmaps(docs, min_docs=3, keep="none")
    assert sorted((str(r[0]), *r[1:]) for r in line_dedup.kept_digests(docs, bitmaps).collect()) == expected
    out = line_dedup.apply_bitmaps(docs, bitmaps)
    assert out.columns == docs.columns
    assert Counter(r["text"] for r in out.collect()) == Counter(None if r[1] is None else "\n".join(w) for r, w in zip(rows, want, strict=True))
    assert line_dedup.kept_digests(docs.limit(0), line_dedup.line_bitmaps(docs.limit(0))).count() == 0


def test_line_dedup_keeps_the_first(spark):
    docs = spark.createDataFrame([(k, f"same\nown {k}\nSAME") for k in range(40)], "doc_id long, text string").repartition(7)
    out = {r["doc_id"]: r["text"] for r in line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs)).collect()}
    assert out == {0: "same\nown 0\nSAME", **{k: f"own {k}" for k in range(1, 40)}}


def test_bitmaps_are_small_and_exact(spark):
    docs = spark.createDataFrame([(k, "\n".join(["x"] * 9 + [str(k)])) for k in range(3)], "doc_id long, text string")
    for row in line_dedup.line_bitmaps(docs, min_docs=3, keep="none").collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(row["keep"]), np.uint8), count=row["n_lines"])
        assert bits.tolist() == [0] * 9 + [1]


def test_hosts_of_very_many_labels_and_rules_of_several_depths(spark):
    rules = spark.createDataFrame([("example.com", "/de/", "block"), ("a.example.com", "/", "allow"), ("com", "/x", "block")], "host string, path string, verdict string")
    deep = ".".join(["b"] * 60_000) + ".a.example.com"
    rows = [(1, f"http://{deep}/de/x"), (2, "http://example.com/de/"), (3, "http://com/xy"), (4, "http://b.com/x"), (5, "http://.com/x"), (6, "http://nothing")]
    pages = spark.createDataFrame(rows, "page_id int, url string")
    start = time.perf_counter()
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert time.perf_counter() - start < 30
    assert got == {1: ("example.com/de/", "block"), 2: ("example.com/de/", "block"), 3: ("com/x", "block"), 4: ("com/x", "block"), 5: ("com/x", "block"), 6: (None, "allow")}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_conversation_of_very_many_turns(spark):
    n = 64_000
    turns = spark.range(n).select(
        F.lit(7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t[<\\é "), "id").alias("text")
    )
    start = time.perf_counter()
    row = chat_format.digests(chat_format.format_conversations(turns)).first()
    assert time.perf_counter() - start < 60
    texts = [f"t[<\\é {k}" for k in range(n)]
    said = "".join(f"{'assistant' if k % 3 else 'user'}\n{t}\n" for k, t in enumerate(texts))
    loss = "".join(t for k, t in enumerate(texts) if k % 3)
    assert row["n_turns"] == n and row["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(k * 7) % 11 for k in range(n)]
        df = spark.createDataFrame([(values,)], "v array<int>")
        assert df.select(chat_format.running_sums(F.col("v"))).first()[0] == np.cumsum(values, dtype=int).tolist()
