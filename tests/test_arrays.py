"""Cutting JSON array files into records, against a parser that reads whole texts."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from judgealign.sources import arrays, readers


def whole_text(text: str, rule: str) -> list:
    """What the salvage rules keep of one text."""

    def parsed(cut):
        try:
            return json.loads(cut)
        except json.JSONDecodeError:
            return None

    cuts = [text, (m[1] if (m := re.match(r"(?s)^(.*),", text)) else "") + "]"]
    if rule == "boundary":
        cuts.append((m[1] if (m := re.match(r"(?s)^(.*\})\s*,", text)) else "") + "]")
    return next((v for v in map(parsed, cuts) if v is not None), [])


def records(rng, n: int) -> list[dict]:
    odd = ['x"y{', "\\", "}{][,", 'é}\\"', ',"', "\n", "]"]
    return [{"id": f"a{i}", "t": rng.choice(odd) * rng.randint(0, 6), "n": {"k": [1, {"z": "}"}], "e": {}}, "v": i} for i in range(n)]


def found(spark, folder, rule) -> dict[str, list]:
    rows = arrays.read_records(spark, f"{folder}/*.json", rule).withColumn("name", F.element_at(F.split("file", "/"), -1))
    out: dict[str, list] = {}
    for r in rows.orderBy("file", "block", "seq").collect():
        out.setdefault(r["name"], []).append(json.loads(r["record"]))
    return out


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "300")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rule", arrays.RULES)
def test_records_across_ranges(spark, tmp_path, small_ranges, rule):
    rng = random.Random(5)
    recs = records(rng, 60)
    recs[20]["t"] = '}{"' * 900  # one record is longer than several ranges
    texts = {
        "indented": json.dumps(recs, indent=2), "plain": json.dumps(recs, ensure_ascii=False), "tight": json.dumps(recs, separators=(",", ":")),
        "numbers": "[1, 2.5, null, \"a,]\", [3, {}], {}]", "empty": "[]", "blank": " \n ", "nothing": "", "open": "[", "string": '["a", "b',
        "object": json.dumps(recs[3], indent=1), "lines": "\n".join(json.dumps(r) for r in recs[:9]), "behind": json.dumps(recs[:2]) + "\n\n",
    }
    short = json.dumps(recs[:6], indent=1)
    texts |= {f"cut{k}": short[:-k] for k in range(1, len(short), 9)}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text, newline="")
    got = found(spark, tmp_path, rule)
    assert arrays._fragments(spark, f"{tmp_path}/plain.json").rdd.getNumPartitions() > 10
    want = {f"{n}.json": whole_text(t, rule) for n, t in texts.items() if n not in ("object", "lines")}
    want |= {"object.json": [recs[3]], "lines.json": recs[:9]}
    assert got == {n: v for n, v in want.items() if v}


@pytest.mark.parametrize("large", [None, 0, 1 << 20])
def test_folder_readers_agree(spark, tmp_path, small_ranges, large):
    good = [{"id": f"i{k}", "specific_dimension": "d", "model_score": k, "char_profile": "}]" * (k % 9)} for k in range(200)]
    text = json.dumps(good)
    (tmp_path / "a [b].json").write_text(text)
    (tmp_path / "cut.json").write_text(text[:-5])
    (tmp_path / "short.json").write_text('[{"id": "w", "model_score": "no"}, {"id": "x"}]')
    rows = readers.read_folder(spark, str(tmp_path), large=large).collect()
    of = {name: sorted((r.id for r in rows if r.source_file == name), key=str) for name in {r.source_file for r in rows}}
    assert of == {"a [b].json": sorted(g["id"] for g in good), "cut.json": sorted(g["id"] for g in good[:-1]), "short.json": ["w", "x"]}
    with pytest.raises(FileNotFoundError):
        readers.read_folder(spark, str(tmp_path), pattern="*.none")


def test_broken_records_of_a_large_file_go_alone(spark, tmp_path):
    (tmp_path / "wrong.json").write_text('[{"id": "w", "model_score": "no"}, {"id": }, 7, {"id": "x"}]')
    assert sorted(r.id for r in readers.read_folder(spark, str(tmp_path), large=0).collect()) == ["w", "x"]


def test_unknown_rule(spark, tmp_path):
    with pytest.raises(ValueError):
        arrays.read_records(spark, str(tmp_path), "other")


def test_quotes_behind_backslashes():
    import numpy as np

    text = rb'a"b\"c\\"d\\\"e"'
    assert np.flatnonzero(arrays.quotes_of(np.frombuffer(text, np.uint8))).tolist() == [1, 8, 15]


def test_a_folder_of_many_small_files_is_one_path(spark, tmp_path):
    """Files are listed by Spark from the folder; no list of their paths is made in the driver's Python."""
    for i in range(40):
        (tmp_path / f"f{i}.json").write_text(f'[{{"id": "{i}"}}]')
    rows = readers.read_folder(spark, str(tmp_path))
    assert "InMemoryFileIndex(1 paths)" in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(int(r.id) for r in rows.collect()) == list(range(40))
