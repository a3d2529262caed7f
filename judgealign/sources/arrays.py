"""JSON array files read by many tasks: records are cut out of byte ranges, whatever lies across their borders.

The text reader splits a file at closing braces, so every task gets a range of whole fragments, which ends outside of
an escape. What a task cannot know is whether its range begins inside a string, and how deep.

1. A first scan sums each range up for both cases: how the depth changes if it begins outside or inside of a string,
   and whether an odd number of quotes turns one case into the other. That is a row per range.
2. Per file these rows are chained in order, which gives the true state at every border, and what a file that ends early
   keeps. A row per range goes back to the tasks (a broadcast of about a hundred bytes for each 128 MB of input).
3. A second scan cuts the elements of the array out. Elements that end in their range are records; the first
   and last pieces of a range are put together with those of its neighbours, a group per element.

Both scans hold a batch of fragments and the element at hand, never a file. A file whose first sign is not ``[`` is taken as
objects one behind the other. Compressed files are one range each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

RULES = ("boundary", "last_comma")
_QUOTE, _BACK, _COMMA, _CLOSE = ord('"'), ord("\\"), ord(","), ord("}")
_DEPTH = np.zeros(256, np.int64)
_DEPTH[[ord("["), ord("{")]] = 1
_DEPTH[[ord("]"), ord("}")]] = -1
_MARK = _DEPTH != 0
_MARK[[_QUOTE, _COMMA]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


def quotes_of(raw: np.ndarray) -> np.ndarray:
    """Which signs are quotes without an odd number of backslashes in front. ``raw`` begins outside of an escape."""
    quote = raw == _QUOTE
    back = raw == _BACK
    if back.any():
        place = np.arange(len(raw))
        begin = np.where(back & ~np.r_[False, back[:-1]], place, 0)
        run = place - np.maximum.accumulate(begin) + 1
        odd = back & (run % 2 == 1)
        quote[1:] &= ~odd[:-1]
    return quote


def marks_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places of the signs that matter, these signs, how many quotes have come up to each, and the number of quotes."""
    place = np.flatnonzero(_MARK[raw])
    sign = raw[place]
    quote = sign == _QUOTE
    if (raw == _BACK).any():
        quote &= quotes_of(raw)[place]
    turned = np.cumsum(quote, dtype=np.int32)
    free = sign != _QUOTE
    return place[free], sign[free], turned[free], int(turned[-1]) if len(turned) else 0


def _joined(values: pa.Array) -> np.ndarray:
    """Fragments in a line, without a copy."""
    _, bounds, signs = values.buffers()
    bounds = np.frombuffer(bounds, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(signs, np.uint8)[bounds[0] : bounds[-1]]


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, bool]]:
    """Batches of one byte range each: the columns beside the fragment, the signs, and whether the range ends here."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        change = (block[1:] != block[:-1]) | (file.indices.to_numpy()[1:] != file.indices.to_numpy()[:-1])
        cuts = np.r_[0, np.flatnonzero(change) + 1, batch.num_rows]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            head = {name: batch.column(name)[a].as_py() for name in batch.schema.names if name != "value"}
            signs = _joined(batch.column("value").slice(a, b - a))
            if held is not None:
                yield *held, (held[0]["file"], held[0]["block"]) != (head["file"], head["block"])
            held = head, signs
    if held is not None:
        yield *held, True


_SUMMARY = "file string, block long, file_size long, bytes long, odd boolean, out_depth long, in_depth long, first int, comma long, brace_comma long, commas array<struct<inside:boolean,depth:long,at:long>>"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per byte range: what it does to a state, for both cases."""
    span = pa.struct([("inside", pa.bool_()), ("depth", pa.int64()), ("at", pa.int64())])
    fields = [("file", pa.string()), ("block", pa.int64()), ("file_size", pa.int64()), ("bytes", pa.int64()), ("odd", pa.bool_()), ("out_depth", pa.int64()), ("in_depth", pa.int64())]
    schema = pa.schema([*fields, ("first", pa.int32()), ("comma", pa.int64()), ("brace_comma", pa.int64()), ("commas", pa.list_(span))])
    none = (0, 0, None, -1, -1)
    at, quotes, first, comma, brace_comma = none
    depth, last = [0, 0], [{}, {}]
    for head, raw, ends in _ranges(batches):
        place, sign, turned, number = marks_of(raw)
        inside = (turned + quotes) % 2 == 1
        for case in (0, 1):
            free = inside == bool(case)  # outside of strings if the range begins in this case
            kind, where = sign[free], place[free]
            level = depth[case] + np.cumsum(_DEPTH[kind])
            commas = np.flatnonzero(kind == _COMMA)
            for d in np.unique(level[commas]).tolist():
                last[case][d] = at + int(where[commas[level[commas] == d][-1]])
            depth[case] = int(level[-1]) if len(level) else depth[case]
        quotes += number
        if first is None:
            solid = np.flatnonzero(~_BLANK[raw])
            first = int(raw[solid[0]]) if len(solid) else None
        commas = np.flatnonzero(raw == _COMMA)
        if len(commas):
            comma = at + int(commas[-1])
            braces = np.flatnonzero(raw == _CLOSE)
            # the last comma with nothing but white space between it and a brace; a batch before ends with a brace
            for c in commas[::-1].tolist():
                k = int(np.searchsorted(braces, c)) - 1
                begin = int(braces[k]) + 1 if k >= 0 else 0
                if (k >= 0 or at) and _BLANK[raw[begin:c]].all():
                    brace_comma = at + c
                    break
        at += len(raw)
        if ends:
            spans = [{"inside": bool(case), "depth": d, "at": p} for case in (0, 1) for d, p in last[case].items()]
            row = [head["file"], head["block"], head["file_size"], at, quotes % 2 == 1, depth[0], depth[1], first, comma, brace_comma, spans]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
            at, quotes, first, comma, brace_comma = none
            depth, last = [0, 0], [{}, {}]


_PLAN = "file string, block long, inside boolean, depth long, base int, bare boolean, keep int"
#: What a file keeps: nothing, elements that a comma follows, all elements.
_NOTHING, _FOLLOWED, _ALL = 0, 1, 2


def _chained(rule: str):
    def run(ranges: pd.DataFrame) -> pd.DataFrame:
        """The state at the beginning of every range of a file, and what the file keeps."""
        ranges = ranges.sort_values("block").reset_index(drop=True)
        rows = ranges.to_dict("records")
        first = next((r["first"] for r in rows if not pd.isna(r["first"])), None)
        base = 1 if first == ord("[") else 0
        inside, depth, states = False, 0, []
        comma = brace = own = -1
        bare = sum(r["bytes"] for r in rows) != rows[-1]["file_size"]  # the last fragment has no brace behind it
        begin = 0
        for r in rows:
            states.append((inside, depth))
            comma = begin + r["comma"] if r["comma"] >= 0 else comma
            brace = begin + r["brace_comma"] if r["brace_comma"] >= 0 else brace
            here = [c["at"] for c in r["commas"] if c["inside"] == inside and c["depth"] + depth == 1]
            own = begin + here[0] if here else own
            begin += r["bytes"]
            depth += r["in_depth"] if inside else r["out_depth"]
            inside ^= r["odd"]
        # a brace that was added behind the last fragment is taken off again, unless it lies inside of a string
        depth += 1 if bare and not inside else 0
        whole = depth == 0 and not inside
        cut = own >= 0 and (comma == own or (rule == "boundary" and brace == own))
        keep = _ALL if whole or base == 0 else _FOLLOWED if cut else _NOTHING
        last = [False] * (len(rows) - 1) + [bare]
        return pd.DataFrame({"file": ranges["file"], "block": ranges["block"], "inside": [s[0] for s in states], "depth": [s[1] for s in states], "base": base, "bare": last, "keep": keep})

    return run


_PIECES = "file string, block long, seq long, record binary, opens boolean, ends boolean, element boolean, followed boolean"
_PIECE = pa.schema(
    [("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("record", pa.binary()), ("opens", pa.bool_()), ("ends", pa.bool_()), ("element", pa.bool_()), ("followed", pa.bool_())]
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the text between the borders of elements, in order.

    ``opens`` tells that a piece begins at a border of its range, ``ends`` that it ends at one (else it goes on in the next
    range), ``element`` that what it began with was ``[`` or a comma, ``followed`` that a comma ended it.
    """
    inside, depth, seq, held, opens, element = False, 0, 0, [], False, False
    fresh = True
    for head, raw, ends in _ranges(batches):
        if fresh:
            inside, depth, seq, held, opens = head["inside"], head["depth"], 0, [], False
            element, fresh = False, False
        base = head["base"]
        if ends and head["bare"]:
            raw = raw[:-1]
        place, marks, turned, number = marks_of(raw)
        free = (turned + inside) % 2 == 0
        inside = bool((number + inside) % 2)
        place, marks = place[free], marks[free]
        level = depth + np.cumsum(_DEPTH[marks])
        depth = int(level[-1]) if len(level) else depth
        if base:
            border = ((marks == _COMMA) & (level == 1)) | ((marks == ord("[")) & (level == 1)) | ((marks == ord("]")) & (level == 0))
        else:
            border = (_DEPTH[marks] < 0) & (level == 0)
        whole, at, rows = raw.tobytes(), 0, []
        for p, sign in zip(place[border].tolist(), marks[border].tolist(), strict=True):
            held.append(whole[at : p if base else p + 1])
            rows.append((head["file"], head["block"], seq, b"".join(held), opens, True, element, sign == _COMMA))
            held, at, seq, opens, element = [], p + 1, seq + 1, True, not base or sign != ord("]")
        held.append(whole[at:])
        if ends:
            rows.append((head["file"], head["block"], seq, b"".join(held), opens, False, element, False))
            fresh = True
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)], schema=_PIECE)


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What the text reader cuts at closing braces, each with a brace behind it, and the byte range that it begins in."""
    text = spark.read.option("lineSep", "}").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("file_size")]
    return text.select(F.concat(F.col("value").cast("binary"), F.lit(b"}")).alias("value"), *place)


def read_records(spark: SparkSession, path: str | list[str], rule: str = "boundary") -> DataFrame:
    """``file, block, seq, record``: the text of every element of JSON array files, and its place.

    Of a file that ends early, ``rule="last_comma"`` keeps the elements before its last comma if that is one between
    elements, and nothing else; ``rule="boundary"`` also takes the last comma that follows a closing brace. An element that no
    comma follows is not known to be whole and goes. Elements are cut, not checked: a broken one fails where it is parsed.
    """
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    fragments = _fragments(spark, path)
    plan = fragments.mapInArrow(_summaries, _SUMMARY).groupBy("file").applyInPandas(_chained(rule), _PLAN)
    known = fragments.join(F.broadcast(plan), ["file", "block"])  # a row per byte range
    pieces = known.select("value", "file", "block", "inside", "depth", "base", "bare").mapInArrow(_pieces, _PIECES)
    whole = pieces.where(F.col("opens") & F.col("ends"))
    # edges: at most two per range; a piece that ends begins a new element for what comes behind it
    edges = pieces.where(~(F.col("opens") & F.col("ends")))
    order = Window.partitionBy("file").orderBy("block", "seq")
    chain = F.coalesce(F.sum(F.col("opens").cast("int")).over(order), F.lit(0))
    parts = edges.withColumn("chain", chain)
    turn = F.struct("block", "seq", "record", "element", "followed", "ends")
    ordered = parts.groupBy("file", "chain").agg(F.array_sort(F.collect_list(turn)).alias("p"))
    joined = ordered.select(
        "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"),
        F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["record"])).alias("record"),
        F.col("p")[0]["element"].alias("element"), F.element_at("p", -1)["followed"].alias("followed"), F.element_at("p", -1)["ends"].alias("ends"),
    )
    columns = ["file", "block", "seq", "record", "element", "followed", "ends"]
    every = whole.select(*columns).union(joined.select(*columns))
    files = plan.groupBy("file").agg(F.max("keep").alias("keep"), F.max("base").alias("base"))
    kept = every.join(F.broadcast(files), "file")
    solid = F.trim(F.translate(F.col("record").cast("string"), "\t\r\n", "   ")) != ""
    take = F.col("ends") & solid & F.when(F.col("base") == 0, F.lit(True)).otherwise(F.col("element") & ((F.col("keep") == _ALL) | ((F.col("keep") == _FOLLOWED) & F.col("followed"))))
    return kept.where(take).select("file", "block", "seq", F.col("record").cast("string").alias("record"))
