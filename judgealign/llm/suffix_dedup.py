"""Repeated byte strings by longest-previous-factor arrays over distributed suffix buckets.

A string of ``length`` bytes that stands at two places is found at both, within and across documents:

1. Every window of ``length`` bytes has an anchor: the least hash among its grams (the leftmost of equal ones). Equal
   windows have equal anchors, so a bucket per anchor gram holds all suffixes that can share ``length`` bytes.
   Neighbouring windows share an anchor, so a document is a list of contexts: runs of window starts, one anchor each.
2. Anchors seen once are dropped. Contexts that are equal as a whole need no text: they are counted, before and after
   the shuffle, and all their windows are repeats. Exact copies end here, however many there are.
3. The other contexts of an anchor (edges of copied passages, edited copies) are cut from their texts, one of each
   kind, and dealt by anchor. Each task builds the suffix array of the window starts of a block of buckets, the array
   of common prefixes, and, from previous and next smaller positions in suffix order, the longest previous factor of
   every start (with later positions in the same way). A factor of ``length`` bytes is a repeat.
4. An anchor with more than ``HOT`` different contexts is dealt by window instead: hashes of its single windows are
   counted by an aggregate, so no bucket grows without bound. The verdict is the same.

``keep="first"`` removes later copies and keeps the first (by id and place), ``keep="none"`` removes every copy.
Grams, contexts and hot windows are compared by 64-bit hashes, contexts and windows by two of them together.

Defined results: null and empty texts have no spans; texts shorter than ``length`` neither; rows that repeat id and
text are two occurrences of their text for ``keep="none"`` and one document for ``keep="first"``; null ids are ids;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import body_of, groups, mix, owner_of, slices, table
from judgealign.llm.minhash import powers
from judgealign.llm.store import Scratch, keyed, same_doc
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

LENGTH = 200
#: Different contexts of one anchor that a bucket takes at most (about 1 MB of text), and contexts in a block of buckets.
HOT, BLOCK = 4096, 800
_DRAW = np.random.Generator(np.random.PCG64(41))
_LETTER = _DRAW.integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_TURN = np.uint64(pow(int(_BASE), -1, 1 << 64))
_HIGH = np.uint64(0xFFFFFFFF00000000)


def gram_of(length: int) -> int:
    """Bytes of a gram for windows of ``length`` bytes."""
    return max(1, length // 5)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every position on."""
    n = len(raw)
    if n < gram:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[raw] * powers(_BASE, n), out=total[1:])
    return mix((total[gram:] - total[:-gram]) * powers(_TURN, n + 1)[: n - gram + 1])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return values if done == width else np.minimum(values[: len(values) - (width - done)], values[width - done :])


def contexts(raw: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, row, first and last window start (within the line of rows) of every context."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none.astype(np.uint64), none, none, none
    gram = gram_of(length)
    hashes = gram_hashes(raw, gram)
    placed = (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_least(placed, length - gram + 1) & ~_HIGH).astype(np.int64)
    inside = np.zeros(len(raw) + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    np.add.at(inside, offsets[long], 1)
    np.add.at(inside, offsets[long + 1] - length + 1, -1)
    valid = np.cumsum(inside)[: len(anchor)] > 0
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(anchor)] - 1
    first, last = first[valid[first]], last[valid[first]]
    return hashes[anchor[first]], owner_of(offsets, first), first, last


FOUND = "h long, c long, doc_id long, tk long, lo int, hi int"
_FOUND = pa.schema([(n, pa.int64()) for n in ("h", "c", "doc_id", "tk")] + [("lo", pa.int32()), ("hi", pa.int32())])


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                raw, offsets = body_of(part.column("body"))
                h, row, first, last = contexts(raw, offsets, length)
                data = memoryview(np.ascontiguousarray(raw))
                c = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist(), strict=True)], np.uint64)
                base, at = offsets[row], pa.array(row)
                yield table(
                    _FOUND, h=h.view(np.int64), c=c.view(np.int64), doc_id=part.column("doc_id").take(at), tk=part.column("tk").take(at),
                    lo=(first - base).astype(np.int32), hi=(last - base).astype(np.int32),
                )

    return run


_TEXTS = "h long, doc_id long, tk long, lo int, odd boolean, hot boolean, body binary"


def _new_rows(batch: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
    """The rows that differ in their document from the row before, the first one from ``last``.

    A merge join hands a task the repeated rows of a document one behind the other, so their contexts are cut once.
    """
    if not batch.num_rows:
        return batch, last
    ids, tk = batch.column("doc_id"), batch.column("tk").to_numpy()
    null, number = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    change = (tk[1:] != tk[:-1]) | (number[1:] != number[:-1]) | (null[1:] != null[:-1])
    new = np.r_[(tk[0], number[0], null[0]) != last, change]
    return (batch if new.all() else batch.filter(pa.array(new))), (tk[-1], number[-1], null[-1])


def _cut(length: int):
    """The bytes of the wanted contexts of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("odd", pa.bool_()), ("hot", pa.bool_()), ("body", pa.binary())])
        last = None
        for batch in batches:
            batch, last = _new_rows(batch, last)
            for part in slices(batch, "body", 1 << 21):
                wanted = part.column("wanted")
                row = pa.array(np.repeat(np.arange(part.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False)))
                raw, offsets = body_of(part.column("body"))
                data = raw.tobytes()
                flat = wanted.flatten()
                lo, span = flat.field("lo").to_numpy(), flat.field("span").to_numpy()
                begin = offsets[row.to_numpy()] + lo
                bodies = [data[a:b] for a, b in zip(begin.tolist(), (begin + span + length).tolist(), strict=True)]
                yield table(schema, h=flat.field("h"), doc_id=part.column("doc_id").take(row), tk=part.column("tk").take(row), lo=flat.field("lo"), odd=flat.field("odd"), hot=flat.field("hot"), body=bodies)

    return run


def nearest_smaller(position: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the common prefix with the nearest place before it of smaller position.

    ``lcp[r]`` is shared by places r-1 and r. All places jump at once over places that are already known to be
    larger, so the number of steps is logarithmic for monotone runs.
    """
    n = len(position)
    back, shared = np.arange(-1, n - 1), lcp.copy()
    open_ = np.arange(n)
    while len(open_):
        to = back[open_]
        open_ = open_[(to >= 0) & (position[to] > position[open_])]
        over = back[open_]
        shared[open_] = np.minimum(shared[open_], shared[over])
        back[open_] = back[over]
    shared[back < 0] = 0
    return shared


def longest_factors(buffer: np.ndarray, starts: np.ndarray, length: int, later: bool) -> np.ndarray:
    """Per start the longest factor (up to ``length``) that also begins at an earlier start of the same list.

    With ``later`` also matches at later starts count. Starts are in order of position and are followed by at least
    ``length`` bytes.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(n, np.int64)
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(buffer, length)[starts])
    order = np.argsort(rows.view(f"S{length}").reshape(-1), kind="stable")
    rows = rows[order]
    common = np.empty(n - 1, np.int64)
    for k in range(0, n - 1, 1 << 15):
        differ = rows[k + 1 : k + 1 + (1 << 15)] != rows[k : min(k + (1 << 15), n - 1)]
        common[k : k + (1 << 15)] = np.where(differ.any(1), differ.argmax(1), length)
    forward, backward = np.r_[0, common], np.r_[0, common[::-1]]
    best = np.maximum(nearest_smaller(order, forward), nearest_smaller(order[::-1], backward)[::-1])
    if later:
        best = np.maximum(best, np.maximum(nearest_smaller(-order, forward), nearest_smaller(-order[::-1], backward)[::-1]))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _once(part: pa.RecordBatch) -> pa.RecordBatch:
    """One row per place, from rows in order: several tasks may have cut the repeated rows of one document."""
    if part.num_rows < 2:
        return part
    ids = part.column("doc_id")
    keys = [*(part.column(c).to_numpy() for c in ("h", "tk", "lo")), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)]
    return part.filter(pa.array(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]))


SPAN = "doc_id long, tk long, lo int, hi int"
_SPAN = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _factors(length: int, later: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, ["h"], BLOCK):
            for part in block.to_batches():
                part = _once(part)
                raw, offsets = body_of(part.column("body"))
                counts = np.diff(offsets) - length + 1
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                repeat = longest_factors(raw, offsets[row] + place, length, later) >= length
                repeat &= part.column("odd").to_numpy(zero_copy_only=False)[row]
                edge = np.flatnonzero(np.diff(np.r_[False, repeat]) | (np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)))
                edge = edge[repeat[edge]]
                stop = np.r_[np.flatnonzero(~repeat[1:] | (row[1:] != row[:-1])), len(row) - 1] if len(row) else edge
                end = stop[np.searchsorted(stop, edge)]
                lo = part.column("lo").to_numpy()[row[edge]]
                at = pa.array(row[edge])
                yield table(_SPAN, doc_id=part.column("doc_id").take(at), tk=part.column("tk").take(at), lo=(lo + place[edge]).astype(np.int32), hi=(lo + place[end] + length).astype(np.int32))

    return run


_WINDOWS = "w1 long, w2 long, doc_id long, tk long, lo int, odd boolean"


def _windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.int64()) for n in ("w1", "w2", "doc_id", "tk")] + [("lo", pa.int32()), ("odd", pa.bool_())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                digests, row, place = [], [], []
                for k, body in enumerate(part.column("body")):
                    data = memoryview(body.as_py())
                    for s in range(len(data) - length + 1):
                        digests.append(xxhash.xxh3_128_digest(data[s : s + length]))
                        row.append(k)
                        place.append(s)
                words = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                take = pa.array(row, pa.int64())
                lo = part.column("lo").to_numpy()[row] + np.array(place, np.int32)
                yield table(schema, w1=words[:, 0], w2=words[:, 1], doc_id=part.column("doc_id").take(take), tk=part.column("tk").take(take), lo=lo.astype(np.int32), odd=part.column("odd").take(take))

    return run


def _not_first(first: str) -> Column:
    """Whether an occurrence is another one than the struct column ``first``."""
    same = F.col(f"{first}.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"{first}.tk") == F.col("tk")) & (F.col(f"{first}.lo") == F.col("lo"))
    return ~same


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep: str = "first", scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, tk, spans`` for documents with something to remove; spans are byte ranges, not yet merged."""
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    everywhere = keep == "none"
    whole = keyed(docs)
    found = scratch.keep(whole.mapInArrow(_contexts(length), FOUND), "found")
    # a written side lets Spark split the join of a hot anchor
    again = scratch.keep(found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "again")
    shared = scratch.keep(found.join(again, "h"), "shared")
    scratch.drop("found", "again")
    kinds = shared.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "lo", "hi")).alias("first"))
    kinds = scratch.keep(kinds, "kinds")
    same = shared.join(kinds.filter("n > 1").select("h", "c", "first"), ["h", "c"])
    same = same if everywhere else same.filter(_not_first("first"))
    spans = same.select("doc_id", "tk", "lo", (F.col("hi") + length).alias("hi"))

    varied = kinds.groupBy("h").agg(F.count("*").alias("n_kinds")).filter("n_kinds > 1")
    odd = (F.col("n") == 1) if everywhere else F.lit(True)
    wanted = F.struct("h", F.col("first.lo").alias("lo"), (F.col("first.hi") - F.col("first.lo")).alias("span"), odd.alias("odd"), (F.col("n_kinds") > HOT).alias("hot"))
    wanted = kinds.join(varied, "h").select(F.col("first.doc_id").alias("doc_id"), F.col("first.tk").alias("tk"), wanted.alias("w"))
    wanted = wanted.groupBy("doc_id", "tk").agg(F.collect_list("w").alias("wanted"))
    texts = whole.join(wanted.hint("merge"), same_doc(whole, wanted)).select(whole["doc_id"], whole["tk"], "wanted", "body")
    texts = scratch.keep(texts.mapInArrow(_cut(length), _TEXTS), "texts")
    order = ["h", "doc_id", "tk", "lo"]
    buckets = texts.filter("not hot").repartition("h").sortWithinPartitions(*order)
    spans = spans.union(buckets.mapInArrow(_factors(length, everywhere), SPAN))

    windows = scratch.keep(texts.filter("hot").mapInArrow(_windows(length), _WINDOWS), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tk", "lo")).alias("first")).filter("n > 1")
    hot = windows.filter("odd").join(twice, ["w1", "w2"])
    hot = hot if everywhere else hot.filter(_not_first("first"))
    spans = spans.union(hot.select("doc_id", "tk", "lo", (F.col("lo") + length).alias("hi")))
    return scratch.keep(spans.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def merged_spans(lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by the ranges, in order."""
    out: list[tuple[int, int]] = []
    order = np.argsort(lo, kind="stable")
    for a, b in zip(lo[order].tolist(), hi[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(body: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    ends = [0, *(b for _, b in spans)]
    starts = [*(a for a, _ in spans), len(body)]
    return b"".join(body[a:b] for a, b in zip(ends, starts, strict=True))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    for batch in batches:
        for part in slices(batch, "body", 1 << 22):
            rows = []
            for body, spans in zip(part.column("body"), part.column("spans"), strict=True):
                data, runs = body.as_py(), []
                if spans.is_valid:
                    runs = merged_spans(spans.values.field("lo").to_numpy(), spans.values.field("hi").to_numpy())
                kept = cut_spans(data, runs)
                rows.append((len(data), len(data) - len(kept), len(runs), [{"lo": a, "hi": b} for a, b in runs], kept))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _kept(batches):
        digests = pa.array([hashlib.sha256(k.as_py()).hexdigest() for k in part.column("kept")], pa.string())
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")), digests], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    whole = keyed(docs)
    return whole.join(spans.hint("merge"), same_doc(whole, spans), "left").select(whole["doc_id"], "body", "spans")


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id``, counts, the merged ``spans`` and the remaining bytes ``kept`` of every document.

    A cut may fall inside a character, so what remains is bytes.
    """
    return _with_spans(docs, spans).mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:int,hi:int>>, kept binary")


def kept_digests(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    return _with_spans(docs, spans).mapInArrow(_digested, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
