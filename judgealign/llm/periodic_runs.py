"""Maximal periodic runs of words, by string synchronising sets.

A run is a stretch of words with smallest period q that is at least ``max(least, exponent * q)`` words long and that no
neighbouring word extends. Inside a task the words of whole texts lie in one line as 64-bit hashes, and for every
dyadic scale t = 1, 2, 4, ...

1. the fragments of t words get names by doubling (a hash of the names of their halves), and next occurrences of the
   names of half the length show where a fragment has a period of at most t / 3. These highly periodic places are
   left out of the set, or equal names side by side would select all of them;
2. a place i is selected if the least name among the other places of i .. i + t is that of i or of i + t. The choice
   depends on 2 t words only, so equal contexts are selected alike, and of any t places one is selected unless the
   3 t - 1 words there are highly periodic;
3. selected places with equal contexts of 2 t words, one next to the other at a distance q of t to 2 t - 1, propose the
   period q. A run of such a period is not highly periodic at this scale and is long enough for a selected place and
   its next equal context, and as 2 t exceeds q, the next one lies exactly q further on;
4. proposals that overlap by a period are one stretch, which is extended word by word to both sides.

The scale of a period is the greatest power of two up to it. The smallest periods (``SMALL``), which larger scales
omit as highly periodic, are detected separately: the stretches in which words q apart are equal. Every stretch is
compared word by word in the end, so no proposal is taken on trust.

A row is one text, and all its scales are worked on in its task, so there is no shuffle. What a task holds is a few
numbers per word of a slice of texts (or of one longer text).

Defined results: null and empty texts have no words and no runs; repeated rows, null ids and extra columns stay as they
are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import SPACE, body_of, mix, slices, table
from judgealign.session import ship_with_tasks, spread

ship_with_tasks(__name__)

LEAST, EXPONENT = 6, 4
#: Periods below this are found by comparing neighbours.
SMALL = 4
#: Bytes of texts that a task works on at once (a longer text comes alone), and words in a block of an extension.
SLICE, STRIDE = 1 << 20, 64
_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True
_DRAW = np.random.Generator(np.random.PCG64(20250611))
_LETTER = _DRAW.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
_BASE = _DRAW.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(5)
_TURN = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)
_HALF = _DRAW.integers(0, 1 << 64, 2, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def split_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, start and end of every word, and the index of the first word of each row (one more than rows)."""
    word = ~_GAP[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    starts = np.flatnonzero(word & (~np.r_[False, word[:-1]] | first[:-1])) if len(raw) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (~np.r_[word[1:], False] | first[1:])) + 1 if len(raw) else starts
    return _names(raw, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _names(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of every word from two rolling sums, by pieces of the text."""
    names = (ends - starts).astype(np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        end = max(at + 1, int(np.searchsorted(ends, low + SLICE, side="right")))
        piece = raw[low : ends[end - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        for letters, base, turn in zip(_LETTER, _BASE, _TURN, strict=True):
            np.cumsum(letters[piece] * _powers(base, len(piece)), out=total[1:])
            sums = (total[ends[at:end] - low] - total[starts[at:end] - low]) * _powers(turn, len(piece) + 1)[starts[at:end] - low]
            names[at:end] = mix(names[at:end] * _HALF[0] + mix(sums))
        at = end
    return names


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for every size, in a line."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _next_equal(names: np.ndarray, owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance from each place (in rising order) to the next one with the same name in the same row, 0 where there is
    none; and which places have such a one before or behind them."""
    order = np.argsort(names, kind="stable")
    same = (names[order[1:]] == names[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    out = np.zeros(len(names), np.int64)
    out[order[:-1][same]] = (places[order[1:]] - places[order[:-1]])[same]
    again = out > 0
    again[order[1:][same]] = True
    return out, again


def _least_ahead(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each value and the ``span - 1`` values behind it, where all of them exist."""
    width, out = 1, values
    while 2 * width <= span:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(values) - span + 1], out[span - width : len(values) - width + 1])


def _small_stretches(words: np.ndarray, owner: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches in which words q apart are equal; none crosses the end of a row."""
    same = (words[q:] == words[:-q]) & (owner[q:] == owner[:-q])
    edge = np.flatnonzero(np.diff(np.r_[False, same, False]))
    return edge[::2], edge[1::2] + q


def _extended(words: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Extend stretches ``low .. high`` of period q to both sides, at most to ``begin .. end`` of their rows."""
    low, high = low.copy(), high.copy()
    step = np.arange(STRIDE)
    for at in range(0, len(low), 1 << 14):
        some = np.arange(at, min(at + (1 << 14), len(low)))
        open_ = some
        while len(open_):
            place = low[open_, None] - 1 - step
            fits = (place >= begin[open_, None]) & (words[np.maximum(place, 0)] == words[np.maximum(place, 0) + q[open_, None]])
            more = np.where(fits.all(1), STRIDE, np.argmin(fits, 1))
            low[open_] -= more
            open_ = open_[more == STRIDE]
        open_ = some
        while len(open_):
            place = high[open_, None] + step
            inside = np.minimum(place, len(words) - 1)
            fits = (place < end[open_, None]) & (words[inside] == words[inside - q[open_, None]])
            more = np.where(fits.all(1), STRIDE, np.argmin(fits, 1))
            high[open_] += more
            open_ = open_[more == STRIDE]
    return low, high


def _periodic(words: np.ndarray, half: np.ndarray, alive: np.ndarray, t: int, owner: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose t words have a period of at most t / 3, and the places whose t / 2 words recur in their row.

    A period p of that kind shows as the next equal fragment of t / 2 words, exactly p further on. Only ``alive``
    places are looked at: those whose t / 4 words recur.
    """
    row = owner[alive]
    gap, again = _next_equal(half[alive], row, alive)
    maybe = np.flatnonzero((gap > 0) & (3 * gap <= t) & (alive + t <= end[row]))
    places = alive[maybe]
    return places[_has_period(words, places, gap[maybe], t)] if len(maybe) else places, alive[again]


def _scale_stretches(words, names, twice, alive, periodic, t: int, owner, begin, end):
    """``row, low, high, period`` of maximal stretches with a proposed period of t to 2 t - 1.

    ``names`` and ``twice`` name fragments of t and 2 t words; places without equal contexts are not ``alive``.
    """
    chosen = np.where(np.arange(len(names)) + t <= end[owner], names, _NONE)
    chosen[periodic] = _NONE
    least = _least_ahead(chosen, t + 1)
    at = alive[alive + 2 * t <= end[owner[alive]]]
    at = at[(least[at] != _NONE) & ((least[at] == chosen[at]) | (least[at] == chosen[at + t]))]
    gap, _ = _next_equal(twice[at], owner[at], at)
    found = np.flatnonzero((gap >= t) & (gap < 2 * t))
    at, q = at[found], gap[found]
    order = np.lexsort((at, q, owner[at]))
    at, q = at[order], q[order]
    row = owner[at]
    # neighbouring proposals of a period that share a period of words are one stretch
    joined = (row[1:] == row[:-1]) & (q[1:] == q[:-1]) & (at[1:] <= at[:-1] + 2 * t)
    heads = np.flatnonzero(np.r_[True, ~joined][: len(at)])
    tails = np.r_[heads[1:], len(at)][: len(heads)] - 1
    row, q, low, high = row[heads], q[heads], at[heads], at[tails] + q[tails] + 2 * t
    return row, *_extended(words, low, high, q, begin[row], end[row]), q


def _has_period(words: np.ndarray, at: np.ndarray, q: np.ndarray, t: int) -> np.ndarray:
    """Whether the t words from each place have period q; places close together share their comparisons."""
    out = np.zeros(len(at), bool)
    for period in np.unique(q):
        mine = np.flatnonzero(q == period)
        place = at[mine]
        # comparisons i, i + q are needed from each place on for t - q words: blocks of places that touch are one range
        cut = np.flatnonzero(np.diff(place) > t) + 1
        first, last = place[np.r_[0, cut]], place[np.r_[cut, len(place)] - 1]
        sizes = last - first + (t - period)
        flat = _ranges(sizes) + np.repeat(first, sizes)
        wrong = np.r_[0, np.cumsum(words[flat] != words[flat + period])]
        block = np.searchsorted(first, place, side="right") - 1
        start = (np.cumsum(sizes) - sizes)[block] + place - first[block]
        out[mine] = wrong[start + t - period] == wrong[start]
    return out


def _true_stretches(words: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Which stretches really have their period, word by word."""
    out = np.ones(len(low), bool)
    at = 0
    sizes = high - low - q
    while at < len(low):
        end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), 1 << 20)) + at)
        part = slice(at, end)
        flat = _ranges(sizes[part]) + np.repeat(low[part], sizes[part])
        wrong = words[flat] != words[flat + np.repeat(q[part], sizes[part])]
        out[part] = np.bincount(np.repeat(np.arange(end - at), sizes[part]), wrong, minlength=end - at) == 0
        at = end
    return out


def runs_of(words: np.ndarray, heads: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """``row, start, length, period`` of all runs, by row, start and period; starts count from the row's first word.

    ``words`` holds the names of all rows in a line, ``heads`` where each row begins (one more than rows).
    ``exponent`` is 4 at least: a run of period q must hold 3 t - 1 words and a period, t being up to q.
    """
    if exponent < 4:
        raise ValueError("runs shorter than four periods are not covered by the scales")
    sizes = np.diff(heads)
    rows, begin = np.arange(len(sizes)), heads[:-1]
    owner = np.repeat(rows, sizes)
    found = []
    for q in range(1, min(SMALL, len(words) // exponent + 1)):
        low, high = _small_stretches(words, owner, q)
        found.append(_kept(words, rows, owner[low], low, high, np.full(len(low), q), begin, least, exponent))
    t, names, half, alive = 1, words, words, np.arange(len(words))
    while len(names) >= 2 * t:
        if t >= SMALL:
            long_ = sizes >= exponent * t
            long_ &= np.bincount(owner[alive], minlength=len(sizes)) > 1
            # rows that are too short for this scale, or where nothing recurs, leave the line
            if not long_.all():
                stay = np.repeat(long_, sizes)
                alive = (np.cumsum(stay) - 1)[alive[stay[alive]]]
                words, names, half = words[stay], names[stay], half[stay]
                rows, sizes = rows[long_], sizes[long_]
                owner, begin = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
            if not len(alive):
                break
            end = begin + sizes
            periodic, alive = _periodic(words, half, alive, t, owner, end)
            twice = _doubled(names, t)
            row, low, high, q = _scale_stretches(words, names, twice, alive, periodic, t, owner, begin, end)
            found.append(_kept(words, rows, row, low, high, q, begin, least, exponent))
        else:
            twice = _doubled(names, t)
        half, names, t = names, twice, 2 * t
    return _smallest(np.concatenate(found) if found else np.zeros((0, 4), np.int64))


def _kept(words, rows, row, low, high, q, begin, least: int, exponent: int) -> np.ndarray:
    """``row, start, length, period`` of the stretches that are long enough and true; ``rows`` names the rows of the line."""
    fits = np.flatnonzero(high - low >= np.maximum(least, exponent * q))
    fits = fits[_true_stretches(words, low[fits], high[fits], q[fits])]
    return np.stack([rows[row[fits]], low[fits] - begin[row[fits]], (high - low)[fits], q[fits]], axis=1)


def _doubled(names: np.ndarray, t: int) -> np.ndarray:
    """Names of the fragments of 2 t words; places without t more words in the line keep a name of their own."""
    out = names * _HALF[0]
    out[: len(names) - t] += mix(names[t:] * _HALF[1])
    return mix(out)


def _smallest(every: np.ndarray) -> np.ndarray:
    """One row per stretch, with its smallest period, in order.

    A stretch of four periods and more that has a second, larger period has a multiple of the smallest one; the
    same stretch is maximal for both.
    """
    every = every[np.lexsort((every[:, 3], every[:, 2], every[:, 1], every[:, 0]))]
    new = np.r_[True, (every[1:, :3] != every[:-1, :3]).any(1)] if len(every) else np.zeros(0, bool)
    every = every[new]
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def _collapsed(raw: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray, kept: np.ndarray) -> Iterator[bytes]:
    """The kept words of every row, joined by one space.

    The byte behind a word is white space if it belongs to the row, so it becomes the separator.
    """
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[starts[kept]] += 1
    mark[np.minimum(ends + 1, np.repeat(offsets[1:], np.diff(heads)))[kept]] -= 1
    taken = np.cumsum(mark[:-1], dtype=np.int8) > 0
    text = raw[taken]
    text[_GAP[text]] = 32
    whole, bounds = text.tobytes(), np.r_[0, np.cumsum(taken)][offsets].tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield whole[a:b].rstrip(b" ")


def _found(keep_text: bool):
    span = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    last = pa.field("collapsed", pa.binary() if keep_text else pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(span)), last])
        for batch in batches:
            for part in slices(batch, "body", SLICE):
                raw, offsets = body_of(part.column("body"))
                words, starts, ends, heads = split_words(raw, offsets)
                runs = runs_of(words, heads)
                kept = ~covered(runs, heads)
                texts = [t if keep_text else hashlib.sha256(t).hexdigest() for t in _collapsed(raw, offsets, starts, ends, heads, kept)]
                bounds = np.searchsorted(runs[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
                yield table(schema, doc_id=part.column("doc_id"), n_words=np.diff(heads), runs=pa.ListArray.from_arrays(pa.array(bounds), spans), collapsed=pa.array(texts, last.type))

    return run


def covered(runs: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which words lie in a run behind its first period."""
    change = np.zeros(int(heads[-1]) + 1, np.int64)
    first = heads[:-1][runs[:, 0]] + runs[:, 1]
    np.add.at(change, first + runs[:, 3], 1)
    np.add.at(change, first + runs[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


def periodic_runs(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs`` (columns ``doc_id`` and ``text``).

    ``runs`` is an array of ``start, length, period`` by start and period. ``collapsed`` is the text of the words that
    no run holds behind its first period, joined by one space; without ``keep_text`` it is the SHA-256 of that text.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body")))
    schema = f"doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed {'binary' if keep_text else 'string'}"
    out = rows.mapInArrow(_found(keep_text), schema)
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` as a stated tenth of the documents repeats a stretch of its words up to the end.

    With h the unsigned CRC-32 of the id in decimal and g = h div 10, the documents of h mod 10 = 0 have their word i, from
    a = g mod n on, replaced by word a + (i - a) mod p, p being 1 + (n - a) div (3 + g mod 8). Documents without an id or
    without words stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(found):
        n = F.size(found["w"])
        a = (found["g"] % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + found["g"] % 8))).cast("int")
        return F.struct(found["w"].alias("w"), a.alias("a"), p.alias("p"))

    def joined(s):
        turned = F.transform(F.sequence(F.lit(0), F.size(s["w"]) - 1), lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])))
        return F.array_join(turned, " ")

    found = F.struct(words.alias("w"), F.floor(h / 10).alias("g"))
    text = F.transform(F.transform(F.array(found), repeated), joined)[0]  # each step is bound once
    chosen = F.coalesce((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return docs.select("doc_id", F.when(chosen, text).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent and digests of :func:`periodic_runs` without its texts."""
    # length / period exactly: whole numbers of a length times the other period
    ahead = lambda a, b: F.when(a["length"] * b["period"] > b["length"] * a["period"], a).otherwise(b)
    best = F.aggregate("runs", F.get(F.col("runs"), 0), lambda b, r: ahead(r, b))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    out = found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.col("collapsed").alias("collapsed_sha256"),
    )
    return out
