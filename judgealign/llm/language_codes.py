"""Language identification by error-correcting output codes.

1. Every language gets a codeword of +1 and -1. Up to ``EXHAUSTIVE`` languages all different splits are used, which
   puts any two codewords half of their length apart; for more languages, the best of several drawn codes.
2. One scan counts the hashed n-grams of bytes (``SIZES`` long, in lower case, runs of other signs as one blank) per
   language over all documents of the learning fold. A bit of the code is predicted by a binary classifier: the mean over
   the n-grams of a text of the log ratio between the languages with +1 and those with -1, each language with the
   same mass, so that a frequent one does not rule.
3. A second scan sums the outputs and their squares per language and bit. The threshold of a bit lies between the
   languages of its two sides, in units of their deviations, and the weight of a bit for a language is the share of the
   language's documents that this bit decides rightly, as a normal distribution with these moments has it.
4. Loss-weighted decoding: a language's loss is the weighted mean of ``log(1 + exp(-code * output))`` over the bits; the
   least loss wins. A text is ambiguous where the signs of its bits are half of the least distance of the code away
   from every codeword, so that they alone would not decide.

Nothing is sampled: what the driver collects are n-gram counts (languages x ``BUCKETS`` at most) and moments.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is everything where no language can
be learned; with one language only, it is predicted with score 1; rows with a null ``doc_id`` or ``lang`` are not
learned from; repeated rows count and are predicted each; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import body_of, mix, owner_of, slices, table
from judgealign.llm.quality_pu import held_out
from judgealign.session import ship_with_tasks, spread

ship_with_tasks(__name__)

SIZES, BUCKETS = (2, 3, 4), 1 << 15
EXHAUSTIVE, DRAWS = 7, 200
#: Bytes of texts that a task works on at once, and languages whose counts a task holds at once.
CHUNK, HELD = 1 << 17, 64
SMOOTHING = 0.5
UNKNOWN = "und"

_DRAW = np.random.Generator(np.random.PCG64(20251102))
_PLACE = _DRAW.integers(0, 1 << 64, max(SIZES), dtype=np.uint64) | np.uint64(1)
_LENGTH = _DRAW.integers(0, 1 << 64, max(SIZES) + 1, dtype=np.uint64)
#: Bytes as n-grams see them: small letters, bytes of longer signs, and 32 for everything else.
_SEEN = np.full(256, 32, np.uint8)
_SEEN[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SEEN[128:] = np.arange(128, 256)


def codewords(n: int) -> np.ndarray:
    """A code of n rows of +1 and -1; no column is constant."""
    if n < 2:
        return np.zeros((n, 0))
    if n <= EXHAUSTIVE:
        columns = [(1, *bits) for bits in product((1, -1), repeat=n - 1) if -1 in bits]
        return np.array(columns, float).T
    length, best, apart = 15 * ceil(log2(n)), None, -1
    rng = np.random.Generator(np.random.PCG64([41, n]))
    for _ in range(DRAWS):
        code = rng.integers(0, 2, (n, length)) * 2.0 - 1
        code[0, np.abs(code.sum(0)) == n] *= -1
        nearest = least_distance(code)
        if nearest > apart:
            best, apart = code, nearest
    return best


def least_distance(code: np.ndarray) -> int:
    """Places in which the two nearest codewords differ."""
    if len(code) < 2:
        return 0
    agree = code @ code.T
    np.fill_diagonal(agree, -np.inf)
    return int((code.shape[1] - agree.max()) / 2)


def letters_in_line(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What n-grams see of all rows: each row begins with a blank and ends with one, blanks do not repeat."""
    rows = len(offsets) - 1
    wide = np.full(len(raw) + 2 * rows, 32, np.uint8)
    shift = np.repeat(2 * np.arange(rows) + 1, np.diff(offsets))
    wide[np.arange(len(raw)) + shift] = _SEEN[raw]
    bounds = offsets + 2 * np.arange(rows + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 32) | (wide[:-1] != 32)
    keep[bounds[:-1]] = True
    return wide[keep], np.r_[0, np.cumsum(keep)][bounds]


def gram_buckets(seen: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of all n-grams, in pieces; n-grams stay inside their row."""
    for at in range(0, len(seen), CHUNK):
        piece = seen[at : at + CHUNK + max(SIZES) - 1].astype(np.uint64)
        row = owner_of(offsets, np.arange(at, at + len(piece)))
        value = np.zeros(len(piece), np.uint64)
        for size in range(1, max(SIZES) + 1):
            n = min(CHUNK, len(piece) - size + 1)
            if n <= 0:
                break
            value = value[:n] + (piece[size - 1 : size - 1 + n] + np.uint64(1)) * _PLACE[size - 1]
            if size in SIZES:
                inside = row[:n] == row[size - 1 : size - 1 + n]
                yield row[:n][inside], (mix(value[inside] + _LENGTH[size]) % np.uint64(BUCKETS)).astype(np.int64)
            value = np.r_[value, np.zeros(len(piece) - n, np.uint64)]


_COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language and bucket of a task's rows."""
    held: dict[str, np.ndarray] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield table(_COUNTS, lang=pa.array([lang] * len(at)), bucket=at.astype(np.int32), n=counts[at])
        held.clear()

    for batch in batches:
        for part in slices(batch, "body", CHUNK):
            names = part.column("lang").dictionary_encode()
            of_row = names.indices.to_numpy()
            counts = np.zeros((len(names.dictionary), BUCKETS), np.int64)
            for row, bucket in gram_buckets(*letters_in_line(*body_of(part.column("body")))):
                counts += np.bincount(of_row[row] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
            for lang, more in zip(names.dictionary.to_pylist(), counts, strict=True):
                held[lang] = held[lang] + more if lang in held else more
            if len(held) > HELD:
                yield from rows()
    yield from rows()


@dataclass
class Codebook:
    """Languages, their codewords, the classifiers of the bits, and the weight of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    ratios: np.ndarray
    threshold: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def outputs(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean log ratio of every row and bit; 0 for rows without n-grams."""
        rows = len(offsets) - 1
        total, number = np.zeros((rows, self.ratios.shape[1])), np.zeros(rows)
        for row, bucket in gram_buckets(*letters_in_line(raw, offsets)):
            heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            if len(heads):
                total[row[heads]] += np.add.reduceat(self.ratios[bucket], heads, axis=0, dtype=np.float64)
                number += np.bincount(row, minlength=rows)
        return total / np.maximum(number, 1)[:, None]

    def decode(self, outputs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language with the least loss, its share of the likelihood, and whether the text is ambiguous."""
        rows, bits = len(outputs), self.code.shape[1]
        if not bits:
            return np.zeros(rows, np.int64), np.ones(rows), np.zeros(rows, bool)
        margin = np.clip((outputs - self.threshold) / self.scale, -30, 30)
        right, wrong = np.log1p(np.exp(-margin)), np.log1p(np.exp(margin))
        plus = np.where(self.code > 0, self.weights, 0.0)
        loss = right @ plus.T + wrong @ (self.weights - plus).T
        best = np.argmin(loss, axis=1)
        share = np.exp(-bits * (loss - loss.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        signs = np.where(margin >= 0, 1.0, -1.0)
        apart = (bits - signs @ self.code.T) / 2
        nearest = np.sort(apart, axis=1)
        return best, share[np.arange(rows), best], nearest[:, 0] * 2 >= least_distance(self.code)


def _moments(book: Codebook):
    schema = pa.schema([("lang", pa.string()), ("bit", pa.int32()), ("n", pa.int64()), ("s", pa.float64()), ("ss", pa.float64())])
    place = {lang: k for k, lang in enumerate(book.languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = book.code.shape[1]
        number, total, squares = np.zeros(len(place)), np.zeros((len(place), bits)), np.zeros((len(place), bits))
        for batch in batches:
            for part in slices(batch, "body", CHUNK):
                lang = np.array([place[x] for x in part.column("lang").to_pylist()])
                out = book.outputs(*body_of(part.column("body")))
                number += np.bincount(lang, minlength=len(place))
                np.add.at(total, lang, out)
                np.add.at(squares, lang, out * out)
        for lang, k in place.items():
            if number[k]:
                yield table(schema, lang=pa.array([lang] * bits), bit=np.arange(bits, dtype=np.int32), n=np.full(bits, int(number[k])), s=total[k], ss=squares[k])

    return run


def _below(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, by the logistic curve that is within 0.02 of it."""
    return 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))


def texts_of(docs: DataFrame, *more) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"), *more))


def train(docs: DataFrame) -> Codebook:
    """Learn from text and ``lang`` of the documents outside of the held-out fold."""
    known = docs.filter("lang is not null and doc_id is not null and text is not null").filter(~held_out(F.col("doc_id")))
    known = texts_of(known, F.col("lang").cast("string").alias("lang")).select("lang", "body")
    counted = known.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = counted.toArrow()  # languages x BUCKETS at most
    names = cells.column("lang").to_pylist()
    languages = sorted(set(names))
    code = codewords(len(languages))
    counts = np.zeros((len(languages), BUCKETS))
    place = {lang: k for k, lang in enumerate(languages)}
    counts[[place[x] for x in names], cells.column("bucket").to_numpy()] = cells.column("n").to_numpy()
    bits = code.shape[1]
    shares = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    side = lambda sign: (code == sign).T @ shares / np.maximum((code == sign).sum(0), 1)[:, None]
    ratios = np.log(side(1) / side(-1)).T.astype(np.float32) if bits else np.zeros((BUCKETS, 0), np.float32)
    book = Codebook(languages, code, ratios, np.zeros(bits), np.ones(bits), np.ones((len(languages), bits)) / max(bits, 1))
    if not bits:
        return book
    sums = known.mapInArrow(_moments(book), "lang string, bit int, n long, s double, ss double").groupBy("lang", "bit")
    mean, deviation = np.zeros(code.shape), np.ones(code.shape)
    for lang, bit, n, s, ss in sums.agg(F.sum("n"), F.sum("s"), F.sum("ss")).collect():  # languages x bits
        mean[place[lang], bit] = s / n
        deviation[place[lang], bit] = np.sqrt(max(ss / n - (s / n) ** 2, 0.0))
    return _calibrated(book, mean, np.maximum(deviation, 1e-3))


def _calibrated(book: Codebook, mean: np.ndarray, deviation: np.ndarray) -> Codebook:
    """Thresholds between the nearest languages of both sides, and weights by the shares that a bit decides rightly."""
    low = np.where(book.code > 0, mean, np.inf).argmin(0)
    high = np.where(book.code < 0, mean, -np.inf).argmax(0)
    bits = np.arange(book.code.shape[1])
    up, down = mean[low, bits], mean[high, bits]
    wide_up, wide_down = deviation[low, bits], deviation[high, bits]
    threshold = (up * wide_down + down * wide_up) / (wide_up + wide_down)
    scale = np.maximum((up - down) / 4, 1e-3)
    right = _below(book.code * (mean - threshold) / deviation)
    return Codebook(book.languages, book.code, book.ratios, threshold, scale, right / right.sum(1, keepdims=True))


_SAID = pa.schema([("doc_id", pa.int64()), ("lettered", pa.bool_()), ("lang", pa.string()), ("share", pa.float64()), ("unsure", pa.bool_())])


def _predicted(book: Codebook):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(book.languages, object)
        for batch in batches:
            for part in slices(batch, "body", CHUNK):
                best, share, unsure = book.decode(book.outputs(*body_of(part.column("body"))))
                yield table(_SAID, doc_id=part.column("doc_id"), lettered=part.column("lettered"), lang=pa.array(names[best], pa.string()), share=share, unsure=unsure)

    return run


def predict(docs: DataFrame, book: Codebook) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` per row of ``docs``; only ``text`` decides."""
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not book.languages:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    said = texts_of(docs, lettered.alias("lettered")).mapInArrow(_predicted(book), "doc_id long, lettered boolean, lang string, share double, unsure boolean")
    pick = lambda yes, no: F.when(F.col("lettered"), yes).otherwise(F.lit(no))
    return said.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), pick(F.col("lang"), UNKNOWN).alias("lang_pred"),
        pick(F.col("share"), 0.0).alias("score"), pick(F.col("unsure"), True).alias("ambiguous"),
    )
