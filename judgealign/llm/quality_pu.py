"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; the unlabelled sample is drawn from all documents, labels ignored, a
mixture with an unknown share of good documents. That share (the class prior) is estimated from the two samples: the least ratio of
unlabelled to positive mass above any threshold of a first classifier. The final model minimises the non-negative
unbiased risk ``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with the logistic loss.

The model is fitted on a bounded sample (``SAMPLE`` positives and as many unlabelled documents, those with the
smallest hash of the id, one text per id); only their features reach the driver. All documents are scored, by whole texts, from
counts of bytes, words and lines. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have all features zero and get the score of that point; several labels of one
document count as good only if all are; labels of a null ``doc_id`` are not used; without positives or unlabelled
texts every score is the prior (0.5 if unknown); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import body_of, owner_of, slices, table
from judgealign.llm.minhash import word_hashes
from judgealign.llm.store import keyed
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

#: Positives, and unlabelled documents, that the model is fitted on at most.
SAMPLE = 10_000
STEPS, RATE, DECAY = 400, 0.05, 1e-4
#: Least mass of positives above a threshold that the estimate of the prior looks at.
PRIOR_MASS = 0.3
THRESHOLD = 0.3
PUNCTUATION = [b for b in range(33, 127) if not chr(b).isalnum()]
N_FEATURES = len(PUNCTUATION) + 14


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text, from whole texts in a line."""
    rows = len(offsets) - 1
    out = np.zeros((rows, N_FEATURES))
    if not rows:
        return out
    owner = np.repeat(np.arange(rows), np.diff(offsets))
    bytes_ = np.bincount(owner * 256 + raw, minlength=rows * 256).reshape(rows, 256).astype(float)
    words, heads = word_hashes(raw, offsets)
    n_words = np.diff(heads).astype(float)
    of_word = np.repeat(np.arange(rows), np.diff(heads))
    same = (words[1:] == words[:-1]) & (of_word[1:] == of_word[:-1])
    stutter = np.bincount(of_word[1:][same], minlength=rows)
    distinct, top = np.zeros(rows), np.zeros(rows)
    for k in range(rows):
        if n_words[k]:
            counts = np.unique(words[heads[k] : heads[k + 1]], return_counts=True)[1]
            distinct[k], top[k] = len(counts), counts.max()
    breaks = np.flatnonzero(raw == 10)
    n_lines = np.bincount(owner_of(offsets, breaks), minlength=rows) + 1.0 if len(breaks) else np.ones(rows)
    per_word = 1.0 / np.maximum(n_words, 1)
    per_byte = 1.0 / np.maximum(np.diff(offsets), 1)
    upper, lower = bytes_[:, 65:91].sum(1), bytes_[:, 97:123].sum(1)
    shares = [
        *(np.log1p(100 * bytes_[:, b] * per_word) for b in PUNCTUATION),
        np.log1p(100 * bytes_[:, PUNCTUATION].sum(1) * per_word),
        upper * per_byte,
        np.log1p(20 * upper * per_word),
        np.log1p(20 * upper / np.maximum(lower, 1)),
        np.log1p(100 * bytes_[:, 48:58].sum(1) * per_byte),
        bytes_[:, 128:].sum(1) * per_byte,
        np.log1p(100 * stutter * per_word),
        np.log1p(20 * stutter * per_word),
        distinct * per_word,
        np.log1p(20 * top * per_word),
        np.log1p(n_words) / 10,
        np.minimum(np.diff(offsets) * per_word, 40) / 10,
        np.log1p(n_words / n_lines) / 5,
        np.log1p(100 * n_lines * per_word) / 5,
    ]
    out[:] = np.stack(shares, axis=1)
    out[np.diff(offsets) == 0] = 0
    return out


class Model:
    """Standardised features, a hidden layer and a logistic output."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, prior: float):
        self.centre, self.scale, self.weights, self.prior = centre, scale, weights, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.prior)
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _adam(gradient, size: int) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the least ratio of the two tails above a threshold."""
    cuts = np.quantile(p, np.linspace(0, 1 - PRIOR_MASS, 60))
    ratios = [(u >= c).mean() / (p >= c).mean() for c in cuts]
    return float(np.clip(min(ratios), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Fit on features of positives and of unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(0), 0.5)
    centre = positive.mean(0)
    scale = np.maximum(np.r_[positive, unlabelled].std(0), 1e-3)
    p, u = (np.c_[np.clip((x - centre) / scale, -8, 8), np.ones(len(x))] for x in (positive, unlabelled))
    curve = lambda x, w: 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

    def apart(w: np.ndarray) -> np.ndarray:
        return -((1 - curve(p, w)) @ p) / len(p) + (curve(u, w) @ u) / len(u)

    first = _adam(apart, p.shape[1])
    prior = estimate_prior(p @ first, u @ first)

    def risk(w: np.ndarray) -> np.ndarray:
        sp, su = curve(p, w), curve(u, w)
        good = -prior * ((1 - sp) @ p) / len(p)
        bad = -np.log1p(-np.minimum(su, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-9)).mean()
        slope = (su @ u) / len(u) - prior * (sp @ p) / len(p)
        return good + slope if bad >= 0 else -slope

    return Model(centre, scale, _adam(risk, p.shape[1]), prior)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "body", 1 << 20):
            x = features(*body_of(part.column("body")))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("positive"), part.column("free"), flat], names=["positive", "free", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` positives and ``sample`` documents of any kind outside the held-out fold."""
    label = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    place = F.xxhash64("doc_id")
    learn = ~held_out(F.col("doc_id"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").filter(learn).distinct()
    good = label.filter(learn).filter("quality = 1").select("doc_id").orderBy(place, "doc_id").limit(sample)
    free = ids.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    chosen = good.select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("free")).union(free.select("doc_id", F.lit(False), F.lit(True)))
    chosen = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("free").alias("free"))
    texts = keyed(docs).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample rows of 10 bytes
    texts = texts.groupBy("doc_id", "positive", "free").agg(F.min_by("body", "tk").alias("body"))  # one text per id
    rows = texts.mapInArrow(_featured, "positive boolean, free boolean, x array<double>").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, N_FEATURES)
    positive, free = (np.asarray(rows.column(c).to_numpy(), bool) for c in ("positive", "free"))
    order = np.lexsort((*x.T, positive, free))
    x, positive, free = x[order], positive[order], free[order]
    return fit(x[positive], x[free])


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                yield table(schema, doc_id=part.column("doc_id"), tk=part.column("tk"), score=model.score(features(*body_of(part.column("body")))))

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per document."""
    scored = keyed(docs).mapInArrow(_scored(model), "doc_id long, tk long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _judge(model: Model):
    def run(body: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([body], names=["body"])
        scores = [model.score(features(*body_of(part.column("body")))) for part in slices(batch, "body", 1 << 20)]
        return pa.array(np.concatenate(scores) if scores else np.zeros(0))

    run.__annotations__ = {"body": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The input rows, all columns, whose text scores at least ``threshold``."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.filter(_judge(model)(body) >= threshold)
