"""Mixing sources to target weights by the cube method.

Targets come from the weights (capped at ``max_repeats`` times a source's size, the excess shared again by weight).
A source with rate r = target / size takes every document floor(r) times and draws one more copy with inclusion
probability r - floor(r). The draw is balanced: the flight phase moves the probabilities of all undecided documents of a
block through the null space of the two constraints (words and number of documents) until one of them is 0 or 1. A
move aims at the longest document that can move at all and spreads what it wins or loses over the others, so
long documents are decided early and the few that stay are short. A document too long to be decided in balance
(``LONG``) is drawn by its probability at once, the others get the probabilities that make up for it in words as far
as they can, whatever the outcome. Every move is drawn so that no probability changes in expectation: each document is
taken with exactly the probability that it came with, and nothing is drawn anew.
Flights run in bounded blocks of a source; at most two documents of a block stay undecided, and these meet in the
blocks of the next level, until a source has one block. There the landing drops the number of documents, keeps the words
until one document is left, and draws that one.

A hot source only has more blocks. Draws come from a generator seeded by source, block and level over rows in a
fixed order, so a rerun or a recomputed task repeats them.

Defined results: a null text has size 0; documents of size 0 take part and add no words; null is a source, the last
one; rows that repeat id, source and text are decided together; a source without words has target 0; extra columns
pass through; an empty table gives empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from judgealign.llm.store import Scratch
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

#: Documents in a block of the flight phase.
BLOCK = 2048
NEAR = 1e-9
#: Share of the words that a block will take from which on a document counts as long.
LONG = 0.03


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Column | None = None, total: Column | None = None, max_repeats: float = 3.0) -> DataFrame:
    """``source, source_size, n, target`` from rows ``source, source_size, n``.

    Weights 1, 2, 3 repeat over the sources by code point, null last, where none are given. With caps c and weights
    w the targets are min(c, w * x). In the order of c / w the first sources are capped, and x, taken as if exactly the
    sources before a row were capped, is greatest where that is true.
    """
    whole = Window.partitionBy()
    place = F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("w", (weights if weights is not None else (place - 1) % 3 + 1).cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("total", total if total is not None else F.sum("source_size").over(whole).cast("double"))
    by_cap = whole.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("x", (F.col("total") - before) / rest)
    return rows.withColumn("level", F.max("x").over(whole)).select("source", "source_size", "n", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")).alias("target"))


def _settled(p: np.ndarray) -> np.ndarray:
    return np.where(p < NEAR, 0.0, np.where(p > 1 - NEAR, 1.0, p))


def _move(p: np.ndarray, u: np.ndarray, draw: float) -> np.ndarray:
    """Go along u, or against it, until one probability is 0 or 1; the way is drawn so that none changes in expectation."""
    rise, fall = u > 0, u < 0
    up = min(((1 - p[rise]) / u[rise]).min(initial=np.inf), (p[fall] / -u[fall]).min(initial=np.inf))
    down = min((p[rise] / u[rise]).min(initial=np.inf), ((1 - p[fall]) / -u[fall]).min(initial=np.inf))
    return _settled(p + (up if draw * (up + down) < down else -down) * u)


def _decided(p: np.ndarray, size: np.ndarray, balanced: np.ndarray | None, draw: float) -> np.ndarray:
    """Draw the first document now; the others take the place of its words, by ``balanced`` where that is possible."""
    first = p[0]
    if balanced is not None:
        u = balanced / balanced[0]
        both = np.r_[p + (1 - first) * u, p - first * u]
    if balanced is None or both.min() < -NEAR or both.max() > 1 + NEAR:
        room = np.minimum(p / (1 - first), (1 - p) / first)  # with these moves both outcomes stay probabilities
        room[0] = 0
        words = float(room @ size)
        u = -room * min(1.0, size[0] / words) if words > 0 else np.zeros(len(p))
        u[0] = 1
    return _settled(p + ((1 - first) if draw < first else -first) * u)


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide all but at most two documents; ``size`` is in falling order."""
    p = _settled(p)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    long = LONG * float(p @ size)
    while len(open_) > 2:
        q, s = p[open_], size[open_]
        # the residual of one document after a regression on (1, size) lies in the null space; weights keep documents
        # that are nearly decided from moving far
        weight = q * (1 - q)
        total = weight.sum()
        off = s - (weight @ s) / total
        spread = float(weight @ (off * off))
        slope = weight * off / spread if spread > 1e-18 * total * max(1.0, float(s[0]) ** 2) else np.zeros(len(q))
        movable = weight / total + slope * off < 1 - 1e-6
        at = int(np.argmax(movable))
        if not movable[at]:
            break
        u = -weight * (weight[at] / total + slope[at] * off)
        u[at] += weight[at]
        if s[0] > long:
            p[open_] = _decided(q, s, u if at == 0 else None, rng.random())
        else:
            p[open_] = _move(q, u, rng.random())
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def landing(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last documents: in pairs that keep the words (or the number, where there are none), then one by one."""
    p = p.copy()
    for some in (np.flatnonzero(size > 0), np.flatnonzero(size <= 0)):
        open_ = some[(p[some] > 0) & (p[some] < 1)]
        while len(open_) > 1:
            a, b = open_[:2]
            u = np.array([size[b], -size[a]]) / size[[a, b]].max() if size[a] > 0 else np.array([1.0, -1.0])
            p[[a, b]] = _move(p[[a, b]], u, rng.random())
            open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
        for k in open_:
            p[k] = float(rng.random() < p[k])
    return p


def _fly(level: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(words=rows["size"] * rows["copies"]).sort_values(["words", "place", "doc_id", "tk"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        name = f"{level}|{rows['source'].iloc[0]!r}|{rows['block'].iloc[0]}"
        rng = np.random.Generator(np.random.PCG64(zlib.crc32(name.encode())))
        size = rows["words"].to_numpy(float)
        p = flight(rows["p"].to_numpy(float), size, rng)
        if rows["n_blocks"].iloc[0] == 1:
            p = landing(p, size, rng)
        return rows.assign(p=p)[["doc_id", "tk", "source", "size", "copies", "place", "p"]]

    return run


STATE = "doc_id long, tk long, source string, size long, copies long, place long, p double"


def mix_sources(docs: DataFrame, max_repeats: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, tk, source, size, copies, source_size, target, times``: how often the mix takes each document."""
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    units = scratch.keep(rows.groupBy("doc_id", "tk", "source", "size").agg(F.count("*").alias("copies")), "units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n"))
    sources = scratch.keep(source_targets(sources, max_repeats=max_repeats), "sources").withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = units.join(sources, units["source"].eqNullSafe(sources["of"])).drop("of").withColumn("rate", rate)
    joined = joined.withColumn("base", F.floor(F.col("rate") + NEAR)).withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0)))
    fractional = F.col("p") > NEAR
    parts = []
    state = joined.filter(fractional).select("doc_id", "tk", "source", "size", "copies", F.xxhash64("doc_id", "tk", "size").alias("place"), "p")
    level = 0
    while True:
        counts = state.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks")).withColumnRenamed("source", "of")
        dealt = state.join(counts, state["source"].eqNullSafe(counts["of"])).drop("of")
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("place", F.lit(level)), F.col("n_blocks")))
        flown = scratch.keep(dealt.groupBy("source", "block").applyInPandas(_fly(level), STATE), f"level{level}")
        parts.append(flown.filter(F.col("p").isin(0.0, 1.0)))
        state = flown.filter(~F.col("p").isin(0.0, 1.0))
        if not state.head(1):
            break
        level += 1
    drawn = parts[0]
    for part in parts[1:]:
        drawn = drawn.union(part)
    drawn = drawn.select(F.col("doc_id").alias("d"), F.col("tk").alias("t"), F.col("source").alias("s"), F.col("size").alias("z"), F.col("p").alias("more"))
    same = joined["doc_id"].eqNullSafe(drawn["d"]) & (joined["tk"] == drawn["t"]) & joined["source"].eqNullSafe(drawn["s"]) & (joined["size"] == drawn["z"])
    times = (F.col("base") + F.coalesce("more", F.lit(0.0))).cast("long")
    return joined.join(drawn, same, "left").select("doc_id", "tk", "source", "size", "copies", "source_size", "target", times.alias("times"))


def taken(mix: DataFrame) -> DataFrame:
    """One row per input document: ``doc_id, size, source_size, target, taken`` (words, repeats counted)."""
    each = mix.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The input rows with all their columns, each as often as the mix takes it."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("t"), F.col("source").cast("string").alias("s"))
    same = whole["d"].eqNullSafe(mix["doc_id"]) & (whole["t"] == mix["tk"]) & whole["s"].eqNullSafe(mix["source"])
    kept = mix.filter(F.col("times") > 0)
    joined = whole.join(kept, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"))
    return joined.select("row.*")
