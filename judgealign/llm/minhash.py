"""Near-duplicate documents by min-max hashing, with every link confirmed on the full shingle sets.

1. A task turns whole texts into sets of word shingles and hashes each set under ``PERMUTATIONS`` permutations. Both
   the minimum and the maximum are kept, so half the hash evaluations give the same number of signature values;
   ``BANDS`` bands of ``ROWS`` values each are hashed to bucket keys. At the threshold of 0.8 a pair misses all bands
   with a probability of 5e-5, and any other path of links joins it as well.
2. Equal sets are one node from here on, so exact copies, however many, cost one row per bucket and task.
3. Only buckets with two different sets matter. Every member is compared with the pivot of its bucket, the node that
   meets the most others; links give labels, and equal labels mean one component. Jaccard distance is a metric, so a link has both ends in the loose
   circle of a pivot (three times the allowed distance) if it has one in its tight circle (twice that). Hence two
   kinds of groups hold all links that are still open: the circles, and what is outside of the tight circle in a
   bucket. A group that still has several labels is cut into blocks of bounded size; pairs of blocks are
   compared inside tasks, which return a spanning set of the links between labels, never the pairs.
4. A pair is confirmed on both full sets: 100 * intersection >= 80 * union.

Set operations use 64-bit hashes of shingles. A hot bucket is summed before its shuffle, its joins can be split.

Defined results: a text without words, null included, has an empty set and no links; repeated rows are links of each
other; a null ``doc_id`` takes part, and its component is the least id present; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import SPACE, body_of, groups, mix, slices, spanning, table
from judgealign.llm.components import components
from judgealign.llm.store import Scratch, keyed, same_doc
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

ROWS, BANDS = 5, 25
#: Shingles and sets in a block of sets that are compared with each other, and sets from which on a shingle is frequent there.
BLOCK_ITEMS, BLOCK_SETS, FREQUENT = 1_000_000, 2048, 24
PERMUTATIONS = (ROWS * BANDS + 1) // 2
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_LETTER = _DRAW.integers(0, 1 << 64, 256, dtype=np.uint64)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PLACE = _DRAW.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_FACTOR = _DRAW.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 64, PERMUTATIONS, dtype=np.uint64)
_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z in lower case), and the index of the first word of each row (one more than rows)."""
    word = ~_GAP[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    before = np.r_[False, word[:-1]] if len(raw) else word
    starts = np.flatnonzero(word & (~before | first[:-1]))
    after = np.r_[word[1:], False] if len(raw) else word
    ends = np.flatnonzero(word & (~after | first[1:])) + 1
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * powers(_BASE, len(raw)), out=total[1:])
    hashes = (total[ends] - total[starts]) * powers(_TURN, len(raw) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64) * _PLACE[-1]), np.searchsorted(starts, offsets)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all rows in a line, and where each row's set begins."""
    words, heads = word_hashes(raw, offsets)
    windows = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        windows += words[k : k + len(windows)] * _PLACE[k]
    windows = mix(windows)
    sets = []
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(windows[a : b - size + 1]))
        elif b > a:
            short = np.append(words[a:b] * _PLACE[: b - a], _PLACE[20 + b - a])
            sets.append(mix(short.sum(dtype=np.uint64, keepdims=True)))
        else:
            sets.append(np.zeros(0, np.uint64))
    begins = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), begins


def signatures(items: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Band keys of non-empty sets, one row per set: minima and maxima side by side, ROWS of them to a band."""
    starts = begins[:-1]
    values = np.empty((2 * PERMUTATIONS, len(starts)), np.uint64)
    for k in range(PERMUTATIONS):
        turned = items * _FACTOR[k]
        turned += _SHIFT[k]
        np.minimum.reduceat(turned, starts, out=values[2 * k])
        np.maximum.reduceat(turned, starts, out=values[2 * k + 1])
    keys = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for value in values[band * ROWS : (band + 1) * ROWS]:
            key = mix(key * _BASE + value)
        keys[:, band] = key
    return keys


SIGNED = "doc_id long, tk long, n int, s1 long, s2 long, bands array<long>"
_SIGNED = pa.schema([("doc_id", pa.int64()), ("tk", pa.int64()), ("n", pa.int32()), ("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                items, begins = shingle_sets(*body_of(part.column("body")), size)
                n = np.diff(begins)
                full = np.flatnonzero(n)
                s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                keys = np.zeros((0, BANDS), np.uint64)
                if len(full):
                    tight = np.r_[begins[full], begins[-1]]
                    keys = signatures(items, tight)
                    s1[full] = np.add.reduceat(mix(items ^ _PLACE[10]), tight[:-1])
                    s2[full] = np.add.reduceat(mix(items ^ _PLACE[11]), tight[:-1])
                ends = np.zeros(len(n) + 1, np.int32)
                ends[1:] = np.cumsum(np.where(n > 0, BANDS, 0))
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))
                yield table(_SIGNED, doc_id=part.column("doc_id"), tk=part.column("tk"), n=n.astype(np.int32), s1=s1.view(np.int64), s2=s2.view(np.int64), bands=bands)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part in slices(batch, "body", 1 << 20):
                items, begins = shingle_sets(*body_of(part.column("body")), size)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(items.view(np.int64)))
                nodes = part.column("node").to_pylist()
                fresh = [a != b for a, b in zip(nodes, [last, *nodes[:-1]], strict=True)]
                last = nodes[-1]
                yield pa.RecordBatch.from_arrays([part.column("node"), lists], names=["node", "items"]).filter(pa.array(fresh))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of shingles that the two sets of a pair share."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("common", pa.int64()), ("n_u", pa.int64()), ("n_v", pa.int64())])
    for batch in batches:
        common = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            both = np.concatenate((a.values.to_numpy(), b.values.to_numpy()))
            both.sort(kind="stable")
            common.append(int((both[1:] == both[:-1]).sum()))
        yield table(schema, u=batch.column("u"), v=batch.column("v"), common=common, n_u=batch.column("a").value_lengths(), n_v=batch.column("b").value_lengths())


def common_counts(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shared items of all pairs of sets in a block, as a square of counts.

    Only items of two sets and more count. Frequent ones are columns of a matrix that is multiplied with itself in
    slices; for rare ones the few pairs are added up.
    """
    m = len(sizes)
    out = np.zeros((m, m), np.float32)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    first = np.flatnonzero(np.r_[True, items[1:] != items[:-1]]) if len(items) else np.zeros(0, np.int64)
    runs = np.diff(np.r_[first, len(items)])
    for step in range(1, FREQUENT):
        starts = first[(runs > step) & (runs <= FREQUENT)]
        lengths = runs[(runs > step) & (runs <= FREQUENT)] - step
        at = np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(starts) else np.zeros(0, np.int64)
        np.add.at(out, (owner[at], owner[at + step]), 1)
    out += out.T
    wide = np.flatnonzero(runs > FREQUENT)
    for k in range(0, len(wide), 2048):
        part = wide[k : k + 2048]
        at = np.repeat(first[part] - np.r_[0, np.cumsum(runs[part])[:-1]], runs[part]) + np.arange(runs[part].sum())
        flags = np.zeros((m, len(part)), np.float32)
        flags[owner[at], np.repeat(np.arange(len(part)), runs[part])] = 1
        out += flags @ flags.T
    return out


def _across(percent: int):
    """Links between different labels inside pairs of blocks; only a spanning set of them is returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for whole in groups(batches, ["g", "low", "high"], 2000):
            keys = np.stack([whole.column(c).to_numpy() for c in ("g", "low", "high")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, keys.shape[1]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = whole.slice(a, b - a)
                node, part_of, side = (part.column(c).to_numpy() for c in ("node", "c", "side"))
                if b - a < 2 or (part_of == part_of[0]).all():
                    continue
                lists = part.column("items").combine_chunks()
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = common_counts(lists.flatten().to_numpy(), sizes)
                label = np.arange(b - a)
                for k in range(0, b - a, 256):
                    rows = slice(k, min(b - a, k + 256))
                    common = counts[rows].astype(np.int64)
                    near = 100 * common >= percent * (sizes[rows, None] + sizes - common)
                    near &= part_of[rows, None] != part_of
                    if keys[1, a] != keys[2, a]:
                        near &= side[rows, None] != side
                    left, right = np.nonzero(np.triu(near, k + 1))
                    label = spanning(b - a, np.r_[left + k, np.arange(b - a)], np.r_[right, label])
                moved = np.flatnonzero(label != np.arange(b - a))
                yield table(schema, u=node[moved], v=node[label[moved]])

    return run


def _links_across(placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of each group ``g`` with different labels ``c``, by pairs of blocks of bounded size."""
    sides = F.greatest(F.ceil(F.sum("n") / BLOCK_ITEMS), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    sizes = placed.groupBy("g").agg(sides.alias("sides"), F.min("c").alias("low"), F.max("c").alias("high"))
    torn = sizes.filter("low <> high").select("g", "sides")
    dealt = placed.join(torn, "g").join(sets, "node").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("g", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "c", "items")
    key = ["g", "low", "high"]
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_across(percent), "u long, v long")


def _near(percent: int, n_u: str = "n_u", n_v: str = "n_v") -> Column:
    return 100 * F.col("common") >= percent * (F.col(n_u) + F.col(n_v) - F.col("common"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id, tk, n_shingles, component_id, kept`` per document; documents link from ``percent`` of Jaccard on."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    whole = keyed(docs)
    signed = scratch.keep(whole.mapInArrow(_sign(size), SIGNED), "signed")
    rows = signed.filter("n > 0").select(F.explode("bands").alias("bucket"), "s1", "s2", "n")
    mixed = rows.groupBy("bucket").agg(F.min("s1").alias("low"), F.max("s1").alias("high")).filter("low <> high").select("bucket")
    members = scratch.keep(rows.join(mixed, "bucket").distinct(), "members")
    nodes = members.select("s1", "s2", "n").distinct().join(signed.select("doc_id", "tk", "s1", "s2", "n"), ["s1", "s2", "n"])
    nodes = nodes.groupBy("s1", "s2", "n").agg(F.min(F.struct("doc_id", "tk")).alias("one"))
    nodes = scratch.keep(nodes.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "n", "one.doc_id", "one.tk"), "nodes")
    members = scratch.keep(members.join(nodes.select("s1", "s2", "n", "node"), ["s1", "s2", "n"]).select("bucket", "node", "n"), "placed")
    scratch.drop("members")
    sets = whole.join(nodes.hint("merge"), same_doc(whole, nodes)).select(nodes["node"], whole["body"])
    sets = scratch.keep(sets.mapInArrow(_sets(size), "node long, items array<long>"), "sets")

    # every member against the pivot of its bucket: the node that meets the most others
    degree = members.join(members.groupBy("bucket").agg(F.count("*").alias("m")), "bucket").groupBy("node").agg(F.sum("m").alias("degree"))
    ranked = members.join(degree, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", "node", "n")).alias("p")).select("bucket", F.col("p.node").alias("u"), F.col("p.n").alias("n_u"))
    spokes = scratch.keep(members.join(pivots, "bucket").select("bucket", "node", "n", "u", "n_u"), "spokes")
    apart = 100 - percent
    tight, loose = max(1, 100 - 2 * apart), max(1, 100 - 3 * apart)
    alike = 100 * F.least("n", "n_u") >= loose * F.greatest("n", "n_u")
    pairs = spokes.filter((F.col("node") != F.col("u")) & alike).select("u", F.col("node").alias("v")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v")
    both = both.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u").select("u", "v", "a", "b")
    pairs = scratch.keep(both.mapInArrow(_shared, "u long, v long, common long, n_u long, n_v long"), "pairs")
    links = scratch.keep(pairs.filter(_near(percent)).select("u", "v"), "links")
    # the least pivot that a node links to: equal labels mean one component
    stars = links.select(F.col("v").alias("node"), "u").union(links.select(F.col("u").alias("node"), "u"))
    labels = scratch.keep(stars.groupBy("node").agg(F.min("u").alias("label")), "labels")

    # what may still link lies in one circle of a pivot, or in one bucket outside of the inner circle
    circles = components(pairs.filter(_near(loose)).select("u", "v"), scratch, "circles")
    circles = circles.select(F.col("component").alias("g"), "node").join(nodes.select("node", "n"), "node")
    inner = pairs.filter(_near(tight)).select("u", F.col("v").alias("node"))
    outside = spokes.filter("node <> u").join(inner, ["u", "node"], "left_anti").select(F.xxhash64("bucket").alias("g"), "node", "n")
    more = []
    for name, grouped in (("circle", circles), ("bucket", outside)):
        placed = grouped.join(labels, "node", "left").select("g", "node", "n", F.coalesce("label", "node").alias("c"))
        placed = scratch.keep(placed, f"{name}_nodes")
        more.append(scratch.keep(_links_across(placed, sets, percent), f"{name}_links"))
    joined = components(links.union(more[0]).union(more[1]), scratch, "all")

    classes = signed.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("least"))
    known = nodes.select("s1", "s2", "n", "node").join(joined, "node")
    classes = scratch.keep(classes.join(known, ["s1", "s2", "n"], "left").select("s1", "s2", "n", "least", "component"), "classes")
    tops = scratch.keep(classes.filter("component is not null").groupBy("component").agg(F.min("least").alias("top")), "tops")
    classes = classes.join(tops, "component", "left").select("s1", "s2", "n", F.coalesce("top", "least").alias("component_id"))
    scratch.drop("placed", "sets", "spokes")
    found = signed.select("doc_id", "tk", "n", "s1", "s2").join(classes, ["s1", "s2", "n"])
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "tk", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, found: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One input row per group of near duplicates, with all its columns: that of the least id (any of repeated rows)."""
    scratch = scratch or Scratch(docs.sparkSession, "minhash")
    kept = scratch.keep(found.filter("kept").groupBy("doc_id", "tk").agg(F.count("*").alias("copies")), "kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"))
    rows = whole.join(kept, same_doc(whole, kept)).select("row", whole["doc_id"], whole["tk"])
    if kept.filter("copies > 1").head(1):
        rows = rows.dropDuplicates(["doc_id", "tk"])
    return rows.select("row.*")
