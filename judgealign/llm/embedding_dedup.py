"""Near-duplicate vectors by sorted projection passes.

1. Equal vectors become one row with a count. Vectors that are null, empty, zero or hold null or non-finite
   components stay alone.
2. Each pass concatenates random projection bits to a code and orders all vectors by it. A vector is compared, by
   exact cosine, with the vectors of a window around it in that order: the order is cut into blocks of ``BLOCK``
   vectors, and a block also sees the quarter of a block that follows it, so neighbours up to a quarter of a block
   apart always meet. If all vectors that share the first b bits of a vector's code lie in its block, a vector linked to
   it is one of them with a probability of (1 - angle / pi) ** b at least. So each pass bounds the chance that a link
   of a vector is still missed, and passes with fresh bits go on over the vectors where the product of these
   bounds exceeds ``MISS``: more of them in larger tables and in dense regions. Every table goes through passes.
   As soon as comparing all vectors that are left costs no more than the passes did (``EXACT`` vectors per pass), all
   their pairs are compared in pairs of blocks inside tasks, and nothing is missed among them.
3. Verified pairs of all passes are united to components.
4. A block bounds what a pass compares, not what is counted: the links of a vector are counted exactly among all
   vectors of its component, in pairs of blocks of ``SIDE`` vectors. Nothing but counts leaves these tasks.

Defined results: vectors of unequal length never link; rows that repeat id and vector link like other equal vectors;
a null ``vec_id`` takes part and its component is the least id present; labels and other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import groups, spanning, table
from judgealign.llm.components import components
from judgealign.llm.store import Scratch
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

PER_JOB, BITS, BLOCK, SIDE = 4, 48, 2048, 1024
THRESHOLD = 0.95
#: Chance, at most, that a vector at the threshold is missed; vectors per pass whose pairs cost as much as the passes;
#: vectors in a block, and blocks at least, of the comparison of all pairs.
MISS, EXACT, WIDE, WIDES = 1e-3, 8192, 8192, 16


def unit_rows(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of unit length in double precision, padded with zeros to the longest, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max()) if len(sizes) else 0
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)
    out /= np.sqrt((out * out).sum(1, keepdims=True))
    return out, sizes


def codes(units: np.ndarray, number: int) -> np.ndarray:
    """Projection bits of pass ``number``, concatenated to one integer per vector."""
    planes = np.random.Generator(np.random.PCG64([977, number])).standard_normal((BITS, units.shape[1]))
    bits = (units @ planes.T) >= 0
    return bits @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


CODED = "pass int, size int, code long, node long, vec array<double>"
_CODED = pa.schema([("pass", pa.int32()), ("size", pa.int32()), ("code", pa.int64()), ("node", pa.int64()), ("vec", pa.list_(pa.float64()))])


def _coded(numbers: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, sizes = unit_rows(batch.column("vec"))
            for number in numbers:
                yield table(_CODED, **{"pass": np.full(len(sizes), number, np.int32)}, size=sizes.astype(np.int32), code=codes(units, number), node=batch.column("node"), vec=batch.column("vec"))

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted part with the part's number and their place in it."""
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        columns = [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n, dtype=np.int64)), *(batch.column(c) for c in ("pass", "code", "node", "vec"))]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "at", "pass", "code", "node", "vec"])
        at += n


def linked(units: np.ndarray, kind: np.ndarray, threshold: float, rows: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """The least vector that each one is connected with by links between ``rows`` and ``others`` (or among ``rows``) of one kind."""
    label = np.arange(len(units))
    for k in range(0, len(rows), 512):
        x, y = rows[k : k + 512], rows[k:] if others is None else others
        left, right = np.nonzero((units[x] @ units[y].T >= threshold) & (kind[x][:, None] == kind[y]))
        left, right = x[left], y[right]
        new = label[left] != label[right]
        label = spanning(len(units), np.r_[left[new], np.arange(len(units))], np.r_[right[new], label])
    return label


def missed(code: np.ndarray, kind: np.ndarray, threshold: float, first: bool, last: bool) -> np.ndarray:
    """Bound, per vector of a block in order, on the chance that this pass misses a vector at the threshold.

    ``first`` and ``last`` tell that no block precedes or follows. Runs of a kind that begin and end inside the block
    are whole; otherwise the outermost codes of the run stand for those beyond the block.
    """
    starts = np.flatnonzero(np.r_[True, kind[1:] != kind[:-1]])
    ends = np.r_[starts[1:], len(kind)]
    bits = np.zeros(len(kind), np.int64)
    for edge, out, at in ((0, first, starts[0]), (len(starts) - 1, last, ends[-1] - 1)):
        if not out:
            run = slice(starts[edge], ends[edge])
            shared = BITS - np.frexp((code[run] ^ code[at]).astype(np.float64))[1]
            bits[run] = np.maximum(bits[run], shared + 1)
    share = (1 - np.arccos(threshold) / np.pi) ** bits
    return np.where(bits > BITS, 1.0, 1 - share)


LINKED = "u long, v long, gain double"
_LINKED = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("gain", pa.float64())])


def _blocks(threshold: float, final: int):
    """Spanning links of each block and what follows it, and a row ``u = v`` per vector of the block with the logarithm
    of its bound of a miss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["block"], 2000):
            blocks = whole.column("block").to_numpy()
            cuts = np.r_[0, np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, len(blocks)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = whole.slice(a, b - a)
                units, sizes = unit_rows(part.column("vec"))
                number, node, code = (part.column(c).to_numpy() for c in ("pass", "node", "code"))
                own = int(part.column("own").to_numpy(zero_copy_only=False).sum())  # these come first
                kind = (number.astype(np.int64) << 32) + sizes
                label = linked(units, kind, threshold, np.arange(b - a))
                moved = np.flatnonzero(label != np.arange(b - a))
                yield table(_LINKED, u=node[moved], v=node[label[moved]], gain=pa.nulls(len(moved), pa.float64()))
                if not own:
                    continue  # the order ends here
                chance = missed(code[:own], kind[:own], threshold, blocks[a] == 0, blocks[a] == final)
                yield table(_LINKED, u=node[:own], v=node[:own], gain=np.log(np.maximum(chance, 1e-300)))

    return run


def _sorted_pass(active: DataFrame, numbers: list[int], scratch: Scratch, threshold: float, block: int) -> DataFrame:
    """Links (at most one per vector and block) of some passes, and what they say of each vector."""
    order = ["pass", "size", "code", "node"]
    coded = active.select("node", "vec").mapInArrow(_coded(numbers), CODED)
    ranked = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "part long, at long, pass int, code long, node long, vec array<double>")
    ranked = scratch.keep(ranked, f"ranked{numbers[0]}")
    sizes = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per task
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part], total = total, total + sizes[part]
    begins = active.sparkSession.createDataFrame(list(starts.items()), "part long, begin long")
    rank = ranked.join(F.broadcast(begins), "part").select((F.col("begin") + F.col("at")).alias("rank"), "pass", "code", "node", "vec")
    # a vector in the first quarter of a block is also seen by the block before
    seen = F.when((F.col("rank") % block < block // 4) & (F.col("rank") >= block), F.array(F.lit(0), F.lit(-1))).otherwise(F.array(F.lit(0)))
    dealt = rank.withColumn("turn", F.explode(seen)).withColumn("block", F.floor(F.col("rank") / block) + F.col("turn"))
    dealt = dealt.withColumn("own", F.col("turn") == 0).repartition("block").sortWithinPartitions("block", "rank")
    links = scratch.keep(dealt.mapInArrow(_blocks(threshold, (total - 1) // block), LINKED), f"links{numbers[0]}")
    scratch.drop(f"ranked{numbers[0]}")
    return links


def _pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in groups(batches, ["low", "high"], 2000):
            keys = np.stack([whole.column(c).to_numpy() for c in ("low", "high")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, keys.shape[1]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = whole.slice(a, b - a)
                units, sizes = unit_rows(part.column("vec"))
                node, side = part.column("node").to_numpy(), part.column("side").to_numpy()
                x, y = (np.flatnonzero(side == k) for k in keys[:, a])
                label = linked(units, sizes, threshold, x, None if keys[0, a] == keys[1, a] else y)
                moved = np.flatnonzero(label != np.arange(b - a))
                yield table(_LINKED, u=node[moved], v=node[label[moved]], gain=pa.nulls(len(moved), pa.float64()))

    return run


def _all_pairs(active: DataFrame, n: int, scratch: Scratch, threshold: float) -> DataFrame:
    """Spanning links among all of ``n`` vectors, by pairs of blocks."""
    sides = max(WIDES, -(-n // WIDE))
    placed = active.select("node", "vec", F.pmod(F.xxhash64("node"), F.lit(sides)).cast("int").alias("side"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    dealt = other.select(F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "vec")
    dealt = dealt.repartition("low", "high").sortWithinPartitions("low", "high")
    return scratch.keep(dealt.mapInArrow(_pairs(threshold), LINKED), "pairs")


def _found(classes: DataFrame, scratch: Scratch, threshold: float, block: int, exact: int) -> DataFrame:
    """Links that join what is linked: passes while they are needed and cheaper, then all pairs of what is left."""
    active, n, done, found = classes, classes.count(), 0, []
    while n > exact * done:
        found.append(_sorted_pass(active, list(range(done, done + PER_JOB)), scratch, threshold, block))
        gains = reduce(DataFrame.union, found).filter("gain is not null").groupBy("u").agg(F.sum("gain").alias("gain"))
        left = gains.filter(F.col("gain") > float(np.log(MISS))).select(F.col("u").alias("node"))
        active = scratch.keep(active.select("node", "vec").join(left, "node", "left_semi"), f"active{done}")
        if done:
            scratch.drop(f"active{done - PER_JOB}")
        n, done = active.count(), done + PER_JOB
    if n or not found:  # an empty table has no passes
        found.append(_all_pairs(active, n, scratch, threshold))
    return reduce(DataFrame.union, found).filter("u <> v").select("u", "v")


def _counted(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64())])
        for whole in groups(batches, ["component", "low", "high"], 2000):
            keys = np.stack([whole.column(c).to_numpy() for c in ("component", "low", "high")])
            cuts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, keys.shape[1]]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = whole.slice(a, b - a)
                units, sizes = unit_rows(part.column("vec"))
                node, copies, side = (part.column(c).to_numpy() for c in ("node", "copies", "side"))
                low, high = keys[1, a], keys[2, a]
                x, y = np.flatnonzero(side == low), np.flatnonzero(side == high)
                near = (units[x] @ units[y].T >= threshold) & (sizes[x][:, None] == sizes[y])
                if low == high:
                    np.fill_diagonal(near, False)
                    yield table(schema, node=node[x], n=near @ copies[y])
                else:
                    yield table(schema, node=np.r_[node[x], node[y]], n=np.r_[near @ copies[y], copies[x] @ near])

    return run


def _links_within(members: DataFrame, threshold: float, side: int) -> DataFrame:
    """Exact link counts ``node, n`` of vectors among all vectors of their component, by pairs of blocks."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / side).cast("int").alias("sides"))
    placed = members.join(sizes, "component").withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = other.select("component", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "copies", "vec")
    key = ["component", "low", "high"]
    counted = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(_counted(threshold), "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, exact: int = EXACT, side: int = SIDE, scratch: Scratch | None = None
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (columns ``vec_id`` and ``embedding``)."""
    scratch = scratch or Scratch(vectors.sparkSession, "vectors")
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    fit = F.coalesce((F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).withColumn("fit", fit)
    rows = rows.withColumns({"c1": F.xxhash64("vec"), "c2": F.xxhash64(F.lit(7), F.reverse("vec"))})
    classes = rows.filter("fit").groupBy("c1", "c2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    classes = scratch.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    joined = components(_found(classes, scratch, threshold, block, exact), scratch)
    members = scratch.keep(classes.select("node", "copies", "vec", "least").join(joined, "node"), "members")
    counts = _links_within(members.select("node", "component", "copies", "vec"), threshold, side)
    tops = members.groupBy("component").agg(F.min("least").alias("top"))
    named = members.select("node", "component").join(tops, "component").join(counts, "node", "left")
    judged = classes.select("c1", "c2", "least", "copies", "node").join(named, "node", "left")
    judged = judged.select("c1", "c2", F.coalesce("top", "least").alias("c"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    judged = scratch.keep(judged, "judged")
    out = rows.select("vec_id", "fit", "c1", "c2").join(judged, ["c1", "c2"], "left")
    component = F.when(F.col("fit"), F.col("c")).otherwise(F.col("vec_id")).alias("component_id")
    n_links = F.when(F.col("fit"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("n_links")
    return out.select("vec_id", n_links, component).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
