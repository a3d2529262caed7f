"""Line dedup: range-partitioned line hashes, sorted by document and position, give keep bitmaps.

The occurrences of line keys are dealt by ranges of (hash, document) and sorted; a stream over each part reads
the runs of a hash and emits one row per run: how many documents it has there and the first of them. A common
line may run over several parts, as the range is cut by document too, so no task gets all of its rows; the runs
of one hash are then added up. Documents receive compressed bitmaps, the text itself is joined only by
:func:`apply_bitmaps`.

Defined results: a null or empty text is one empty line; empty keys are never dropped; rows that repeat id and
text are two documents for the counts and get the same bitmap; a null ``doc_id`` is an id like any other; an
empty table gives empty tables; other columns of the input are passed through.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgealign.llm.blocks import SPACE, table
from judgealign.llm.store import Scratch, keyed, same_doc
from judgealign.session import ship_with_tasks

ship_with_tasks(__name__)

OCCURRENCE = "h1 long, h2 long, doc_id long, tk long, n_lines int, at array<int>"
_OCCURRENCE = pa.schema(
    [("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("tk", pa.int64()), ("n_lines", pa.int32()), ("at", pa.list_(pa.int32()))]
)
RUN = "h1 long, h2 long, n_docs long, doc_id long, tk long"
_RUN = pa.schema([(n, pa.int64()) for n in ("h1", "h2", "n_docs", "doc_id", "tk")])


def line_key(line: bytes) -> bytes:
    """A line without outer white space, A-Z in lower case."""
    return line.strip(SPACE).lower()


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids, tks, counts, places = [], [], [], [], []
            for doc_id, tk, body in zip(batch.column("doc_id").to_pylist(), batch.column("tk").to_pylist(), batch.column("body"), strict=True):
                lines = body.as_py().split(b"\n")
                seen: dict[bytes, list[int]] = {}
                for at, line in enumerate(lines):
                    seen.setdefault(line_key(line), []).append(at)
                for key, at in seen.items():
                    if key and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        ids.append(doc_id)
                        tks.append(tk)
                        counts.append(len(lines))
                        places.append(at)
            hashes = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield table(_OCCURRENCE, h1=hashes[:, 0], h2=hashes[:, 1], doc_id=ids, tk=tks, n_lines=counts, at=places)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of a hash: the stream keeps only the open run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        n_docs = np.diff(np.r_[first, len(h1)])
        yield table(_RUN, h1=h1[first], h2=h2[first], n_docs=n_docs, doc_id=batch.column("doc_id").take(pa.array(first)), tk=batch.column("tk").take(pa.array(first)))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for n_lines, at in zip(batch.column("n_lines").to_pylist(), batch.column("at").to_pylist(), strict=True):
            keep = np.ones(n_lines, np.uint8)
            keep[at] = 0
            packed.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tk"), batch.column("n_lines"), pa.array(packed, pa.binary())], names=["doc_id", "tk", "n_lines", "keep"]
        )


def line_bitmaps(docs: DataFrame, min_docs: int = 2, keep: str = "first", min_chars: int = 1, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, tk, n_lines, keep)`` for every document that loses a line; ``keep`` holds a zlib-packed bit per line.

    A line whose key stands in at least ``min_docs`` documents goes: everywhere with ``keep="none"``, in all but the
    first document (by id) with ``keep="first"``.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "lines")
    occurrences = scratch.keep(keyed(docs).mapInArrow(_occurrences(min_chars), OCCURRENCE), "occurrences")
    order = ["h1", "h2", "doc_id", "tk"]
    runs = occurrences.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_runs, RUN)
    common = (
        runs.groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("n_docs"), F.min(F.struct("doc_id", "tk")).alias("first"))
        .filter(F.col("n_docs") >= min_docs)
    )
    common = scratch.keep(common, "common")
    gone = occurrences.join(common, ["h1", "h2"])
    if keep == "first":
        gone = gone.filter(~(F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.tk") == F.col("tk"))))
    places = gone.groupBy("doc_id", "tk").agg(F.first("n_lines").alias("n_lines"), F.flatten(F.collect_list("at")).alias("at"))
    return places.mapInArrow(_bitmaps, "doc_id long, tk long, n_lines int, keep binary")


def split_kept(body: bytes, packed: bytes | None) -> tuple[int, list[bytes]]:
    """The number of lines and the kept lines of a text."""
    lines = body.split(b"\n")
    if packed is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=len(lines))
    return len(lines), [line for line, bit in zip(lines, bits, strict=True) if bit]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, digests = [], [], []
        for body, packed in zip(batch.column("body"), batch.column("keep"), strict=True):
            n_lines, lines = split_kept(body.as_py(), packed.as_py())
            total.append(n_lines)
            gone.append(n_lines - len(lines))
            digests.append(hashlib.sha256(b"\n".join(lines)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def kept_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Per document the line counts and the SHA-256 of what stays."""
    whole = keyed(docs)
    joined = whole.join(bitmaps, same_doc(whole, bitmaps), "left").select(whole["doc_id"], whole["body"], bitmaps["keep"])
    return joined.mapInArrow(_digests, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _cut(texts: pa.Array, keeps: pa.Array) -> pa.Array:
    """Texts (as bytes) without the lines that their bitmaps drop; null without a bitmap."""
    return pa.array([b"\n".join(split_kept(t.as_py(), k.as_py())[1]) if k.is_valid else None for t, k in zip(texts, keeps, strict=True)], pa.binary())


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The input rows with all their columns, their texts without the dropped lines (and ``n_chars`` counted anew)."""
    cut = F.arrow_udf(_cut, "binary")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tk"))
    joined = whole.join(bitmaps, same_doc(whole, bitmaps), "left").select(whole["row"], bitmaps["keep"])
    # only texts that change go to Python
    body = F.when(F.col("keep").isNotNull(), F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    text = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(cut(body, F.col("keep")).cast("string"))
    joined = joined.withColumn("new_text", text)
    columns = [
        F.col("new_text").alias(c) if c == "text" else F.when(F.col("keep").isNull(), F.col("row.n_chars")).otherwise(F.length("new_text")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"row.`{c}`")
        for c in docs.columns
    ]
    return joined.select(*columns)

