"""Incremental evaluation: judge only new items, keep every result once, resume after a stop.

The output table is the record of what is done. A batch is reduced to one row per key and compared with the stored keys
*before* it is evaluated, so a key with a stored result never reaches the judge again, whether it comes in the same
batch, a later one, a replay of the stream or a batch run over the same output. Batch and stream share one writer.

Running agreement is kept in additive tables (moments, cells of equal pairs, class counts), one per batch, which are
folded into one from time to time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from judgealign.operators.kendall import kendall
from judgealign.operators.moments import merge_moments, metrics, moments, with_overall
from judgealign.operators.ranks import Compressed, auc_of, class_counts, count_pairs, spearman
from judgealign.schemas import OVERALL
from judgealign.sources import sinks

#: Hash parts of an output and the column that holds them: a batch reads only the parts it touches.
PARTS, PART = 64, "_key_part"

Evaluate = Callable[[DataFrame], DataFrame]


@dataclass
class Counts:
    """Rows that a batch brought, and rows that went on to the judge."""

    arrived: int
    judged: int


def _found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, names only."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [f.getPath().getName() for f in found or []]


def _part(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(PARTS)).cast("int")


def _one_per_key(batch: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """Of several rows with one key the least by ``order`` (default: by the whole row as text), so a replay takes the same."""
    row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
    rank = F.struct(*([F.col(c) for c in order] if order else []), F.to_json(row))
    return batch.groupBy(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, rank).alias("_r")).select("_r.*")


def _without(rows: DataFrame, path: str, keys: list[str], parts: list[int]) -> DataFrame:
    """The rows whose key has no stored result in the given parts of the output."""
    if not parts:
        return rows
    found = rows.sparkSession.read.parquet(path).where(F.col(PART).isin(parts))
    done = found.select(*[F.col(f"`{k}`").alias(f"_d{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(Column.__and__, [F.col(f"`{k}`").eqNullSafe(F.col(f"_d{i}")) for i, k in enumerate(keys)])
    return rows.join(done, same, "left_anti")


def append_new(
    batch: DataFrame, path: str, key: str | list[str] = "item_id", order: list[str] | None = None, evaluate: Evaluate | None = None
) -> Counts:
    """Evaluate and append the rows whose key is not stored yet.

    ``evaluate`` sees one row per new key, once, in the job that writes; its result must hold the key columns and may
    have any number of rows per key. Without it the rows themselves are stored. The output is partitioned by a hash
    of the key and gets one file per part that the batch touches. A null key is a key.

    What is new is told from the key columns alone, and only stored parts that the batch touches are read; a batch
    without a new key writes nothing. A lost executor repeats the calls of its tasks only. A run that stops before its
    write commits leaves nothing.
    """
    keys = [key] if isinstance(key, str) else key
    each = batch.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    per_part = each.groupBy(_part(keys).alias(PART)).agg(F.count(F.lit(1)), F.sum("_n")).collect()  # at most PARTS rows
    arrived, judged = sum(r[2] for r in per_part), sum(r[1] for r in per_part)
    there = {int(name.split("=")[1]) for name in _found(batch.sparkSession, f"{path}/{PART}=[0-9]*")}
    parts = sorted(there & {r[0] for r in per_part})
    if parts:
        judged = _without(batch.select(*[F.col(f"`{k}`") for k in keys]).distinct(), path, keys, parts).count()
    if judged:
        fresh = _without(_one_per_key(batch, keys, order), path, keys, parts)
        results = evaluate(fresh) if evaluate else fresh
        results.withColumn(PART, _part(keys)).repartition(PART).write.mode("append").partitionBy(PART).parquet(path)
    return Counts(arrived, judged)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of an incremental output; an empty frame where nothing has arrived yet."""
    if not _found(spark, f"{path}/{PART}=*"):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).drop(PART).select(*schema.names)


def evaluate_pending(items: DataFrame, path: str, evaluate: Evaluate, key: str | list[str] = "item_id") -> Counts:
    """Batch form: evaluate the items without a stored result and append the results."""
    return append_new(items, path, key, evaluate=evaluate)


def stream_rows(
    spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "json", files: int = 100, glob: str | None = None
) -> DataFrame:
    """Stream over arriving files of a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(directory)


def _each_batch(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``step`` on every batch of what has arrived, then stop."""
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_increment(
    stream: DataFrame, out: str, checkpoint: str, evaluate: Evaluate, key: str | list[str] = "item_id", across_batches: bool = True,
    on_batch: Callable[[int, Counts], None] | None = None,
) -> StreamingQuery:
    """Evaluate everything that has arrived and not been evaluated, then stop.

    ``across_batches`` compares each batch with the keys of the whole output. Where a key is known to arrive only
    once, ``False`` saves that read: a batch then replaces its own folder, so only replays are guarded against.
    ``on_batch`` is told the counts of every batch after its write.
    """
    keys = [key] if isinstance(key, str) else key

    def step(batch: DataFrame, number: int) -> None:
        if across_batches:
            counts = append_new(batch, out, keys, evaluate=evaluate)
            if on_batch:
                on_batch(number, counts)
        else:
            evaluate(_one_per_key(batch, keys, None)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return _each_batch(stream, checkpoint, step)


def run_epochs(stream: DataFrame, out: str, checkpoint: str, evaluate: Evaluate) -> StreamingQuery:
    """Evaluate everything that has arrived, a batch being an epoch of the output (see :func:`sinks.write_epoch`), then stop."""
    return _each_batch(stream, checkpoint, lambda batch, number: sinks.write_epoch(evaluate(batch), out, number))


# ---- running agreement -----------------------------------------------------------------------------------------------


def live_table(spark: SparkSession, out: str) -> DataFrame:
    """The rows of a running table: the newest whole fold, and the batches after it.

    A fold counts once it is committed (its ``_SUCCESS`` is there); what it holds is read from nowhere else, so a stop
    between the write of a fold and the removal of older folders counts nothing twice.
    """
    upto = _last_fold(spark, out)
    batches = sorted(n for n in (int(f.split("=")[1]) for f in _found(spark, f"{out}/batch=*")) if n > upto)
    tables = [f"{out}/fold={upto}"] * (upto >= 0) + [f"{out}/batch={n}" for n in batches]
    if not tables:
        raise FileNotFoundError(f"no batch has arrived in {out}")
    return spark.read.parquet(*tables)


def _last_fold(spark: SparkSession, out: str) -> int:
    folds = [int(f.split("=")[1]) for f in _found(spark, f"{out}/fold=*")]
    return max((n for n in folds if _found(spark, f"{out}/fold={n}/_SUCCESS")), default=-1)


def fold_batches(spark: SparkSession, out: str, merge: Evaluate) -> None:
    """Fold all batches into one table of the last batch's number and remove what it replaces."""
    batches = [int(f.split("=")[1]) for f in _found(spark, f"{out}/batch=*")]
    last = _last_fold(spark, out)
    if not batches or max(batches) <= last:
        return
    upto = max(batches)
    merge(live_table(spark, out)).write.mode("overwrite").parquet(f"{out}/fold={upto}")
    old = [f"batch={n}" for n in batches] + [f for f in _found(spark, f"{out}/fold=*") if f != f"fold={upto}"]
    for name in old:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run_table(stream: DataFrame, out: str, checkpoint: str, summarise: Evaluate, merge: Evaluate, fold_every: int = 50) -> StreamingQuery:
    """Keep an additive table over arriving rows.

    Each batch writes ``summarise(batch)`` under its number, replacing what a replay wrote before. Every ``fold_every``
    batches the table is folded by ``merge``; a replay of a folded batch is not counted again, as the fold holds it.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        if number > _last_fold(spark, out):
            summarise(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if (number + 1) % fold_every == 0:
            fold_batches(spark, out, merge)

    return _each_batch(stream, checkpoint, step)


def run_moments(stream_pairs: DataFrame, out: str, checkpoint: str, keys: list[str], fold_every: int = 50) -> StreamingQuery:
    """Keep moments per group of arriving pairs; :func:`running_metrics` reads them. State is a row per group and batch."""
    return run_table(stream_pairs, out, checkpoint, lambda b: moments(b, keys), lambda t: merge_moments(t, keys), fold_every)


def running_metrics(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Agreement so far, per group and pooled, from the stored sums."""
    return metrics(with_overall(merge_moments(live_table(spark, out), keys), keys))


def _added(keys: list[str], measures: list[str]) -> Evaluate:
    return lambda table: table.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def run_pairs(stream_pairs: DataFrame, out: str, checkpoint: str, keys: list[str], fold_every: int = 50) -> StreamingQuery:
    """Keep ``(keys, x, y, n)``, the equal pairs that have arrived and their number, for metrics of any kind.

    On a rating scale that is a bounded number of rows however long the stream runs; else a row per different pair.
    """
    return run_table(stream_pairs, out, checkpoint, lambda b: count_pairs(b, keys, overall=False).df, _added([*keys, "x", "y"], ["n"]), fold_every)


def running_pairs(spark: SparkSession, out: str, keys: list[str], overall: bool = True, bounded: bool = False) -> Compressed:
    """The cells of all pairs so far; with ``overall`` also those of all dimensions pooled."""
    table = live_table(spark, out)
    if overall:
        others = [k for k in keys if k != "dim"]
        table = table.select(*others, F.explode(F.array("dim", F.lit(OVERALL))).alias("dim"), "x", "y", "n")
    return Compressed(_added([*keys, "x", "y"], ["n"])(table), bounded)


def running_agreement(spark: SparkSession, out: str, keys: list[str], bounded: bool = False) -> DataFrame:
    """Errors, Pearson, Spearman and Kendall so far, per group and pooled, from the cells of :func:`run_pairs`."""
    cells = running_pairs(spark, out, keys, True, bounded)
    pairs = cells.df.select(*keys, F.col("x").alias("pred"), F.col("y").alias("truth"), "n")
    sums = metrics(moments(pairs, keys, weight="n"))
    rho = spearman(cells, keys).select(*keys, "spearman")
    tau = kendall(cells, keys).select(*keys, "kendall")
    return sums.join(rho, keys, "left").join(tau, keys, "left")


def run_classes(stream_scored: DataFrame, out: str, checkpoint: str, keys: list[str], fold_every: int = 50) -> StreamingQuery:
    """Keep positives and negatives per score value of arriving rows ``(keys, score, label)``."""
    return run_table(stream_scored, out, checkpoint, lambda b: class_counts(b, keys).df, _added([*keys, "v"], ["n1", "n0"]), fold_every)


def running_auc(spark: SparkSession, out: str, keys: list[str], bounded: bool = False) -> DataFrame:
    """ROC AUC so far per group."""
    return auc_of(Compressed(_added([*keys, "v"], ["n1", "n0"])(live_table(spark, out)), bounded), keys)


def moments_table(stream_pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Streaming aggregate with the same sums, for update or complete output modes."""
    return moments(stream_pairs, keys)


def compact(spark: SparkSession, out: str, target: str, keys: list[str]) -> None:
    """Write the folded sums of :func:`run_moments` to a table of their own."""
    merge_moments(live_table(spark, out), keys).coalesce(1).write.mode("overwrite").parquet(target)


__all__ = [
    "Counts", "append_new", "compact", "evaluate_pending", "fold_batches", "live_table", "moments_table", "run_classes", "run_epochs", "run_increment",
    "run_moments", "run_pairs", "run_table", "running_agreement", "running_auc", "running_metrics", "running_pairs", "stored", "stream_rows",
]
