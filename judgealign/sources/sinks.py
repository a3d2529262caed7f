"""Writers. Large tables are written in parallel; only metric reports are gathered to one small file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MODES = {"error": "errorifexists", "skip": "ignore", "force": "overwrite", "append": "append"}


def write_results(df: DataFrame, path: str, fmt: str = "json", if_exists: str = "append", by: str | None = None) -> None:
    """Judge results or rows as JSON lines or parquet; ``if_exists``: error, skip, force, append."""
    writer = df.write.mode(_MODES[if_exists])
    if by:
        writer = writer.partitionBy(by)
    writer.format(fmt).save(path)


def write_csv(df: DataFrame, path: str, if_exists: str = "force", single_file: bool = False) -> None:
    """CSV with a header line. ``single_file`` is for summaries of a few rows."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(_MODES[if_exists]).option("header", True).csv(path)


def nested_report(metrics: DataFrame, consistency: DataFrame | None = None, dim: str = "dim", overall: str = "OVERALL") -> DataFrame:
    """Metric rows as one JSON text ``{overall, dimensions{...}, trial_consistency}``. Input is a few metric rows."""
    values = [c for c in metrics.columns if c != dim]
    row = F.to_json(F.struct(*values))
    quoted = F.concat(F.lit('"'), F.col(dim), F.lit('":'), row)
    body = metrics.agg(
        F.max(F.when(F.col(dim) == overall, row)).alias("o"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col(dim) != overall, quoted))), ",").alias("d"),
    )
    tail = F.lit("")
    if consistency is not None:
        body = body.select("o", "d", consistency.select(F.to_json(F.struct(*consistency.columns))).scalar().alias("c"))
        tail = F.concat(F.lit(',"trial_consistency":'), F.col("c"))
    return body.select(
        F.concat(
            F.lit('{"overall":'), F.coalesce("o", F.lit("null")), F.lit(',"dimensions":{'), F.col("d"), F.lit("}"), tail, F.lit("}")
        ).alias("value")
    )


def write_report(report: DataFrame, path: str, if_exists: str = "force") -> None:
    """One JSON text file from :func:`nested_report`."""
    report.coalesce(1).write.mode(_MODES[if_exists]).text(path)


def write_variations(variations: DataFrame, path: str, if_exists: str = "force") -> DataFrame:
    """Prompt variations as JSON lines; returns their metadata row (count and date), counted while writing.

    Where nothing is written (``skip`` of an existing folder), the given rows are counted.
    """
    seen = Observation()
    variations.observe(seen, F.count(F.lit(1)).alias("total")).write.mode(_MODES[if_exists]).json(path)
    if if_exists == "skip":
        return variations.agg(F.count("*").alias("total_variations"), F.current_date().alias("generation_date"))
    one = variations.sparkSession.range(1)
    return one.select(F.lit(seen.get["total"]).cast("bigint").alias("total_variations"), F.current_date().alias("generation_date"))


def write_bucketed(df: DataFrame, table: str, path: str, keys: str | list[str], buckets: int | None = None) -> DataFrame:
    """Rows as a table that is bucketed and sorted by its keys; returns the table.

    A truth table that many runs are held against is written like this once. A join or an aggregate on the keys
    reads the buckets as they are, so only the side of the new results is shuffled, if its shuffle has as many
    partitions (default: the session's). One task writes one bucket.
    """
    keys = [keys] if isinstance(keys, str) else keys
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
    dealt.option("path", path).mode("overwrite").saveAsTable(table)
    return spark.table(table)


# ---- results by epoch ------------------------------------------------------------------------------------------------

_COMMIT = "epoch long, attempt string, place long"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit records so far; none where nothing is committed."""
    return spark.read.schema(_COMMIT).option("pathGlobFilter", "part-*").json(_made(spark, f"{path}/commits"))


def _made(spark: SparkSession, folder: str) -> str:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return folder


def stage_epoch(df: DataFrame, path: str, epoch: int) -> str:
    """Write the rows of an epoch where no reader looks yet; returns the name of this attempt."""
    attempt = f"a{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/rows/epoch={epoch}/attempt={attempt}")
    return attempt


def commit_epoch(spark: SparkSession, path: str, epoch: int, attempt: str) -> None:
    """Make an attempt the content of its epoch: one record of one file, which is there as a whole or not at all."""
    place = _commits(spark, path).where(F.col("epoch") == epoch).count()
    record = spark.range(1).select(F.lit(epoch).cast("long").alias("epoch"), F.lit(attempt).alias("attempt"), F.lit(place).cast("long").alias("place"))
    record.coalesce(1).write.mode("append").json(f"{path}/commits")


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """Rows of an epoch (the batch number of a stream, or of a rerun job), which replace what the epoch held before.

    The rows go to a folder of their own, then a record says that it is the epoch's. Readers see the attempt that was
    recorded last, so a run that stops between the two leaves nothing that counts, a replay leaves no second copy, and an
    epoch is never seen half written or missing while it is replaced. One writer at a time per epoch, as in a stream.
    """
    commit_epoch(df.sparkSession, path, epoch, stage_epoch(df, path, epoch))


def _newest(spark: SparkSession, path: str) -> DataFrame:
    return _commits(spark, path).groupBy("epoch").agg(F.max_by("attempt", "place").alias("attempt"))


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed epochs, with ``epoch``; folders of other attempts are pruned, not read."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.withColumn("epoch", F.col("epoch").cast("long")).join(_newest(spark, path), ["epoch", "attempt"], "left_semi").drop("attempt")


def clear_attempts(spark: SparkSession, path: str) -> int:
    """Delete the folders of attempts that no record names any more and return their number.

    For times without a writer and without readers of older states. Only names of such folders reach the driver.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where = fs_path(f"{path}/rows/epoch=*/attempt=*")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [(int(f.getPath().getParent().getName()[6:]), f.getPath().getName()[8:]) for f in fs.globStatus(where) or []]
    if not there:
        return 0
    found = spark.createDataFrame(there, "epoch long, attempt string")
    stale = found.join(_newest(spark, path), ["epoch", "attempt"], "left_anti").collect()
    for r in stale:
        fs.delete(fs_path(f"{path}/rows/epoch={r['epoch']}/attempt={r['attempt']}"), True)
    return len(stale)
