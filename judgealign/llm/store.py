"""Written intermediate tables in the shared folder, and keys that identify a document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.session import shared_dir


#: Bytes of an Arrow batch in written steps.
BATCH_SETTING, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "16m"


class Scratch:
    """A folder of written tables below ``spark.checkpoint.dir``; a written table cuts the lineage.

    A lost executor costs only the running job: finished tables are read again from the shared folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, shared_dir(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return the frame that reads it.

        While it is written, batches for Python functions stay below ``BATCH``, so two tasks of an executor share little
        memory with the JVM beside them.
        """
        schema, conf = df.schema, self.spark.conf
        before = conf.get(BATCH_SETTING)
        conf.set(BATCH_SETTING, BATCH)
        try:
            df.write.parquet(f"{self.root}/{name}")
        finally:
            conf.set(BATCH_SETTING, before)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def put(self, name: str, data: bytes) -> str:
        """Write a small file and return its path."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        stream.write(data)
        stream.close()
        return path.toString()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """``doc_id`` and ``tk``, a hash of the text: together the identity of a document row, and the text as bytes.

    Rows that repeat both are the same document text under the same id, so they share every verdict.
    """
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("tk"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("body"),
        *more,
    )


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    """The join condition on the identity of a document row; a null id is equal to itself."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tk"] == right["tk"])
