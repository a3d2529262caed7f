"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next one.

1. quality classifier: documents that score below the threshold go;
2. line dedup: lines of 10 documents and more stay in the first one only; documents left without words go;
3. MinHash near-dedup: one document of each group stays (five-word shingles, similarity of 0.8);
4. mixing: sources reach their target weights, documents are taken up to three times;
5. BPE: token ids of every document, with digests of the ids and of the text decoded from them.

Stages 1 to 4 return the columns of their input. Nothing is cached; a lost executor repeats tasks of one stage.
SQL cannot express stages 1, 3, 4 and 5, so there is no SQL twin; ``tests/llm`` checks every stage on its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgealign.llm import bpe, line_dedup, minhash, mix_cube, quality_pu
from judgealign.llm.q_corpus import tokenizer_path
from judgealign.llm.store import Scratch

MIN_DOCS = 10


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_pu.keep_good(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds and that stand in many."""
    bitmaps = line_dedup.line_bitmaps(docs, min_docs=MIN_DOCS, keep="first")
    return line_dedup.apply_bitmaps(docs, bitmaps).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_cube.apply_mix(docs, mix_cube.mix_sources(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids per document."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
