"""Readers. Schemas are explicit and reading is permissive: a bad line is kept apart, good ones stay."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgealign import schemas
from judgealign.functions.keys import result_key, truth_key
from judgealign.functions.text import strict_json
from judgealign.operators.align import last_wins
from judgealign.sources.arrays import read_records

CORRUPT = "_corrupt_record"


def _file_name() -> Column:
    return F.col("_metadata.file_name")


def _decoded(name: Column) -> Column:
    """A file name as it is, from its form in a path."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Parsed lines in ``j`` (a bad line has its text in ``j._corrupt_record``), with the place of each line.

    The lines are read as text and parsed in the plan, so that a bad line is recognised whatever columns are used. Each is a
    list of one that is exploded: a filter on a plain column would go below it and parse every line once more.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(
        F.explode_outer(F.array(parsed)).alias("j"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        _file_name().alias("source_file"),
    )


def read_items(spark: SparkSession, path: str | list[str], rubric: str = "realism", dedupe: bool = True) -> DataFrame:
    """Annotated items keyed by ``item_id``. Of several lines with one key the last one wins.

    "Last" is file order: file path, then the start of the file block, then the row number in it. The row number
    inside a task grows in reading order, which is what ``monotonically_increasing_id`` gives.
    """
    schema = schemas.REALISM_ITEM if rubric == "realism" else schemas.ARCHETYPE_ITEM
    df = _json_lines(spark, path, schema).select("j.*", "_file", "_block", F.monotonically_increasing_id().alias("_row"))
    df = df.where(F.col(CORRUPT).isNull()).withColumn("item_id", truth_key(F.col("id")))
    if dedupe:
        df = last_wins(df, "item_id", ["_file", "_block", "_row"])
    return df.drop("_file", "_block", "_row", CORRUPT)


def read_results(
    spark: SparkSession, path: str | list[str], dims: list[str] | None = None, strict_keys: bool = False,
    path_column: str | None = None,
) -> DataFrame:
    """Judge results with ``item_id`` and ``source_file``; ``dims`` adds top-level score columns, ``path_column`` the path."""
    schema = schemas.judge_result_schema(dims) if dims else schemas.JUDGE_RESULT
    place = [F.col("_file").alias(path_column)] if path_column else []
    df = _json_lines(spark, path, schema).select("j.*", "source_file", *place)
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good.withColumn("item_id", result_key(F.col("audio_path"), F.col("id"), strict_keys))


def corrupt_lines(spark: SparkSession, path: str | list[str], schema: T.StructType = schemas.JUDGE_RESULT) -> DataFrame:
    """Number of unreadable lines per file."""
    df = _json_lines(spark, path, schema).select("source_file", f"j.{CORRUPT}")
    return df.groupBy("source_file").agg(F.count(CORRUPT).alias("bad_lines"), F.count("*").alias("lines"))


def _children(spark: SparkSession, directory: str) -> list[str]:
    """Names in a folder, from the file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    return sorted(s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


def read_trials(spark: SparkSession, directory: str, model: str, trials: int = 5, dims: list[str] | None = None,
                strict_keys: bool = False) -> DataFrame:
    """``<model>_trial<k>.jsonl`` files (or folders of part files) of a folder, k in 1..trials, with the trial number.

    At least one must exist.
    """
    base = directory.rstrip("/")
    name = re.compile(re.escape(model) + r"_trial(\d+)\.jsonl")
    found = [n for n in _children(spark, base) if (m := name.fullmatch(n)) and 1 <= int(m[1]) <= trials]
    if not found:
        raise FileNotFoundError(f"no trial 1..{trials} of {model} in {directory}")
    df = read_results(spark, [f"{base}/{_plain(n)}" for n in found], dims, strict_keys, path_column="_path")
    return df.withColumn("trial", F.regexp_extract("_path", r"_trial(\d+)\.jsonl", 1).cast("int")).drop("_path")


def _plain(name: str) -> str:
    """A file name without the meaning of glob characters."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", name)


def missing_trials(results: DataFrame, trials: int = 5) -> list[int]:
    """Trial numbers without a single row (a handful of integers)."""
    seen = {r[0] for r in results.select("trial").distinct().collect()}
    return [t for t in range(1, trials + 1) if t not in seen]


# ---- folders of JSON arrays ------------------------------------------------------------------------------


def read_folder(spark: SparkSession, directory: str, salvage: str = "boundary", pattern: str = "*.json", large: int | None = None) -> DataFrame:
    """A folder of JSON array files, one per dimension, with ``source_file``.

    A file of up to ``large`` bytes (default: what one task reads of a file) is streamed record by record in one task; larger
    ones are cut into records by many tasks, see :func:`~judgealign.sources.arrays.read_records`. Of a truncated file both
    ways keep what the ``salvage`` rule says. A record with a value of the wrong type has its other fields. Of a file that is
    broken in its middle the first way keeps nothing, the second loses the broken records.
    """
    if large is None:
        large = int(re.match(r"\d+", spark.conf.get("spark.sql.files.maxPartitionBytes"))[0])
    base = directory.rstrip("/")
    big = _larger(spark, base, pattern, large)
    parts = [_streamed_folder(spark, base, pattern, large if big else None, salvage)]
    parts += [_cut_folder(spark, big, salvage)] if big else []
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _larger(spark: SparkSession, base: str, pattern: str, large: int) -> list[str]:
    """Paths, without the meaning of glob characters, of the files of a folder that have more than ``large`` bytes.

    Spark lists the folder and leaves out the other files before any task runs; only names of large files reach the driver's Python.
    """
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(base)
    except AnalysisException as error:
        raise FileNotFoundError(base) from error
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"{base}/{pattern}")
    over = files.where(F.col("_metadata.file_size") > large).select("path").collect()
    return sorted(f"{head}/{_plain(name)}" for head, _, name in (r.path.rpartition("/") for r in over))


def _folder_fields() -> tuple[list[str], T.StructType]:
    names = [f.name for f in schemas.DIMENSION_RESULT.fields]
    return names, T.StructType([*schemas.DIMENSION_RESULT.fields, T.StructField(CORRUPT, T.StringType())])


def _streamed_folder(spark: SparkSession, base: str, pattern: str, most: int | None, salvage: str) -> DataFrame:
    """Records of the files of up to ``most`` bytes; the folder is listed as one path, however many files it has."""
    names, schema = _folder_fields()
    reader = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", CORRUPT)
    files = reader.option("pathGlobFilter", pattern).json(base)
    files = files if most is None else files.where(F.col("_metadata.file_size") <= most)
    rows = files.withColumn("source_file", _decoded(_file_name()))
    # a record with a value of the wrong type has its other fields; a file that ends early has none
    empty = F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNull()
    record = F.array(F.struct(*[F.col(f"`{n}`") for n in names]))
    cut = F.when(F.col(CORRUPT).isNotNull() & empty, _salvaged(F.col(CORRUPT), schemas.DIMENSION_RESULT, salvage)).otherwise(record)
    return rows.select("source_file", F.explode(cut).alias("_o")).select(*[F.col(f"_o.`{n}`") for n in names], "source_file")


def _cut_folder(spark: SparkSession, paths: list[str], salvage: str) -> DataFrame:
    names, schema = _folder_fields()
    parsed = F.from_json("record", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = read_records(spark, paths, salvage).select(parsed.alias("_o"), _decoded(F.element_at(F.split("file", "/"), -1)).alias("source_file"))
    empty = F.coalesce(*[F.col(f"_o.`{n}`").cast("string") for n in names]).isNull()
    good = rows.where(~(F.col(f"_o.{CORRUPT}").isNotNull() & empty))
    return good.select(*[F.col(f"_o.`{n}`") for n in names], "source_file")


def salvage_arrays(texts: DataFrame, text: str, schema: T.StructType, rule: str = "boundary") -> DataFrame:
    """Objects of JSON arrays, one row each, next to the other columns; truncated arrays are cut first.

    ``rule="last_comma"`` cuts at the last comma, closes the array and parses; a cut inside an object leaves
    nothing. ``rule="boundary"`` falls back to the last comma that follows a closing brace.
    """
    others = [c for c in texts.columns if c != text]
    names = [f.name for f in schema.fields]
    parsed = _salvaged(F.col(text), schema, rule)
    return texts.select(*others, F.explode(parsed).alias("_o")).select(*[F.col(f"_o.`{n}`") for n in names], *others)


def _salvaged(value: Column, schema: T.StructType, rule: str) -> Column:
    """The objects of an array text: the first cut that is valid JSON is parsed once with the schema."""
    cuts = [value, F.concat(F.regexp_extract(value, r"(?s)^(.*),", 1), F.lit("]"))]
    if rule == "boundary":
        cuts.append(F.concat(F.regexp_extract(value, r"(?s)^(.*\})\s*,", 1), F.lit("]")))
    elif rule != "last_comma":
        raise ValueError(f"unknown rule {rule!r}")
    # validity is tested on the whole text, as a typed parse would accept a broken tail
    valid = F.coalesce(*[F.when(strict_json(c).isNotNull(), c) for c in cuts])
    return F.from_json(valid, T.ArrayType(schema), {"mode": "PERMISSIVE"})


# ---- logs and checkpoints -----------------------------------------------------------------------------------

# ---- fixed values: accuracy-log line patterns -----------------------------------------------------------------
LOG_METRICS = {
    "sound": r"sound : (\S+)",
    "music": r"music : (\S+)",
    "speech": r"speech : (\S+)",
    "total_accuracy": r"Total Accuracy: (\S+)",
}
# -----------------------------------------------------------------------------------------------------------------


def parse_accuracy_lines(lines: DataFrame, key: str = "iter", text: str = "value") -> DataFrame:
    """One row per key with the logged accuracies as numbers."""
    def number(pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("double")

    return lines.groupBy(key).agg(*[F.max(number(p)).alias(m) for m, p in LOG_METRICS.items()])


def leaderboard(accuracies: DataFrame, key: str = "iter") -> DataFrame:
    """Runs by total accuracy, best first; compared as numbers, not as text."""
    return accuracies.orderBy(F.col("total_accuracy").desc_nulls_last(), key)


def read_accuracy_logs(spark: SparkSession, directory: str, name: str = "eval_mmau_mini.txt", mark: str = "test_") -> DataFrame:
    """``test_<iter>/eval_mmau_mini.txt`` logs (files or folders of parts) as one row per iteration, by one scan.

    ``mark`` and ``name`` are the parts of the path around the iteration; ``mark="test="`` and ``name="*"`` read a table that
    was written partitioned by a column ``test``.
    """
    lines = spark.read.text(f"{directory.rstrip('/')}/{mark}*/{name}")
    run = F.regexp_extract(F.col("_metadata.file_path"), ".*/" + re.escape(mark) + "([^/]*)/", 1)  # the innermost one
    return parse_accuracy_lines(lines.select(F.element_at(F.split(run, "_"), -1).alias("iter"), "value"))


def read_checkpoints(
    spark: SparkSession, directory: str, model: str | None = None, prompt_type: str | None = None
) -> DataFrame:
    """Checkpoint files, newest first, with processed count, duration and size."""
    df = spark.read.schema(schemas.CHECKPOINT).option("multiLine", True).json(f"{directory.rstrip('/')}/checkpoint_*.json")
    df = checkpoint_summary(
        df.withColumns(
            {
                "file": F.regexp_extract(F.col("_metadata.file_path"), r"/(checkpoint_[^/]*\.json)", 1),
                "size": F.col("_metadata.file_size"),
                "modified": F.col("_metadata.file_modification_time"),
            }
        )
    )
    if model:
        df = df.where(F.col("model_name") == model)
    if prompt_type:
        df = df.where(F.col("prompt_type") == prompt_type)
    return df.orderBy(F.desc("modified"), "file")


def checkpoint_summary(df: DataFrame) -> DataFrame:
    """Processed count, run time and the first three results of each checkpoint."""
    keep = [c for c in ("file", "size", "modified") if c in df.columns]
    return df.select(
        *keep,
        F.col("args")["model_name"].alias("model_name"),
        F.col("args")["prompt_type"].alias("prompt_type"),
        F.coalesce("total_processed", F.size("processed_indices").cast("bigint")).alias("processed"),
        F.timestamp_seconds("timestamp").alias("written_at"),
        (F.col("timestamp") - F.col("start_time")).alias("duration"),
        F.slice("results", 1, 3).alias("preview"),
    )


def older_than(df: DataFrame, days: int, column: str = "modified") -> DataFrame:
    """Rows older than a number of days."""
    return df.where(is_older(column, days))


def is_older(column: str, days: int) -> Column:
    return F.col(column) < F.current_timestamp() - F.make_interval(days=F.lit(days))


def latest_per(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """The newest row per key."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(order, tie)).alias("_r")).select("_r.*")


def read_rubric_table(spark: SparkSession, path: str) -> DataFrame:
    """Prompt texts: ``(rubric, dim, ord, version, text)`` with version ``simple`` or ``detailed``."""
    return spark.read.schema("rubric string, dim string, ord int, version string, text string").json(path)


def read_phrasings(spark: SparkSession, path: str) -> DataFrame:
    """Rubric phrasings: ``(dim, ord, variant, name, description, scale_1 .. scale_5)``, variant 0.. per dimension."""
    scales = ", ".join(f"scale_{i} string" for i in range(1, 6))
    return spark.read.schema(f"dim string, ord int, variant bigint, name string, description string, {scales}").json(path)


def read_variations(spark: SparkSession, path: str) -> DataFrame:
    """Prompt variations: ``(id, dimension_name, prompt_text)``."""
    return spark.read.schema("id string, dimension_name string, prompt_text string").json(path)


def read_mcq_items(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice items as JSON lines."""
    return spark.read.schema(schemas.MCQ_ITEM).json(path)
