"""Quality rules on host level: failures per host, shrunk by an empirical beta prior, decide on all its documents.

Each document is measured once, in the JVM, and its small row is written; host counts, the prior and the verdicts
come from these rows. The prior is fitted to the failure rates of all hosts by moments, so a host with few
documents is judged close to the mean and one with many by its own rate.

Defined results: null and empty texts have zero of everything and fail; null hosts form one host; repeated rows
count each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.llm.store import Scratch

#: White space of the contract and the symbols that it counts: fixed values.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, also where ``use`` reads it inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def windows_of(words: Column) -> Column:
    """A hash per three-word window, in order."""
    return F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    )


def covered(hashes: Column) -> Column:
    """Words in windows that stand twice or more: windows sorted by hash show their equals as neighbours."""

    def marked(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: (F.get(ordered, i - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
        )
        places = F.array_sort(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(places, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")))["n"]

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(bound(pairs, marked))


def measures(text: Column) -> dict[str, Column]:
    """The base measures of a text."""
    safe = F.coalesce(text, F.lit(""))
    full_lines = F.filter(F.split(safe, "\n"), lambda line: F.btrim(line, F.lit(SPACE)) != "")
    return {
        "n_words": F.size(words_of(text)).cast("long"),
        "word_chars": F.length(F.translate(safe, SPACE, "")).cast("long"),
        "n_symbols": (F.length(safe) - F.length(F.translate(safe, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(full_lines, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": bound(words_of(text), lambda words: bound(windows_of(words), covered)).cast("long"),
    }


def host_verdicts(measured: DataFrame, limit: float) -> DataFrame:
    """Per host its documents, failures, shrunk failure rate and whether it stays (rate at most ``limit``).

    With mean m and variance v of the hosts' rates, the prior has strength m(1-m)/v - 1; hosts that do not differ
    (or a single one) are all judged by the mean, which is a prior of one million documents here.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rates = hosts.agg(F.avg(F.col("failed") / F.col("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1e-6))).otherwise(F.lit(1e6))
    a, s = rates.select(F.col("m") * strength).scalar(), rates.select(strength).scalar()
    return hosts.select("host", "n", "failed", ((F.col("failed") + a) / (F.col("n") + s)).alias("rate")).withColumn("host_kept", F.col("rate") <= limit)


def judge_documents(docs: DataFrame, host: str = "source", limit: float = 0.5, scratch: Scratch | None = None) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, the host's ``rate`` and ``kept``."""
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    m = measures(F.col("text"))
    measured = docs.select("doc_id", F.col(host).alias("host"), *[m[n].alias(n) for n in names])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = scratch.keep(measured.withColumn("base_failed", failed), "measured")
    verdicts = host_verdicts(measured, limit).select(F.col("host").alias("judged"), "rate", "host_kept")
    joined = measured.join(verdicts, measured["host"].eqNullSafe(verdicts["judged"]))
    return joined.select("doc_id", *names, "base_failed", "rate", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
