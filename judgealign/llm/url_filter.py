"""URL rules as a sorted range join: one sweep per canonical host with a stack of active nested rules.

A rule is a host and a path prefix. Host labels are reversed (``example.com`` becomes ``com.example``), so a rule's
host covers an interval of canonical hosts, and its path an interval of paths. Every distinct URL is dealt to the
canonical hosts above it (of as many labels as the deepest rule at most) that carry rules; there its path is swept, in order, together with the starts of the rule
intervals. Intervals of prefixes are nested or disjoint, so the rules that hold at a path are the stack of the last
started rule: this stack is prepared per rule, carried along the order by a window, and cut by the prefixes that
have already ended. The longest rule over all hosts wins.

A hot host is split: its URLs are dealt to ``splits`` sweeps and only its rules are repeated there. Nothing is
broadcast by hand, no URL is compared with all rules.

Defined results: a null URL or one without ``://`` has empty host and path and meets no rule; repeated URLs are
judged once and joined back; rules with null parts never fit, a repeated rule counts once, with ``allow`` before
``block``; of two rules of equal length the one with the longer host wins; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """The part from the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """The part after the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Labels from the top-level domain down: ``m.example.com`` becomes ``com.example.m``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def canonical_hosts(host: Column, deepest: Column) -> Column:
    """The reversed host and the reversed hosts above it, of ``deepest`` labels at most."""
    labels = F.reverse(F.split(host, r"\."))
    # the labels are bound once, and a host of very many labels has no more entries than the deepest rule has labels
    few = F.transform(F.array(F.slice(labels, F.lit(1), F.greatest(deepest, F.lit(0)))), lambda top: F.transform(top, lambda _, n: F.array_join(F.slice(top, F.lit(1), n + 1), ".")))
    return F.get(few, F.lit(0))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """Per rule its canonical host and the stack of rules whose path interval holds its own, itself included."""
    clean = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull())
        .groupBy(F.translate("host", UPPER, UPPER.lower()).alias("host"), "path")
        .agg(F.min("verdict").alias("verdict"))
        .select(reversed_host(F.col("host")).alias("canon"), "path", "verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_len"))
    )
    above = clean.select("canon", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("prefix"))
    holders = clean.select("canon", F.col("path").alias("prefix"), F.struct(F.length("rule").alias("length"), "host_len", "rule", "verdict", "path").alias("entry"))
    return above.join(holders, ["canon", "prefix"]).groupBy("canon", "path").agg(F.sort_array(F.collect_list("entry"), asc=False).alias("stack"))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", splits: int | None = None) -> DataFrame:
    """All columns of ``pages`` plus ``host``, ``path``, ``rule`` and ``verdict`` (earlier columns of these names go)."""
    splits = splits or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stacks = rule_stacks(rules)
    urls = pages.select(F.col("url").alias("u")).filter(F.col("u").contains("://")).distinct()
    deepest = F.coalesce(stacks.agg(F.max(F.size(F.split("canon", r"\.")))).scalar(), F.lit(0))
    urls = urls.withColumn("deepest", deepest)
    places = urls.select("u", path_of(F.col("u")).alias("path"), F.explode(canonical_hosts(host_of(F.col("u")), F.col("deepest"))).alias("canon"))
    ruled = places.join(stacks.select("canon").distinct(), "canon", "left_semi")
    starts = stacks.select("canon", "path", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), F.lit(None).cast("string").alias("u"), "stack")
    stops = ruled.select("canon", "path", F.pmod(F.xxhash64("u"), F.lit(splits)).cast("int").alias("part"), "u", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    sweep = Window.partitionBy("canon", "part").orderBy(F.col("path"), F.col("u").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = starts.union(stops).select("u", "path", F.last("stack", ignorenulls=True).over(sweep).alias("open")).filter(F.col("u").isNotNull())
    fits = swept.select("u", F.get(F.filter("open", lambda e: F.col("path").startswith(e["path"])), F.lit(0)).alias("entry")).filter(F.col("entry").isNotNull())
    best = fits.groupBy("u").agg(F.max("entry").alias("entry"))
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    page = pages.select(F.struct(*kept).alias("row"), F.col("url").alias("page_url"))
    return page.join(best, page["page_url"] == best["u"], "left").select(
        "row.*",
        host_of(F.col("page_url")).alias("host"),
        path_of(F.col("page_url")).alias("path"),
        F.col("entry.rule").alias("rule"),
        F.coalesce(F.col("entry.verdict"), F.lit(default)).alias("verdict"),
    )
