"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from judgealign.llm.store import Scratch


def _linked(pairs: DataFrame, least: DataFrame, kept) -> DataFrame:
    """Link the neighbours that ``kept`` names to the least node around their centre."""
    return pairs.join(least, "u").filter(kept).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def components(links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """``node, component`` (the least node id) for every node of ``links`` (columns ``u`` and ``v``, any order).

    Each round links nodes to the least node around them, by an aggregate and a join, so a centre with very many
    links is summed before the shuffle and its join can be split. Rounds are written; the loop ends when a round
    changes nothing, which the writing job itself observes, after a logarithmic number of rounds in practice.
    """
    first = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    stars, mark = _kept(first, scratch, f"{name}0")
    step = 0
    while True:
        step += 1
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = scratch.keep(least, f"{name}{step}least")  # a written side lets Spark split the join of a hot centre
        large = _linked(both, least, F.col("v") > F.col("u")).distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = _linked(low, least, F.lit(True)).union(least.select("u", F.col("m").alias("v"))).distinct()
        after, now = _kept(small, scratch, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}", f"{name}{step}least")
        stars = after
        if now == mark:
            break
        mark = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _kept(stars: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, dict]:
    """The written links, and their number and sum of hashes as seen while writing."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    table = scratch.keep(stars.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")), name)
    return table, seen.get
