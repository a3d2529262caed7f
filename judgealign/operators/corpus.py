"""Training rows from annotated items: prompt messages and a solution text.

Items hold a short rating list per dimension, so every builder is a projection of one row; only the builders
with prompt variations join a small table. All random choices are seeded (:mod:`judgealign.functions.picks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions import picks
from judgealign.operators import prompts as P
from judgealign.operators.fewshot import global_index
from judgealign.operators.prompts import Rubric


def pick_rating(ratings: Column, policy: str, seed: int, *keys) -> Column:
    """One rating at random as text.

    ``pick_one``: among the non-null ones, 1 where there is none, 1 for ``N/A``.
    ``pick_one_arche``: null counts as 1 before the choice, booleans become 0 and 1, ``N/A`` stays.
    """
    if policy == "pick_one":
        valid = F.filter(ratings, lambda r: r.isNotNull())
        chosen = picks.choose(valid, seed, "rating", *keys)
        return F.when(chosen == "N/A", "1").otherwise(F.coalesce(chosen, F.lit("1")))
    if policy == "pick_one_arche":
        chosen = picks.choose(F.transform(ratings, lambda r: F.coalesce(r, F.lit("1"))), seed, "rating", *keys)
        return F.coalesce(F.when(chosen == "true", "1").when(chosen == "false", "0").otherwise(chosen), F.lit("1"))
    raise ValueError(f"unknown policy {policy!r}")


def pick_dim(dims: list[str], seed: int, *keys) -> Column:
    return picks.choose(F.array(*[F.lit(d) for d in dims]), seed, "dim", *keys)


def answer(text: Column) -> Column:
    return F.concat(F.lit("<answer>"), text, F.lit("</answer>"))


def with_thought(caption: Column, solution: Column) -> Column:
    return F.concat(F.lit("<think>"), F.coalesce(caption, F.lit("N/A")), F.lit("</think>"), solution)


def _ratings_map(fields: dict[str, Column]) -> Column:
    return F.create_map(*[x for d, c in fields.items() for x in (F.lit(d), c)])


def _row(dim: Column, variation: Column, prompt: Column, solution: Column) -> Column:
    return F.struct(dim.alias("dim"), variation.alias("variation"), prompt.alias("prompt"), solution.alias("solution"))


def _null() -> Column:
    return F.lit(None).cast("string")


def _flat(items: DataFrame, key: str, row: Column, *names: str) -> DataFrame:
    return items.select(key, row.alias("_r")).select(key, *[F.col(f"_r.{n}").alias(n) for n in names])


def single_dimension_row(
    fields: dict[str, Column], rubric: Rubric, seed: int, user: Column, audio: Column, extra: str = "",
    caption: Column | None = None, policy: str = "pick_one", key: str = "item_id",
) -> Column:
    """One random dimension and one random rating (kinds ROLE, Arche; with ``extra`` and ``caption`` RoleCaption and
    RoleEmotion)."""
    k = F.col(key)
    dim = pick_dim(list(fields), seed, k)
    rating = pick_rating(_ratings_map(fields)[dim], policy, seed, k, dim)
    body = F.concat(P.rubric_lookup(dim, rubric, True), F.lit("\n\n"), user, F.lit(f"\n\n{extra}" if extra else ""))
    solution = answer(rating)
    if caption is not None:
        solution = with_thought(caption.cast("string"), solution)
    return _row(dim, _null(), P.user_message(audio, P.question_prompt(body)), solution)


def single_dimension(
    items: DataFrame, fields: dict[str, Column], rubric: Rubric, seed: int, user: Column, audio: Column,
    extra: str = "", caption: Column | None = None, policy: str = "pick_one", key: str = "item_id",
) -> DataFrame:
    """Rows of :func:`single_dimension_row`."""
    row = single_dimension_row(fields, rubric, seed, user, audio, extra, caption, policy, key)
    return _flat(items, key, row, "dim", "prompt", "solution")


def all_dimensions_row(
    fields: dict[str, Column], labels: dict[str, str], general: str, seed: int, user: Column, audio: Column,
    flexible: bool = False, consistent: bool = False, key: str = "item_id",
) -> Column:
    """All dimensions in one answer ``[Label]score...``.

    ``flexible`` permutes the dimensions per item. ``consistent`` takes one annotator position for all dimensions,
    drawn below the greatest number of non-null ratings but applied to the unfiltered lists.
    """
    k = F.col(key)
    dims = list(fields)
    order = F.array(*[F.lit(d) for d in dims])
    if flexible:
        order = picks.permute(order, seed, "order", k)
    sizes = [F.size(F.filter(c, lambda r: r.isNotNull())) for c in fields.values()]
    most = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    ratings = _ratings_map(fields)
    label = F.create_map(*[F.lit(x) for d in dims for x in (d, labels[d])])

    def text(at: Column) -> Column:
        def score(d: Column) -> Column:
            if not consistent:
                return pick_rating(ratings[d], "pick_one", seed, k, d)
            r = F.get(ratings[d], at)
            return F.when(r == "N/A", "1").otherwise(F.coalesce(r, F.lit("1")))

        return F.array_join(F.transform(order, lambda d: F.concat(F.lit("["), label[d], F.lit("]"), score(d))), "")

    # the position is drawn once per row: the lambda binds it
    drawn = F.coalesce(picks.below(most, seed, "annotator", k), F.lit(0)).cast("int")
    scores = F.get(F.transform(F.array(drawn), text), F.lit(0)) if consistent else text(F.lit(0))
    body = F.concat(user, F.lit(f"\n\n{general}"))
    return _row(_null(), _null(), P.user_message(audio, P.question_prompt(body)), answer(scores))


def all_dimensions(
    items: DataFrame, fields: dict[str, Column], labels: dict[str, str], general: str, seed: int, user: Column,
    audio: Column, flexible: bool = False, consistent: bool = False, key: str = "item_id",
) -> DataFrame:
    """Rows of :func:`all_dimensions_row`."""
    row = all_dimensions_row(fields, labels, general, seed, user, audio, flexible, consistent, key)
    return _flat(items, key, row, "prompt", "solution")


def join_variations(items: DataFrame, variations: DataFrame, seed: int, key: str = "item_id", how: str = "left") -> DataFrame:
    """Items with one random prompt variation each, in the column ``_variation``.

    ``variations`` has ``(id, dimension_name, prompt_text)``; with an empty table the column is NULL.
    """
    numbered = global_index(variations, F.substring(F.md5("id"), 1, 2), [F.md5("id"), "id"], "_v")
    numbered = numbered.select("_v", F.struct("id", "dimension_name", "prompt_text").alias("_variation"))
    size = variations.agg(F.count("*")).scalar()
    own = [F.col(f"`{c}`") for c in items.columns]
    drawn = items.select(*own, size.alias("_m")).withColumn("_v", picks.below(F.col("_m"), seed, "variation", F.col(key)))
    return drawn.join(numbered, "_v", how).select(*own, "_variation")


def variation_row(
    fields: dict[str, Column], seed: int, user: Column, audio: Column, extra: str = "", caption: Column | None = None,
    key: str = "item_id",
) -> Column:
    """The item's prompt variation (kinds RoleReasoning, RoleVariation; with ``extra`` and ``caption``
    RoleVariationCaption), over :func:`join_variations`."""
    v, k = F.col("_variation"), F.col(key)
    rating = pick_rating(_ratings_map(fields)[v["dimension_name"]], "pick_one", seed, k, v["dimension_name"])
    text = F.concat(v["prompt_text"], F.lit("\n\n"), user, F.lit(f"\n\n{extra}" if extra else ""), F.lit("\n\n"))
    solution = answer(rating)
    if caption is not None:
        solution = with_thought(caption.cast("string"), solution)
    return _row(v["dimension_name"], v["id"], P.user_message(audio, text), solution)


def with_variation(
    items: DataFrame, fields: dict[str, Column], variations: DataFrame, seed: int, user: Column, audio: Column,
    extra: str = "", caption: Column | None = None, key: str = "item_id",
) -> DataFrame:
    """Rows of :func:`variation_row`; no rows where there is no variation."""
    joined = join_variations(items, variations, seed, key, "inner")
    row = variation_row(fields, seed, user, audio, extra, caption, key)
    return _flat(joined, key, row, "dim", "variation", "prompt", "solution")


def multiple_choice_row() -> Column:
    """Multiple choice (kind AVQA) from ``question_text, multi_choice, answer, audio_path``."""
    prompt = P.user_message(F.col("audio_path"), P.choice_prompt(F.col("question_text"), F.col("multi_choice")))
    return _row(_null(), _null(), prompt, P.choice_solution(F.col("multi_choice"), F.col("answer")))


def multiple_choice(items: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows of :func:`multiple_choice_row`."""
    return _flat(items, key, multiple_choice_row(), "prompt", "solution")


def dispatch(items: DataFrame, kinds: dict[str, Column], default: str = "ROLE", key: str = "item_id") -> DataFrame:
    """Training rows of mixed items: the row expression of each item's ``dataset_name`` (NULL counts as ``default``).

    ``kinds`` maps names to the row expressions above; one projection evaluates the one that applies, so the items are
    read once. An item of an unknown kind stays, with a NULL prompt and solution. Returns ``(<key>, dataset_name, dim,
    variation, prompt, solution)``.
    """
    kind = F.coalesce(F.col("dataset_name"), F.lit(default))
    chosen = None
    for name, row in kinds.items():
        chosen = F.when(kind == name, row) if chosen is None else chosen.when(kind == name, row)
    rows = items.select(key, kind.alias("dataset_name"), chosen.alias("_r"))
    return rows.select(key, "dataset_name", "_r.dim", "_r.variation", "_r.prompt", "_r.solution")


def message_text(prompt: Column) -> Column:
    """The text part of a training row's user message."""
    return prompt[0]["content"][1]["text"]


def repeat_sampler(df: DataFrame, key: str, batch: int, repeats: int, copies: int, seed: int) -> DataFrame:
    """Seeded permutation in batches: the last partial batch is dropped, each batch comes ``repeats`` times and each
    row ``copies`` times in a row. Returns ``(position, <key>)``.

    The permutation is the order of a digest; its first four hex digits split the rows into even parts.
    """
    h = picks.digest(seed, "sampler", F.col(key))
    indexed = global_index(df.select(key, h.alias("_h")), F.substring("_h", 1, 4), ["_h", key], "_i")
    full = df.agg(F.floor(F.count("*") / batch).cast("bigint")).scalar()
    kept = indexed.where(F.floor(F.col("_i") / batch) < full)
    spread = kept.select(
        key, "_i",
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_r"),
    ).select(key, "_i", "_r", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_c"))
    chunk, slot = F.floor(F.col("_i") / batch), F.col("_i") % batch
    position = ((chunk * repeats + F.col("_r")) * batch + slot) * copies + F.col("_c")
    return spread.select(position.cast("bigint").alias("position"), key)
