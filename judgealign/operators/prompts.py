"""Rubric prompts as tables: user prompts, requests, message arrays, prompt variations.

Rubric texts are data: a small table ``(rubric, dim, version, text)`` that the caller reads from a file. Lists
of rubric dimensions, headers and phrasings are configuration of a few dozen entries; they are exploded from
array literals, so no cross join is planned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions import picks

# ---- fixed values: prompt formats -----------------------------------------------------------------------
USER_FORMAT = "Global Profile: %s, Local Scene: %s, Available Traits: %s"
ARCHETYPE_FORMAT = "Prompt’s role & scene: %s"
QUESTION_FORMAT = "Please evaluate the audio based on the following criteria:\n\n%s\n\nOutput the answer in <answer> </answer>."
CHOICE_FORMAT = "%s Please choose the answer from the following options: %s. Output the final answer in <answer> </answer>."
# row layouts of generated prompt texts: (dimension heading, name separator, example line), numbered row, cell, simple row
VARIATION_LAYOUT = ("Dimension: ", " — ", "Example output: ")
NUMBERED_ROW = "### %s. %s  \n"
CELL = "|%s|%s|\n"
SIMPLE_ROW = "• %s  %s  \n"
# -----------------------------------------------------------------------------------------------------------

# a rubric is configuration: more rows than this are a mistake
RUBRIC_ROWS = 10_000


@dataclass(frozen=True)
class Rubric:
    """Prompt texts of one rubric: per dimension a simple and maybe a detailed one."""

    simple: dict[str, str]
    detailed: dict[str, str]

    def text(self, dim: str, detailed: bool) -> str:
        """The detailed text where wanted and present, else the simple one, else ''."""
        if detailed and dim in self.detailed:
            return self.detailed[dim]
        return self.simple.get(dim, "")

    @property
    def dims(self) -> list[str]:
        return list(self.simple)


def rubric_from_table(table: DataFrame, rubric: str) -> Rubric:
    """Rubric texts from their table (a few dozen rows of configuration, at most ``RUBRIC_ROWS``)."""
    rows = table.where(F.col("rubric") == rubric).orderBy("ord").limit(RUBRIC_ROWS + 1).collect()
    if len(rows) > RUBRIC_ROWS:
        raise ValueError(f"the rubric {rubric!r} has more than {RUBRIC_ROWS} rows")
    return Rubric(
        {r["dim"]: r["text"] for r in rows if r["version"] == "simple"},
        {r["dim"]: r["text"] for r in rows if r["version"] == "detailed"},
    )


def rubric_lookup(dim: Column, rubric: Rubric, detailed: bool) -> Column:
    """Prompt text of a dimension column, '' for an unknown dimension."""
    entries = [F.lit(x) for d in rubric.dims for x in (d, rubric.text(d, detailed))]
    return F.coalesce(F.create_map(*entries)[dim], F.lit(""))


def user_prompt(profile: Column, scene: Column, traits: Column) -> Column:
    return F.format_string(USER_FORMAT, profile, scene, traits)


def archetype_prompt(question: Column, heading: bool = True) -> Column:
    """The question of an archetype item: under its heading for a judge, alone for training rows."""
    return F.format_string(ARCHETYPE_FORMAT, question) if heading else question


def question_prompt(body: Column) -> Column:
    return F.format_string(QUESTION_FORMAT, body)


def combined_requests(items: DataFrame, rubric_text: str, user: Column, key: str = "item_id") -> DataFrame:
    """One request per item: rubric, then item."""
    return items.select(key, F.concat(F.lit(rubric_text + "\n"), user).alias("prompt"))


def separate_requests(items: DataFrame, rubric: Rubric, detailed: bool, user: Column, key: str = "item_id") -> DataFrame:
    """One request per item and dimension: item, then the rubric of the dimension."""
    dims = F.array(
        *[F.struct(F.lit(d).alias("dim"), F.lit(rubric.text(d, detailed)).alias("text")) for d in rubric.dims]
    )
    return items.select(key, user.alias("_user"), F.explode(dims).alias("_r")).select(
        key, F.col("_r.dim").alias("dim"), F.concat("_user", F.lit("\n"), F.col("_r.text")).alias("prompt")
    )


def user_message(audio: Column, text: Column) -> Column:
    """``[{role: user, content: [audio, text]}]``."""
    none = F.lit(None).cast("string")
    return F.array(
        F.struct(
            F.lit("user").alias("role"),
            F.array(
                F.struct(F.lit("audio").alias("type"), audio.alias("audio_url"), none.alias("text")),
                F.struct(F.lit("text").alias("type"), none.alias("audio_url"), text.alias("text")),
            ).alias("content"),
        )
    )


CAPTION_KINDS = ("RoleCaption", "RoleVariationCaption", "RoleEmotion")


def evaluation_text(
    kind: Column, dim_prompt: Column, user: Column, caption_prompt: str = "", emotion_prompt: str = ""
) -> Column:
    """Single-dimension evaluation question per dataset kind; NULL for an unknown kind."""
    body = F.concat(dim_prompt, F.lit("\n\n"), user)
    captioned = F.concat(body, F.lit("\n\n" + caption_prompt))
    with_emotion = F.concat(body, F.lit("\n\n" + emotion_prompt))
    chosen = (
        F.when(kind.isin("ROLE", "RoleVariation", "Arche"), body)
        .when(kind.isin("RoleCaption", "RoleVariationCaption"), captioned)
        .when(kind == "RoleEmotion", with_emotion)
    )
    return F.when(chosen.isNotNull(), question_prompt(chosen))


def comprehensive_text(
    kind: Column, user: Column, general: str, general_detailed: str, caption_prompt: str = "", emotion_prompt: str = ""
) -> Column:
    """All-dimension evaluation question per dataset kind."""
    base = F.when(kind == "RoleAllFixOrder", F.lit(general_detailed)).otherwise(F.lit(general))
    tail = (
        F.when(kind == "RoleCaption", F.lit("\n\n" + caption_prompt))
        .when(kind == "RoleEmotion", F.lit("\n\n" + emotion_prompt))
        .otherwise("")
    )
    return F.concat(question_prompt(F.concat(user, F.lit("\n\n"), base)), tail)


def think_prefill(kind: Column, caption: Column, enabled: bool = True) -> Column:
    """Opening of the assistant turn with the known caption (also for the emotion kind), '' for other kinds."""
    if not enabled:
        return F.lit("")
    body = F.concat(F.lit("<think>"), F.coalesce(caption, F.lit("N/A")), F.lit("</think><"))
    return F.when(kind.isin(*CAPTION_KINDS), body).otherwise("")


def evaluation_messages(audio: Column, text: Column, prefill: Column) -> Column:
    """``[user, assistant?]``; the assistant turn is there only for a non-empty prefill."""
    user = F.struct(
        F.lit("user").alias("role"),
        F.array(
            F.struct(F.lit("audio").alias("type"), audio.alias("value")),
            F.struct(F.lit("text").alias("type"), text.alias("value")),
        ).alias("content"),
    )
    assistant = F.struct(
        F.lit("assistant").alias("role"), F.array(F.struct(F.lit("text").alias("type"), prefill.alias("value"))).alias("content")
    )
    return F.when(prefill != "", F.array(user, assistant)).otherwise(F.array(user))


# ---- prompt variations -------------------------------------------------------------------------------------


def dimension_variations(phrasings: DataFrame, headers: list[str], seed: int) -> DataFrame:
    """Every header with every phrasing of every dimension, with unique ids.

    ``phrasings`` has ``(dim, variant, name, description, scale_1 .. scale_5)``.
    """
    header = F.array(*[F.struct(F.lit(i).alias("h"), F.lit(t).alias("t")) for i, t in enumerate(headers)])
    rows = phrasings.withColumn("_header", F.explode(header))
    ident = F.concat_ws("_", F.lit("dimension"), "dim", F.col("_header.h"), "variant")
    example = picks.below(F.lit(5), seed, "example", ident) + 1
    text = F.concat(
        F.col("_header.t"),
        F.lit(VARIATION_LAYOUT[0]), F.col("name"), F.lit(VARIATION_LAYOUT[1]), F.col("description"), F.lit("\n\n"),
        *[c for i in (5, 4, 3, 2, 1) for c in (F.lit(f"{i}: "), F.col(f"scale_{i}"), F.lit("\n"))],
        F.lit(VARIATION_LAYOUT[2] + "<answer>"), example.cast("string"), F.lit("</answer>"),
    )
    return rows.select(ident.alias("id"), F.col("dim").alias("dimension_name"), text.alias("prompt_text"))


def rubric_combinations(
    phrasings: DataFrame, n: int, seed: int, systems: list[str], schemas: list[str], style: str,
    opening: str = "", closing: str = "",
) -> DataFrame:
    """n rubrics, each with one random phrasing per dimension, a random system prompt and output schema.

    Per variation a phrasing number is drawn for every dimension and joined to the phrasing of that number.
    ``phrasings`` additionally has ``ord`` (dimension order) and ``variant`` 0..m-1 per dimension.
    """
    dims = phrasings.groupBy("dim", "ord").agg(F.count("*").alias("m"))
    draws = dims.select(
        "dim", "ord", "m", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i")
    ).select("dim", "ord", "i", picks.below(F.col("m"), seed, style, F.col("i"), F.col("dim")).alias("variant"))
    chosen = draws.join(phrasings.drop("ord"), ["dim", "variant"])
    if style == "detailed":
        cells = [F.format_string(CELL, F.lit(str(k)), F.col(f"scale_{k}")) for k in (5, 4, 3, 2, 1)]
        row = F.concat(F.format_string(NUMBERED_ROW, (F.col("ord") + 1).cast("string"), F.col("name")), *cells, F.lit("\n"))
    else:
        row = F.format_string(SIMPLE_ROW, F.col("name"), F.col("description"))
    # a list holds one phrasing per dimension
    texts = chosen.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("ord", row.alias("t")))).alias("rows"))
    pick = lambda options, what: picks.choose(F.array(*[F.lit(o) for o in options]), seed, style, what, F.col("i"))
    body = F.concat(
        F.lit(opening), F.array_join(F.transform("rows", lambda r: r["t"]), ""), F.lit(closing), pick(schemas, "schema")
    )
    return texts.select(
        F.concat(F.lit(style + "_"), F.col("i").cast("string")).alias("id"),
        pick(systems, "system").alias("system_prompt"),
        body.alias("prompt_text"),
    )


# ---- multiple choice -----------------------------------------------------------------------------------------


def options_text(choices: Column) -> Column:
    """A list of options in bracketed, quoted form."""
    quoted = F.transform(choices, lambda c: F.concat(F.lit("'"), c, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def choice_prompt(question: Column, choices: Column, audio_words: bool = True) -> Column:
    """Multiple-choice question; ``audio_words`` says audio where the source says video."""
    q = F.replace(question, F.lit("video"), F.lit("audio")) if audio_words else question
    return F.format_string(CHOICE_FORMAT, q, options_text(choices))


def choice_solution(choices: Column, answer: Column) -> Column:
    return F.concat(F.lit("<answer>"), F.element_at(choices, answer + 1), F.lit("</answer>"))
