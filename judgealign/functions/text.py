"""Score and answer extraction from judge text.

Regular expressions carry ``(?U)`` where digits or blanks may be any Unicode digit or blank.
``regexp_extract`` gives ``''`` for no match, so every use is wrapped by :func:`first_group`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: report labels and score tags -----------------------------------------------------
REPORT_LABELS = {
    "emotional_accuracy": "Emotional Accuracy",
    "naturalness": "Naturalness",
    "consistency_with_character_profile": "Consistency with Character Profile",
    "style_consistency": "Style Consistency",
    "age_appropriateness": "Age Appropriateness",
    "personality_alignment": "Personality Alignment",
    "emotion_recognition": "Emotion Recognition",
    "emotional_intensity": "Emotional Intensity",
    "emotional_range": "Emotional Range",
    "contextual_appropriateness": "Contextual Appropriateness",
    "pitch_variation": "Pitch Variation",
    "dynamic_range": "Dynamic Range",
    "character_consistency": "Character Consistency",
    "emotion_intensity_control": "Emotion Intensity Control",
    "stress_and_emphasis": "Stress and Emphasis",
    "global_story_coherence": "Global Story Coherence",
    "local_story_fit": "Local Story Fit",
}
REPORT_TAGS = [
    "pitch_dynamics",
    "rhythmic_naturalness",
    "stress_emphasis",
    "emotion_accuracy",
    "emotion_intensity",
    "emotional_dynamic_range",
    "voice_identity_matching",
    "trait_embodiment",
    "local_scene_fit",
    "global_story_fit",
]
# ------------------------------------------------------------------------------------------------------

def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """First match, or NULL. An empty but matching group is NULL too."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def strip_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_fences(response: Column) -> Column:
    """Drop markdown code fences and the blanks after them, then outer blanks; other text stays as it is."""
    no_json = F.regexp_replace(response, r"(?U)```json\s*", "")
    fenced = F.contains(response, F.lit("```"))
    return F.when(fenced, strip_blank(F.regexp_replace(no_json, r"(?U)```\s*", ""))).otherwise(response)


def strict_json(text: Column) -> Column:
    """The text as a VARIANT, NULL where it is not exactly one JSON value.

    The parser itself stops after the first value and accepts whatever follows. A flat object that ends with its
    only brace has nothing behind it. Any other text must also be valid as the single element of an array and
    as the single value of an object: no tail is valid in both places.
    """
    value = F.try_parse_json(text)
    flat = text.rlike(r"^[^{}]*\{[^{}]*\}\s*$")
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(flat, value).when(in_array & in_object, value)


def loose_object(text: Column) -> Column:
    """Entries ``(key, value as text)`` of one JSON object that may repeat keys or hold bare NaN and Infinity.

    NULL where the text is not exactly one such object, by the test of :func:`strict_json`. Strings and tokens look
    alike in the values, so the text ``"true"`` counts as the token.
    """
    kind = "map<string,string>"
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>").isNotNull()
    in_object = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"struct<v:{kind}>")["v"].isNotNull()
    return F.when(in_array & in_object, F.map_entries(F.from_json(text, kind)))


def first_fenced_json(response: Column) -> Column:
    """The first fenced block, or the whole text, where it is valid JSON; else NULL."""
    block = F.regexp_extract(response, r"(?s)```json(.*?)```", 1)
    text = strip_blank(F.when(response.rlike(r"(?s)```json(.*?)```"), block).otherwise(response))
    return F.when(strict_json(text).isNotNull(), text)


def normal_answer(response: Column) -> Column:
    """A JSON answer in one form (no blanks, keys in order); text that is not JSON stays as it is."""
    block = F.regexp_extract(response, r"(?s)```json(.*?)(```|$)", 1)
    fenced = response.rlike(r"```json")
    value = strict_json(strip_blank(F.when(fenced, block).otherwise(response)))
    return F.coalesce(F.to_json(value), response)


# A cast that fails costs far more than a pattern test, so the pattern comes first. It also refuses what casts in
# SQL but is no number in text (``1d``, ``inf``, ``nan``).
_FLOAT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INT = r"^\s*[+-]?\d+\s*$"


def as_float(text: Column) -> Column:
    """Decimal number with optional exponent and outer blanks, else NULL."""
    return F.when(text.rlike(_FLOAT), text.try_cast("double"))


def as_int(text: Column) -> Column:
    """Whole number with optional sign and outer blanks, else NULL."""
    return F.when(text.rlike(_INT), text.try_cast("bigint"))


def is_float_text(text: Column) -> Column:
    """Whether a judge answer is a bare number."""
    return F.coalesce(as_float(text).isNotNull(), F.lit(False))


def answer_text(output: Column) -> Column:
    """Text of the first answer tag (the opening bracket may be missing); NULL without a tag."""
    pattern = r"(?s)answer>(.*?)</answer>"
    return F.when(output.rlike(pattern), strip_blank(F.regexp_extract(output, pattern, 1)))


def answer_score(output: Column) -> Column:
    """First whole number in the answer tag; 1 for an answer without digits; NULL without a tag."""
    answer = answer_text(output)
    digits = first_group(answer, r"(\d+)").try_cast("bigint")
    return F.when(answer.isNotNull(), F.coalesce(digits, F.lit(1)))


def tagged_scores(output: Column, dims: list[str]) -> Column:
    """Map dimension -> first whole number in its ``<dim>...</dim>`` tag, NULL where there is none."""
    entries = []
    for dim in dims:
        body = first_group(output, rf"(?s){dim}>(.*?)</{dim}>")
        entries += [F.lit(dim), first_group(body, r"(\d+)").try_cast("bigint")]
    return F.create_map(*entries)


def report_patterns() -> dict[str, str]:
    """Category -> case-insensitive pattern. Labels are unanchored, so ``Naturalness:`` also hits a longer label."""
    out = {c: rf"(?i){label}:\s*(\d+)" for c, label in REPORT_LABELS.items()}
    out.update({t: rf"(?i)<{t}>(\d+)</{t}>" for t in REPORT_TAGS})
    return out


def report_ratings(text: Column) -> Column:
    """Map category -> rating in a free-text evaluation, NULL for a category that is not found.

    It is a plain map constructor without lambdas: exploding a lambda expression makes the optimizer infer the same
    filter again and again.
    """
    entries = []
    for category, pattern in report_patterns().items():
        entries += [F.lit(category), first_group(text, pattern).try_cast("double")]
    return F.create_map(*entries)


def report_hits(text: Column) -> tuple[Column, Column]:
    """All labels and tags with a number in a text, in lower case, and their numbers: two arrays of one length.

    A label is looked for backwards from each colon, a tag from each bracket, so a text is gone through once for all labels
    and once for all tags, whatever their number. No label ends with another one, so a colon has one label at most.
    """
    labels = rf"(?i):(?<=({'|'.join(REPORT_LABELS.values())}):)\s*(\d+)"
    tags = rf"(?i)<({'|'.join(REPORT_TAGS)})>(\d+)</\1>"

    def both(group: int) -> Column:
        return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(group)) for p in (labels, tags)])

    return F.transform(both(1), F.lower), both(2)


def explode_report_ratings(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Rows ``(keep, category, rating)``, one per category that is found; the first number of a category counts."""
    names, numbers = report_hits(F.col(text))
    hits = df.select(*keep, names.alias("_names"), numbers.alias("_numbers"))
    first = F.filter(F.arrays_zip("_names", "_numbers"), lambda hit, i: F.array_position("_names", hit["_names"]) == i + 1)
    category = F.create_map(*[F.lit(x) for c, label in REPORT_LABELS.items() for x in (label.lower(), c)], *[F.lit(t) for t in REPORT_TAGS for _ in (0, 1)])
    # an outer explode: for an inner one the optimizer would evaluate the arrays once more as a filter
    rows = hits.select(*keep, F.explode_outer(first).alias("_hit"))
    rated = rows.select(*keep, category[F.col("_hit._names")].alias("category"), F.col("_hit._numbers").try_cast("double").alias("rating"))
    return rated.where(F.col("rating").isNotNull())


def first_float(text: Column, marker_required: bool) -> Column:
    """First number in the text after ``assistant\\n``; the whole text counts where no marker is required."""
    marker = "assistant\n"
    pos = F.instr(text, marker)
    whole = F.lit(None).cast("string") if marker_required else text
    content = F.when(pos > 0, F.substring(text, pos + F.lit(len(marker)), F.length(text))).otherwise(whole)
    return first_group(content, r"(\b\d+\.?\d*\b)").try_cast("double")


def mcq_answer(text: Column) -> Column:
    """Body of the answer tag, else the whole text, without outer blanks."""
    pattern = r"(?s)<answer>(.*?)</answer>"
    return strip_blank(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text))


def preview(text: Column, size: int) -> Column:
    """The first ``size`` characters and ``...``; '' for an empty or missing text."""
    cut = F.concat(F.substring(text, 1, size), F.lit("..."))
    return F.when(F.coalesce(text, F.lit("")) != "", cut).otherwise("")
