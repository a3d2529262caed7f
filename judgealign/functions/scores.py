"""Per-dimension scores from judge answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgealign.functions import text as X

#: A JSON number as a VARIANT writes it.
_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def parse_scores(
    df: DataFrame,
    dims: list[str],
    mode: str = "float",
    response: str = "response",
    default: float = 1.0,
) -> DataFrame:
    """Add one score column per dimension, parsing the response once.

    * a key that is missing scores ``default`` for that dimension only;
    * text that is not a JSON object, or one present value that is no number, resets the whole row to ``default``;
    * of equal keys the last one counts, and a bare NaN or Infinity is a number (in ``float`` mode);
    * ``mode="int"`` truncates numbers and accepts only whole-number strings, ``"float"`` keeps fractions;
    * where the response itself is NULL, the row's own columns named like the dimensions are the scores,
      and a dimension without such a column stays NULL (that trial then drops out for that dimension).
    """
    if mode not in ("int", "float"):
        raise ValueError(f"unknown mode {mode!r}")
    keep = [c for c in df.columns if c not in dims]
    scored = F.col(response).isNotNull()
    top = [F.col(f"`{d}`").cast("double").alias(f"_top{i}") if d in df.columns else F.lit(None).cast("double").alias(f"_top{i}") for i, d in enumerate(dims)]
    tops = [f"_top{i}" for i in range(len(dims))]

    # one projection per step, so that each value is computed once and only referred to afterwards
    texts = df.select(*keep, *top, X.strip_fences(F.col(response)).alias("_text"))
    parsed = texts.withColumn("_json", X.strict_json(F.col("_text")))
    odd = F.col("_json").isNull() & F.col("_text").rlike(r"^\s*\{")
    parsed = parsed.select(*keep, *tops, "_json", F.when(odd, X.loose_object(F.col("_text"))).alias("_loose"))
    raw = parsed.select(
        *keep,
        *tops,
        *[F.try_variant_get("_json", f"$['{d}']", "variant").alias(f"_raw{i}") for i, d in enumerate(dims)],
        *[_hits("_loose", d).alias(f"_odd{i}") for i, d in enumerate(dims)],
    )
    # numbers are written by most judges; only rows with anything else take the way of _number and _loose_number, which is
    # a lambda so that its code is not part of what every row runs through
    tokens = raw.withColumns({f"_token{i}": F.to_json(f"_raw{i}") for i in range(len(dims))})
    plain = [F.col(f"_odd{i}").isNull() & (F.col(f"_token{i}").isNull() | F.col(f"_token{i}").rlike(_NUMBER)) for i in range(len(dims))]
    numbers = [F.col(f"_token{i}").try_cast("double") for i in range(len(dims))]
    found = F.array(*[F.struct(F.col(f"_raw{i}").alias("raw"), F.col(f"_odd{i}").alias("odd")) for i in range(len(dims))])
    values = tokens.select(
        *keep,
        *tops,
        *[(F.col(f"_raw{i}").isNotNull() | F.coalesce(F.size(f"_odd{i}") > 0, F.lit(False))).alias(f"_has{i}") for i in range(len(dims))],
        F.when(reduce(lambda a, b: a & b, plain), F.array(*[_truncated(n) if mode == "int" else n for n in numbers]))
        .otherwise(F.transform(found, lambda v: F.coalesce(_number(v["raw"], mode), _loose_number(v["odd"], mode))))
        .alias("_vals"),
    )
    sound = [~F.col(f"_has{i}") | F.col("_vals")[i].isNotNull() for i in range(len(dims))]
    checked = values.withColumn("_ok", reduce(lambda a, b: a & b, sound))
    fallback = F.lit(float(default))
    out = []
    for i, d in enumerate(dims):
        score = F.when(F.col("_ok") & F.col(f"_has{i}"), F.col("_vals")[i]).otherwise(fallback)
        out.append(F.when(scored, score).otherwise(F.col(f"_top{i}")).alias(d))
    return checked.select(*keep, *out)


def _number(raw: Column, mode: str) -> Column:
    """A JSON value as a number: numbers, booleans and numeric text; NULL for anything else."""
    number = F.try_variant_get(raw, "$", "double")
    as_text = F.try_variant_get(raw, "$", "string")
    if mode == "int":
        is_text = F.schema_of_variant(raw) == "STRING"
        return F.when(is_text, X.as_int(as_text).cast("double")).otherwise(_truncated(number))
    # text with a type suffix such as 1d casts in SQL but is no number
    return F.when(number.isNotNull() & ~as_text.rlike(r"\d\.?[dDfF]\s*$"), number)


def _truncated(number: Column) -> Column:
    """A number without its fraction."""
    return F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)).cast("double")


def _hits(entries: str, key: str) -> Column:
    """The map entries of a key in order."""
    return F.filter(entries, lambda e: e["key"] == F.lit(key))


def _loose_number(hits: Column, mode: str) -> Column:
    """The last value of a key in an object with repeated keys or bare NaN, as a number."""
    value = F.regexp_replace(F.try_element_at(hits, F.lit(-1))["value"], r'^"(NaN|-?Infinity)"$', "$1")
    plain = F.when(~value.rlike(r"\d\.?[dDfF]\s*$"), value.try_cast("double"))
    number = F.when(value == "true", 1.0).when(value == "false", 0.0).otherwise(plain)
    if mode == "float":
        return number
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), _truncated(number))


def separate_score(response: Column, error: Column, default: float = 1.0) -> Column:
    """Score of a one-dimension call: ``default`` for an error or a non-numeric answer."""
    number = F.coalesce(X.as_float(response), F.lit(float(default)))
    return F.when(F.coalesce(error, F.lit(False)), F.lit(float(default))).otherwise(number)


def softmax(logits: Column) -> Column:
    """Softmax over an array of doubles, shifted by the maximum."""
    exps = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def pick_tokens(logits: Column, token_ids: list[int]) -> Column:
    """The logits of the given vocabulary positions (0-based)."""
    return F.array(*[logits[i].cast("double") for i in token_ids])


def expected_score(logits: Column, low: int = 1) -> Column:
    """Expectation of ``low, low+1, ...`` under the softmax of the score-token logits."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    weighted = F.aggregate(
        F.transform(exps, lambda e, i: e * (i + F.lit(low))), F.lit(0.0), lambda a, b: a + b
    )
    return weighted / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b)


def gate_score(logits: Column) -> Column:
    """1.0 where P(pass) of two logits (fail, pass) is at least one half, else 0.0."""
    return F.when(expected_score(logits, low=0) >= 0.5, 1.0).otherwise(0.0)


def range_check(score: Column, lo: Column, hi: Column, integer: bool = True) -> Column:
    """Reason why a score is out of its schema, NULL where it is valid."""
    reason = F.when(score.isNull(), "missing").when((score < lo) | (score > hi), "range")
    if integer:
        reason = reason.when(score != F.floor(score), "fraction")
    return reason


def finite(x: Column) -> Column:
    inf = float("inf")
    return x.isNotNull() & ~F.isnan(x) & (x != F.lit(inf)) & (x != F.lit(-inf))


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def rescale_gate(score: Column) -> Column:
    """A 1..5 score on 0..1."""
    return (score - 1) / 4
