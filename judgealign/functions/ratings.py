"""Missing-value policies for human ratings.

A policy is always named by the caller. Each one says what a single raw rating turns into:

===================  =======  ===============  ====================  =======
policy               null     N/A              unparsable            empty list
===================  =======  ===============  ====================  =======
fill1                1        1 (any case)     1                     no row
fill1_bool           1        1 (any case)     1                     no row
drop_null            dropped  undefined mean   undefined mean        no row
drop_null_na1        dropped  1 (exact)        undefined mean        no row
drop_null_na1_gate   dropped  1, gate: fail    undefined mean        no row
fewshot_avg          1        1 (exact)        undefined mean        1
===================  =======  ===============  ====================  =======

"Undefined mean" is carried as NaN through ``avg`` and becomes NULL in :func:`mean_or_null`.
``fewshot_avg`` rounds the mean half-to-even. A nested list counts as its first element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from judgealign.functions.text import as_float, as_int, strip_blank

POLICIES = ("fill1", "fill1_bool", "drop_null", "drop_null_na1", "drop_null_na1_gate", "fewshot_avg")


def _first_element(raw: Column) -> Column:
    """``[4]`` -> ``4``, ``[]`` -> ``1``."""
    inner = strip_blank(F.regexp_replace(F.split(raw, ",")[0], r"[\[\]\"]", ""))
    return F.when(inner == "", "1").otherwise(inner)


def _bool(raw: Column) -> Column:
    return F.when(raw == "true", 1.0).when(raw == "false", 0.0)


def coerce(raw: Column, policy: str, gate: bool = False) -> Column:
    """One raw rating as a double; NULL means that the rating is dropped."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; one of {POLICIES}")
    nan = F.lit(float("nan"))
    if policy in ("fill1", "fill1_bool"):
        # the usual whole number first; a nested list costs more and is rare
        inner = _first_element(raw)
        nested = F.when(raw.startswith("["), F.coalesce(as_int(inner).cast("double"), _bool(inner)))
        return F.coalesce(as_int(raw).cast("double"), _bool(raw), nested, F.lit(1.0))
    number = F.coalesce(as_float(raw), _bool(raw), nan)
    if policy == "drop_null":
        return F.when(raw.isNotNull(), number)
    if policy == "drop_null_na1":
        return F.when(raw == "N/A", 1.0).when(raw.isNotNull(), number)
    if policy == "drop_null_na1_gate":
        return F.when(raw == "N/A", 0.0 if gate else 1.0).when(raw.isNotNull(), number)
    return F.when(raw.isNull() | (raw == "N/A"), 1.0).otherwise(number)  # fewshot_avg


def clean(ratings: Column, policy: str, gate: bool = False) -> Column:
    """A list of raw ratings as an array of doubles without the dropped ones."""
    return F.filter(F.transform(ratings, lambda r: coerce(r, policy, gate)), lambda v: v.isNotNull())


def finish(mean: Column, policy: str) -> Column:
    """A mean of coerced ratings (NaN = undefined) as the policy's result."""
    defined = F.nanvl(mean, F.lit(None).cast("double"))
    return F.bround(defined) if policy == "fewshot_avg" else defined


def mean(values: Column) -> Column:
    """Mean of the non-null elements of an array in one pass, NULL where there is none."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(
        values,
        start,
        lambda acc, v: F.struct((acc["s"] + F.coalesce(v, F.lit(0.0))).alias("s"), (acc["n"] + v.isNotNull().cast("int")).alias("n")),
        lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]),
    )


def mean_of(ratings: Column, policy: str) -> Column:
    """Mean of a list of raw ratings under a policy, NULL where undefined."""
    result = finish(mean(F.transform(ratings, lambda r: coerce(r, policy))), policy)
    if policy == "fewshot_avg":
        return F.when(F.size(ratings) == 0, 1.0).otherwise(result)
    return result


def mean_or_null(coerced: Column, policy: str) -> Column:
    """Aggregate form: mean of a column of coerced ratings per group."""
    return finish(F.avg(coerced), policy)


def majority(passes: Column, fails: Column, total: Column, tie: str) -> Column:
    """Majority vote from counts. ``tie="pass"``: fails need more than half; ``tie="null"``: strict majority."""
    if tie == "pass":
        return F.when(fails * 2 > total, 0).otherwise(1)
    return F.when(passes > fails, 1).when(fails > passes, 0)
