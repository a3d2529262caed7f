"""Item keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truth_key(item_id: Column) -> Column:
    """Annotated items are keyed by their id without ``.wav``."""
    return F.replace(item_id, F.lit(".wav"), F.lit(""))


def result_key(audio_path: Column, item_id: Column, strict_keys: bool = False) -> Column:
    """Judge results are keyed by the last path segment without ``.wav``, else by their id.

    ``strict_keys`` leaves the fallback id as it is, so ids that end in ``.wav`` match nothing.
    """
    name = F.element_at(F.split(audio_path, "/"), -1)
    fallback = item_id if strict_keys else truth_key(item_id)
    return F.when(F.coalesce(audio_path, F.lit("")) != "", truth_key(name)).otherwise(fallback)


def nested_or_top(df, field: str, container: str = "annotations") -> Column:
    """A field that sits at the top level or below ``container``; NULL where neither has it."""
    found = []
    if field in df.columns:
        found.append(F.col(f"`{field}`"))
    if container in df.columns:
        inner = df.schema[container].dataType
        if getattr(inner, "names", None) is None:  # a map
            found.append(F.col(container)[field])
        elif field in inner.names:
            found.append(F.col(f"{container}.`{field}`"))
    return F.coalesce(*found) if found else F.lit(None)
