"""Chat formatting with Spark expressions only: sorted turns, merged neighbours, one string per conversation.

Format (markers are fixed values of the template)::

    <s>[ROLE]user[TEXT]first text[NEXT]second text of the same role</s><s>[ROLE]assistant[TEXT]...</s>

Every marker begins with ``<`` or ``[``. Inside roles and texts the characters ``\\``, ``<`` and ``[`` are written
``\\b``, ``\\l`` and ``\\s``, so no text can hold a marker, and the way back is exact.

A conversation is one row of the result and is put together in one task: it must fit into a row. Turns are merged by
comparing neighbours, and starts are running sums in chunks, so the work is near to linear in the number of turns. The
number of conversations is not limited, and no other grouping takes place.

Defined results: a null text or role is empty; turns are ordered by ``turn`` (null first), equal turns by role and
text, and repeated rows all stay; a null ``conv_id`` is a conversation of its own; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, ROLE, TEXT, NEXT, CLOSE = "<s>[ROLE]", "[ROLE]", "[TEXT]", "[NEXT]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\s"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, as the entry of an array of one; lambdas inside only refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Entries that one aggregate over an array appends to an array, which Spark copies each time.
CHUNK = 256


def running_sums(sizes: Column) -> Column:
    """The sum of all entries up to each one, of an array column; chunks keep the work near to linear."""

    def chunked(all_sizes: Column) -> Column:
        return F.when(F.size(all_sizes) > 0, F.transform(F.sequence(F.lit(1), F.size(all_sizes), F.lit(CHUNK)), lambda at: F.slice(all_sizes, at, F.lit(CHUNK)))).otherwise(
            F.array().cast("array<array<int>>")
        )

    def summed(values: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("sums"))
        return F.aggregate(values, begin, lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["sums"], F.array(s["at"] + v)).alias("sums")), lambda s: s["sums"])

    def joined(both: Column) -> Column:
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(both["ends"], k - 1))
        return F.flatten(F.transform(both["chunks"], lambda chunk, k: summed(chunk, start(k))))

    def with_ends(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v))
        return F.struct(chunks.alias("chunks"), summed(totals, F.lit(0)).alias("ends"))

    return bound(sizes, lambda all_sizes: bound(chunked(all_sizes), lambda chunks: bound(with_ends(chunks), joined)))


def merged(turns: Column) -> Column:
    """Per turn ``head, text, tail, role``: a turn opens a block where its role differs from the one before, closes it where it
    differs from the next one, and is marked as a further text of its block elsewhere."""

    def piece(turn: Column, i: Column) -> Column:
        opens = (i == 0) | (F.get(turns, i - 1)["role"] != turn["role"])
        closes = (i + 1 == F.size(turns)) | (F.get(turns, i + 1)["role"] != turn["role"])
        head = F.when(opens, F.concat(F.lit(OPEN), escape(turn["role"]), F.lit(TEXT))).otherwise(F.lit(NEXT))
        return F.struct(head.alias("head"), escape(turn["text"]).alias("text"), F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")).alias("tail"), turn["role"].alias("role"))

    return F.transform(turns, piece)


def text_spans(pieces: Column, ends: Column, loss_roles: list[str]) -> Column:
    """Start (from 0) and length, in code points of the formatted string, of every text under the loss mask."""

    def span(p: Column, i: Column) -> Column:
        size = F.length(p["text"])
        return F.when(p["role"].isin(loss_roles), F.struct((F.get(ends, i) - F.length(p["tail"]) - size).alias("start"), size.alias("length")))

    return F.filter(F.transform(pieces, span), lambda s: s.isNotNull())


def format_conversations(turns: DataFrame, loss_roles: list[str] | None = None) -> DataFrame:
    """``conv_id``, ``formatted`` and ``loss_spans`` per conversation."""
    roles = loss_roles or ["assistant"]
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    size = lambda p: F.length(p["head"]) + F.length(p["text"]) + F.length(p["tail"])
    text = lambda p: F.concat(p["head"], p["text"], p["tail"])

    def made(pieces: Column) -> Column:
        spans = bound(running_sums(F.transform(pieces, size)), lambda ends: text_spans(pieces, ends, roles))
        return F.struct(F.array_join(F.transform(pieces, text), "").alias("formatted"), spans.alias("loss_spans"))

    done = ordered.select("conv_id", bound(F.col("turns"), lambda turns: bound(merged(turns), made)).alias("made"))
    return done.select("conv_id", "made.formatted", "made.loss_spans")


def read_back(formatted: Column) -> Column:
    """The original turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.split(formatted, r"</s>")
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        parts = F.split(F.substr(block, F.lit(len(OPEN) + 1)), r"\[TEXT\]")
        role = unescape(F.get(parts, F.lit(0)))
        return F.transform(F.split(F.get(parts, F.lit(1)), r"\[NEXT\]"), lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and hashes read back from the formatted strings and their masks."""
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    # four bytes per code point, so a span is found without a walk over the text before it
    cut = lambda wide: F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(wide, s["start"] * 4 + 1, s["length"] * 4), "UTF-32")))
    loss = F.array_join(bound(F.encode("formatted", "UTF-32"), cut), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join("turns", ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
