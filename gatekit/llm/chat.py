"""Chat formatting: conversations become one string each, with a mask of the text that is learned from.

A conversation is grouped, its turn structs are sorted, neighbours of one role are merged into one block, and blocks
are concatenated, all in Spark expressions:

    <|im_start|>user<|im_sep|>Hello<|im_end|><|im_start|>assistant<|im_sep|>Hi.<|im_sep|>How are you?<|im_end|>

The control strings start with "<|". Inside roles and texts one backslash is added between "<" and "|" (to however many
stand there), so that no text can look like a control string and removing one backslash gives the text back. Texts
without that sequence are not changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import let

OPEN, BODY, CLOSE = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
#: Running sums are made in chunks of so many turns, so that their cost does not grow with the square of a conversation.
CHUNK = 256


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def _cut(c: Column, control: str) -> Column:
    return F.split(c, control.replace("|", r"\|"))


def _sums(values: Column) -> Column:
    zero = F.array().cast("array<bigint>")
    return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))))


def running_sums(values: Column, chunk: int = CHUNK) -> Column:
    """Sums of the first 1, 2, ... values of an array of bigint that is not empty."""

    def add_up(parts: Column) -> Column:
        carried = _sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(let(carried, lambda c: F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.coalesce(F.get(c, k - 1), F.lit(0))))))

    def chunks(v: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(v), F.lit(chunk))
        return let(F.transform(starts, lambda s: _sums(F.slice(v, s, F.lit(chunk)))), add_up)

    return let(values, chunks)


def _blocks(turns: Column) -> Column:
    """Sorted turns with neighbours of one role merged: array of (role, texts)."""

    def merge(t: Column) -> Column:
        first = F.array_compact(F.transform(t, lambda x, i: F.when((i == 0) | (x["role"] != F.get(t, i - 1)["role"]), i)))

        def run(starts: Column, s: Column, k: Column) -> Column:
            members = F.slice(t, s + 1, F.coalesce(F.get(starts, k + 1), F.size(t)) - s)
            return F.struct(F.get(t, s)["role"].alias("role"), F.transform(members, lambda m: m["text"]).alias("texts"))

        return let(first, lambda starts: F.transform(starts, lambda s, k: run(starts, s, k)))

    return let(turns, merge)


def _formatted(blocks: Column) -> Column:
    shown = F.transform(blocks, lambda b: F.concat(F.lit(OPEN), b["role"], F.lit(BODY), F.array_join(b["texts"], BODY), F.lit(CLOSE)))
    return F.array_join(shown, "")


def _spans(blocks: Column, learned: str) -> Column:
    """Where the learned texts lie in the UTF-8 bytes of the formatted string: (start from 0, bytes), in order."""

    def parts(b: Column) -> Column:
        lead = F.octet_length(b["role"]) + len(OPEN + BODY)
        return F.transform(
            b["texts"],
            lambda x, i: F.struct(
                F.when(i == 0, lead).otherwise(len(BODY)).cast("long").alias("lead"),
                F.octet_length(x).cast("long").alias("bytes"),
                F.when(i == F.size(b["texts"]) - 1, len(CLOSE)).otherwise(0).cast("long").alias("tail"),
                (b["role"] == learned).alias("learned"),
            ),
        )

    def place(p: Column) -> Column:
        ends = running_sums(F.transform(p, lambda x: x["lead"] + x["bytes"] + x["tail"]))
        spans = F.zip_with(p, ends, lambda x, end: F.struct((end - x["tail"] - x["bytes"]).alias("start"), x["bytes"].alias("bytes"), x["learned"].alias("learned")))
        return F.transform(F.filter(spans, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["bytes"]))

    return let(F.flatten(F.transform(blocks, parts)), place)


def format_chats(turns: DataFrame, learned: str = LEARNED) -> DataFrame:
    """One row per conv_id: conv_id, formatted, loss_spans (start and bytes of each text of the learned role).

    turns needs conv_id, turn, role, text; other columns are left out. Turns are ordered by turn, a null turn first; rows
    that share a turn, or repeat another row, all stay, ordered by role and text. Null roles and texts are empty.
    Rows without conv_id are one conversation. Empty texts of the learned role have spans of 0 bytes. A table without
    rows has no conversations. A conversation is one value of the result, so its turns meet in one task.
    """
    one = turns.select("conv_id", F.struct("turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]).alias("t"))
    chats = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    escaped = F.transform("ts", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    out = F.transform(F.array(_blocks(escaped)), lambda b: F.struct(_formatted(b).alias("formatted"), _spans(b, learned).alias("loss_spans")))
    return chats.select("conv_id", F.get(out, F.lit(0)).alias("o")).select("conv_id", "o.formatted", "o.loss_spans")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, text)."""

    def turns(block: Column) -> Column:
        inner = _cut(F.get(_cut(block, CLOSE), F.lit(0)), BODY)
        return let(
            inner,
            lambda p: let(unescape(F.get(p, F.lit(0))), lambda role: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))),
        )

    return F.flatten(F.transform(let(_cut(formatted, OPEN), lambda b: F.slice(b, F.lit(2), F.size(b))), turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped, as an array."""
    piece = lambda raw: F.transform(spans, lambda s: unescape(F.substring(raw, (s["start"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")))
    return let(formatted.cast("binary"), piece)


def digests(chats: DataFrame) -> DataFrame:
    """Turns and loss text read back from format_chats: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
