"""Operator 10: chat formatting, in DataFrame functions only.

A turn is an ordered list of typed parts.  Text parts are escaped; image,
audio and document parts become placeholders, and their references and
expanded token counts are recorded in order.  Turns are marked
``<|im_start|>role\\n ... <|im_end|>\\n``.

Escaping: in a text, ``<``, any number of ``%`` and ``|`` in a row get one
more ``%``.  So no text holds ``<|``, every control string in the output is
the template's own, and taking one ``%`` away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
#: Tokens that one unit of an attachment expands to (an image tile, a second
#: of audio, a document page).
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(%*)\|", r"<%$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<%(%*)\|", r"<$1|")


def text_part(text: Column) -> Column:
    """A turn of one text part; null text is empty."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text.cast("string"), F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _placeholder(part: Column) -> Column:
    out = escape(F.coalesce(part["text"], F.lit("")))
    for kind in EXPANSION:
        out = F.when(part["kind"] == kind, F.lit(f"<|{kind}|>")).otherwise(out)
    return out


def _tokens(part: Column) -> Column:
    cost = F.lit(0)
    for kind, each in EXPANSION.items():
        cost = F.when(part["kind"] == kind, F.lit(each)).otherwise(cost)
    return cost * F.coalesce(part["units"], F.lit(1))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, attachment_tokens) per
    conversation of ``turns`` (conv_id, turn, role, parts array<PART>).

    ``loss`` lists the [start, end) character spans of the texts of
    ``loss_role``, in order.  Turns are ordered by ``turn`` (null first), equal
    ones by role and content.  Null role: empty; null parts or part text:
    empty; an unknown kind counts as text.  Rows of a null ``conv_id`` form one
    conversation; repeated rows are repeated turns; no rows, no conversations.
    Other columns are ignored.  A conversation is one output row, so its text
    has to fit one.
    """
    parts = F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select(
        "conv_id", "turn", (role == loss_role).alias("learn"),
        F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"),
        F.array_join(F.transform(parts, _placeholder), "").alias("body"),
        F.transform(F.filter(parts, lambda p: p["kind"].isin(*EXPANSION)), lambda p: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attached"))
    order = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    placed = rows.withColumn("nth", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        + F.length("head"))
    packed = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("nth", "start", "learn", "head", "body", "attached"))).alias("t"))
    attached = F.flatten(F.transform("t", lambda t: t["attached"]))
    return packed.select(
        "conv_id",
        F.array_join(F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "").alias(
            "formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(
            t["start"].cast("int").alias("start"), (t["start"] + F.length(t["body"])).cast("int").alias("end"))).alias(
            "loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from formatted output."""
    turns = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        head = F.substring_index(t, "\n", 1)
        role = F.replace(F.substr(head, F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n"))
        return F.struct(unescape(role).alias("role"),
                        unescape(F.substr(t, F.length(head) + 2)).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """Unescaped text under the loss mask."""
    return F.array_join(F.transform(loss, lambda s: unescape(
        F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digest(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from the output."""
    read = chats.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
                        loss_text(F.col("formatted"), F.col("loss")).alias("learned"))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
