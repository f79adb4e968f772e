"""Operator 3: chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts, each with a kind, a text, a reference and
a number of units. A visitor goes over them in order: text is escaped and kept;
an image, audio or document part becomes a placeholder, its reference is
recorded with the turn and part it stands at, and the number of tokens that the
placeholder expands to is counted. Turns are marked by a template; in texts a
backslash goes before every backslash, before every ``|`` that follows ``<``,
and before a ``|`` that starts a part, so no control string can arise within or
between parts, and dropping those backslashes gives the text back. The
loss mask is a list of spans (start, length) over the formatted text, one for
each assistant turn: its content, without the marks around it.

Defined results: null text or role is empty; null parts are no parts; a part of
unknown kind is shown like a document; turns are ordered by turn, then role,
then content, null turns first, so ties and repeated rows have one order; rows
whose conversation is null are one conversation; an empty table gives no rows.
A conversation is one output row, so it must fit in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PART_TYPE = "array<struct<kind:string,text:string,ref:string,units:bigint>>"
#: Tokens that a placeholder expands to for each unit: an image's tiles, an audio's seconds, a document's pages.
TOKENS_A_UNIT = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|(?<=<)\||^\|", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """A role stands on one line: its line ends are escaped too."""
    return F.regexp_replace(role, r"\\|\n|(?<=<)\||^\|", r"\\$0")


def text_parts(text: Column) -> Column:
    """The parts of a turn that is text alone."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("bigint").alias("units")))


def visit(part: Column) -> Column:
    """(shown, kind, ref, tokens) of a part; tokens are those of its placeholder, 0 for text."""
    kind = F.when(part["kind"].isin(*TOKENS_A_UNIT), part["kind"]).otherwise(F.lit("document"))
    a_unit = F.element_at(F.create_map(*(F.lit(x) for pair in TOKENS_A_UNIT.items() for x in pair)), kind)
    is_text = F.coalesce(part["kind"], F.lit("text")) == "text"
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>"))).alias("shown"),
        F.when(~is_text, kind).alias("kind"),
        part["ref"].alias("ref"),
        F.when(is_text, F.lit(0).cast("bigint")).otherwise(a_unit * F.coalesce(part["units"], F.lit(1).cast("bigint"))).alias("tokens"),
    )


def format_chats(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: (conv, formatted, loss_spans, attachments, n_tokens of placeholders).

    One shuffle by conversation serves the running offsets and the grouping.
    """
    turns = df.select(
        F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"),
        F.coalesce(F.col(parts_col), F.array().cast(PART_TYPE)).alias("_parts"),
    ).withColumn("_seen", F.transform("_parts", visit))
    turns = turns.withColumn("_content", F.array_join(F.col("_seen")["shown"], "")).withColumn("_head", F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")))
    in_order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_parts")
    size = F.length("_head") + F.length("_content") + len(END)
    placed = turns.withColumn("_k", F.row_number().over(in_order)).withColumn("_at", F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("_content") - len(END))
    attached = F.filter(
        F.transform("_seen", lambda x, i: F.struct(F.col("_turn").alias("turn"), i.alias("part"), x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens"))),
        lambda x: x["kind"].isNotNull(),
    )
    row = F.struct("_k", F.concat("_head", "_content", F.lit(END)).alias("shown"), (F.col("_role") == loss_role).alias("loss"), F.col("_at").alias("start"), F.length("_content").cast("bigint").alias("length"), attached.alias("attached"))
    held = placed.groupBy("_conv").agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    spans = F.transform(F.filter("_rows", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    files = F.flatten(F.col("_rows")["attached"])
    return held.select(
        F.col("_conv").alias(conv_col), F.array_join(F.col("_rows")["shown"], "").alias("formatted"), spans.alias("loss_spans"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("bigint"), lambda n, x: n + x["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of every turn of a formatted conversation, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    header = r"(?s)^<\|im_start\|>([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, header, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(piece, F.length(role) + len(START) + 2)).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def chat_digest(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    turns = F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = chats.select(conv_col, "formatted", turns.alias("_turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss"))
    return read.select(
        conv_col, F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
