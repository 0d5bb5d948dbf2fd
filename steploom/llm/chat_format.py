"""Chat formatting with typed content parts.

A turn's content is a list of typed parts. One pass over the list flattens it: text is escaped, and an image, audio
clip or document becomes a placeholder with its ordinal in the conversation; its reference and the tokens it expands
to are recorded. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|turn|>", "<|text|>\n", "<|end|>\n"
#: Where an attachment goes, before it has its ordinal; no escaped text holds it.
SLOT = "<|#|>"
PART_TYPE = "array<struct<type:string,text:string,ref:string,size:bigint>>"
#: Units of ``size`` (pixels, milliseconds, characters) that one token stands for, by kind of attachment.
UNITS_PER_TOKEN = {"image": 784, "audio": 40, "document": 4}


def escape(text: Column) -> Column:
    """Reversible: afterwards the text holds no control string, of this template or of other common ones."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    out = F.regexp_replace(out, r"<(?=/?s>|\||</?SYS>)", "&lt;")
    return F.regexp_replace(out, r"\[(?=/?INST\])", "&lsqb;")


def escape_piece(text: Column) -> Column:
    """As ``escape``, for a text that others follow or precede: no control string arises where they meet."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&lsqb;"))


def unescape(text: Column) -> Column:
    out = F.replace(text, F.lit("&lt;"), F.lit("<"))
    out = F.replace(out, F.lit("&lsqb;"), F.lit("["))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def text_part(text: str | Column) -> Column:
    """A content of one text part."""
    return F.array(
        F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size"))
    )


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("bigint")
    for kind, unit in UNITS_PER_TOKEN.items():
        out = F.when(part["type"] == kind, F.greatest(F.lit(1), F.ceil(F.coalesce(part["size"], F.lit(0)) / unit))).otherwise(out)
    return out.cast("bigint")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """(conversation, formatted, loss_spans, attachments): one row per conversation.

    ``parts`` is an array of struct<type, text, ref, size>. Turns run by turn, then role, then content, so ties are
    settled. Null turns come first, null roles and texts are empty, a null content has no parts; part types other
    than image, audio and document are text. A null conversation id is a conversation of its own. loss_spans holds
    (start, length) in code points of the formatted string, one for each turn of the loss role; attachments holds
    (ordinal, type, ref, tokens). A conversation is one string by nature, so it is built in one row; conversations
    are spread over tasks by their id. Empty tables give an empty result; extra columns are ignored.
    """
    is_file = lambda p: p["type"].isin(*UNITS_PER_TOKEN)
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(F.col(parts_col), F.array().cast(PART_TYPE)).alias("parts"))
    rows = rows.withColumn("files", F.filter("parts", is_file))
    # Running sums along a conversation: the window and the grouping share one shuffle.
    order = Window.partitionBy("conv").orderBy("turn", "role", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("seen", F.coalesce(F.sum(F.size("files")).over(before), F.lit(0)))
    rows = rows.withColumn("head", F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("<"), F.lit("&lt;")), F.lit(MIDDLE)))
    # The visitor: texts between slots first, then each slot takes the ordinal of its attachment in the conversation.
    alone = F.size("parts") == 1
    draft = F.array_join(F.transform("parts", lambda p: F.when(is_file(p), F.lit(SLOT)).when(alone, escape(p["text"])).otherwise(escape_piece(p["text"]))), "")
    marks = F.transform("files", lambda p, i: F.concat(F.lit("<|"), p["type"], F.lit(":"), (F.col("seen") + i + 1).cast("string"), F.lit("|>")))
    body = F.array_join(F.zip_with(F.split(draft, r"<\|#\|>"), marks, lambda text, mark: F.concat(text, F.coalesce(mark, F.lit("")))), "")
    rows = rows.withColumn("body", body).withColumn("chars", (F.length("head") + F.length("body") + len(END)).cast("bigint"))
    start = F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("head")
    span = F.struct(start.cast("bigint").alias("start"), F.length("body").cast("bigint").alias("length"))
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, span))
    conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("k", "head", "body", "span", "files"))).alias("turns"))
    files = F.flatten(F.transform("turns", lambda t: t["files"]))
    return conv.select(
        F.col("conv").alias(conv_col),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
        F.transform(files, lambda p, i: F.struct((i + 1).alias("ordinal"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))).alias("attachments"),
    )


def parse_turns(formatted: str | Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped (placeholders stay)."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda _, i: i > 0)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, "<|text|>\n", 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(p, "<|text|>\n", -1), "<|end|>\n", 1)).alias("text"),
        ),
    )


def loss_text(formatted: str | Column, spans: str | Column) -> Column:
    """The unescaped text under the loss mask."""
    source = F.col(formatted) if isinstance(formatted, str) else formatted
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(source, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
