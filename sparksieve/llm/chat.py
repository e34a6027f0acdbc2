r"""Chat formatting, in DataFrame functions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), adjacent turns of one
role are merged into a block, and blocks are concatenated:

    <|im_start|>ROLE<|im_role|>TEXT<|im_sep|>TEXT ... <|im_end|>

The separator keeps merged turns apart, so the turns can be read back.  A control string inside a role or
text gets a backslash after its first character, and one that already has n backslashes there gets n + 1;
reading back takes one away.  So no control string of a text survives as such, and the mapping is exactly
reversible, while texts without control strings stay as they are.  Control strings of other common
templates are escaped too, since a tokenizer may know them.

The loss mask is a list of (start, length) in code points of the formatted text: one span for each
assistant text, in order, without marks or separators.

Cases: null text and null role are empty; null turn sorts first; ties of turn go by role, then text;
repeated rows are turns of their own; a null conv_id is a conversation of its own; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template's marks, and other templates' control strings that are escaped besides.
START, ROLE, SEP, END = "<|im_start|>", "<|im_role|>", "<|im_sep|>", "<|im_end|>"
ESCAPED = r"([<\[])(\\*)(\|im_start\|>|\|im_role\|>|\|im_sep\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|endoftext\|>)"
UNESCAPED = ESCAPED.replace(r"(\\*)", r"\\(\\*)")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPED, "$1$2$3")


def format_chats(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss_spans array<struct<start long, length long>>."""
    rows = conversations.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), escape(F.col("text")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    first = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i - F.when(i > 1, 1).otherwise(0))["role"] != F.element_at("turns", i)["role"]))
    chats = chats.withColumn("first", first).withColumn("next", F.concat(F.slice("first", 2, F.size("first")), F.array(F.size("turns") + 1)))
    blocks = F.zip_with("first", "next", lambda a, b: F.struct(F.element_at("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a, b - a), lambda t: t["text"]).alias("texts")))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escape(b["role"]), F.lit(ROLE))
    text = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], SEP), F.lit(END))), "")
    # Pieces in order: (chars before the text, chars of the text, under loss?).  Running sums give the spans.
    pieces = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    (F.when(i == 0, F.length(head(b))).otherwise(len(SEP))).cast("long").alias("gap"),
                    F.length(t).cast("long").alias("length"),
                    (b["role"] == loss_role).alias("loss"),
                    (F.when(i == F.size(b["texts"]) - 1, len(END)).otherwise(0)).cast("long").alias("tail"),
                ),
            ),
        )
    )
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("spans"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["gap"] + p["length"] + p["tail"]).alias("at"),
        F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["gap"]).alias("start"), p["length"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    )
    return chats.select("conv_id", text.alias("formatted"), F.aggregate(pieces, nothing, step)["spans"].alias("loss_spans"))


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of struct role, text), read back from `formatted`, and loss_text, read through `loss_spans`."""
    body = F.filter(F.split("formatted", "<\\|im_end\\|>", -1), lambda b: b != "")
    role = lambda b: F.substring_index(F.substring(b, len(START) + 1, 1 << 30), ROLE, 1)
    texts = lambda b: F.split(F.substring(b, F.locate(ROLE, b) + len(ROLE), F.lit(1 << 30)), "<\\|im_sep\\|>", -1)
    turns = F.flatten(F.transform(body, lambda b: F.transform(texts(b), lambda t: F.struct(unescape(role(b)).alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def probe(spark: SparkSession, like: DataFrame) -> DataFrame:
    """Conversation -1, whose texts hold control strings, in the columns' types of `like`."""
    said = F.lit("</s>[INST] ok [/INST]")
    rows = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return rows.select(*[F.col(c).cast(like.schema[c].dataType).alias(c) for c in ("conv_id", "turn", "role", "text")])
