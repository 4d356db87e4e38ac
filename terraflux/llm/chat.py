r"""Operator 7. Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged into blocks of adjacent
turns of one role, and joined:

    ### role:\n text \n<next/>\n text \n</turn>\n     (written without the blanks)

Control strings are ``###``, ``</turn>`` and ``<next/>``. Inside a text each gets one
backslash more than stands before it already, so that no text holds a bare control
string and taking one backslash away restores the text. A line feed stands between every
text and the control string after it, so a text's last backslash can't escape it. Merged
turns keep ``<next/>`` between them, so they can be told apart when read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, HEAD_END, NEXT, CLOSE = "### ", ":\n", "\n<next/>\n", "\n</turn>\n"
CONTROL = "###|</turn>|<next/>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def escape_role(role: Column) -> Column:
    for a, b in (("%", "%25"), (":", "%3A"), ("\n", "%0A")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def unescape_role(role: Column) -> Column:
    for a, b in (("%0A", "\n"), ("%3A", ":"), ("%25", "%")):
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def blocks_of(turns: DataFrame) -> DataFrame:
    """``conv_id, blocks``: arrays of (role, texts), texts of adjacent turns with one role together."""
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_ = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    begins = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]))
    framed = sorted_.withColumn("begins", begins)
    after = lambda k: F.when(k + 1 < F.size("begins"), F.get("begins", k + 1)).otherwise(F.size("turns") + 1)
    block = F.transform("begins", lambda b, k: F.struct(F.element_at("turns", b)["role"].alias("role"), F.transform(F.slice("turns", b, after(k) - b), lambda t: t["text"]).alias("texts")))
    return framed.select("conv_id", block.alias("blocks"))


def format_chats(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` of ``turns(conv_id, turn, role, text)``.

    ``loss_spans`` are (start, length) in code points, from 1, one for each text of the
    role ``learn_from``. Turns are sorted by turn, then role and text; null turns come
    first, a null role or text is empty, rows with a null conv_id are one conversation,
    repeated rows are turns of their own. Extra columns are ignored, and a table without
    rows gives none.
    """
    pieces = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t, k: F.struct(
        F.when(k == 0, F.concat(F.lit(HEAD), escape_role(b["role"]), F.lit(HEAD_END))).otherwise(F.lit(NEXT)).alias("before"),
        escape(t).alias("body"),
        F.when(k + 1 == F.size(b["texts"]), F.lit(CLOSE)).otherwise(F.lit("")).alias("after"),
        (b["role"] == learn_from).alias("learn")))))
    made = blocks_of(turns).withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["body"], p["after"])), "")
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["before"]) + F.length(p["body"]) + F.length(p["after"])).alias("at"),
            F.when(p["learn"], F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(p["before"])).alias("start"), F.length(p["body"]).cast("long").alias("length"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    return made.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.slice(F.split(formatted, CLOSE), 1, F.greatest(F.size(F.split(formatted, CLOSE)) - 1, F.lit(0)))
    role = lambda b: unescape_role(F.regexp_extract(b, rf"^{HEAD}([^\n]*?){HEAD_END}", 1))
    body = lambda b: F.regexp_replace(b, rf"^{HEAD}[^\n]*?{HEAD_END}", "")
    return F.flatten(F.transform(blocks, lambda b: F.transform(F.split(body(b), NEXT), lambda t: F.struct(role(b).alias("role"), unescape(t).alias("text")))))


def digest(turns: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations, as counts and digests."""
    made = format_chats(turns)
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["length"].cast("int")))), "")
    read = made.select("conv_id", read_back(F.col("formatted")).alias("turns"), learned.alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned"), 256).alias("loss_sha256"), "formatted_chars")
