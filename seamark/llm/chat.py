"""Chat formatting with a verified round trip, in DataFrame functions alone.

Grammar of one conversation (a sequence of turns):

    turn  := "### " role ": " body "\\n</turn>\\n"
    role  := "User" | "Assistant" | "System" | "=" hex-digits
    body  := any text in which each control string ("###" or "</turn>") has at
             least one backslash before it

A body is escaped by one more backslash before every control string, with or
without backslashes already there, and unescaped by taking one away; so any text
comes back. Every conversation is reparsed as a whole and compared with its
source turns; one that doesn't come back is an error, never a silent loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "\n</turn>\n"
#: Roles with a name of their own in the header.
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\*(?:###|</turn>))", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*(?:###|</turn>))", "$1")


def role_name(role: Column) -> Column:
    """Header form of a role: known ones by name, any other as ``=`` and the hex digits of its UTF-8."""
    out = F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8")))
    for k, v in NAMES.items():
        out = F.when(role == k, v).otherwise(out)
    return out


def role_of(name: Column) -> Column:
    out = F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")
    for k, v in NAMES.items():
        out = F.when(name == v, k).otherwise(out)
    return out


def render_turn(name: Column, body: Column) -> Column:
    return F.concat(F.lit(OPEN), name, F.lit(": "), body, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted conversation: the deterministic parser.

    Inside a body no control string stands without a backslash, so the closing
    line and the next header cut the text in one way only.
    """
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: F.length(t) > 0)

    def one(t: Column) -> Column:
        colon = F.instr(t, ": ")
        name = t.substr(F.lit(len(OPEN) + 1), colon - F.lit(len(OPEN) + 1))
        return F.struct(role_of(name).alias("role"), unescape(t.substr(colon + 2, F.length(t))).alias("text"))

    return F.transform(turns, one)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each ``conv_id`` of ``turns (conv_id, turn, role, text)``.

    Columns: ``conv_id``, ``formatted``, ``loss_spans array<struct<start,len>>``
    (0-based code points of each body of ``loss_role`` within ``formatted``),
    ``n_escaped`` turns. Rows go by turn (null first), ties by role and text;
    repeated rows are turns of their own. Null text and null role: empty.
    A null conv_id is a conversation of its own. Empty table: no rows. A
    conversation is one output value, so its turns do meet in one task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.withColumn("name", role_name(F.col("role")))
    raw = ~F.contains("text", F.lit("###")) & ~F.contains("text", F.lit("</turn>"))
    t = t.withColumn("raw", raw).withColumn("body", F.when(F.col("raw"), F.col("text")).otherwise(escape(F.col("text"))))
    t = t.withColumn("out", render_turn(F.col("name"), F.col("body")))
    t = t.select("conv_id", F.struct("turn", "role", "text", "out", (F.length("name") + len(OPEN) + 2).alias("head"), F.length("body").alias("len"), "raw").alias("t"))
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = F.concat_ws("", F.transform("t", lambda x: x["out"]))
    # the round trip: the parser's turns of the whole conversation are its source's
    source = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    out = F.when(parse(whole) == source, whole).otherwise(F.raise_error(F.lit("a conversation does not come back from its rendered text")))
    sizes = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["out"])).alias("at"),
            F.when(x["role"] == loss_role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), x["len"].alias("len"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return g.select("conv_id", out.alias("formatted"), sizes["spans"].alias("loss_spans"), F.size(F.filter("t", lambda x: ~x["raw"])).alias("n_escaped"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(formatted.substr(s["start"] + 1, s["len"]))))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the output gets back: the digest columns of each conversation."""
    f = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    said = F.concat_ws("", F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    return f.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
