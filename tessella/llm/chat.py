"""Chat formatting whose output is parsed back before it is believed.

Grammar: ``<s>`` then turns.  A turn is ``[SYS]`` body ``[/SYS]`` (system), ``[INST]`` body
``[/INST]`` (user), body ``</s>`` (assistant), or ``[ROLE]`` name ``[/ROLE]`` body ``</s>`` (any
other role).  Bodies hold no control string, so one split finds the turns.  In a body ``\\\\``,
``\\(`` and ``\\{`` stand for ``\\``, ``[`` and ``<``; any other backslash stands for itself.

A conversation is first rendered as it is and parsed; if the recovered turns differ from the
source, the turns that do not survive alone are escaped; if they still differ, all are.  Escaped
bodies hold neither ``[`` nor ``<``, so the last form always parses back.

Turns are ordered by turn, role and text.  Null roles and texts count as empty, null
conversation ids are one conversation.  Repeated rows are turns of their own.  An empty table
gives an empty one.  One conversation is one output string, so its turns meet in one row; nothing
larger is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
CONTROL = r"<s>|</s>|\[/?(?:INST|SYS|ROLE)\]"
_CLOSE = r"\[/SYS\]|\[/INST\]|</s>"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\\\"), ("[", "\\("), ("<", "\\{")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(body: Column) -> Column:
    plain = lambda s: F.replace(F.replace(s, F.lit("\\("), F.lit("[")), F.lit("\\{"), F.lit("<"))
    return F.array_join(F.transform(F.split(body, r"\\\\"), plain), "\\")


def _turn(role: Column, body: Column) -> Column:
    return (
        F.when(role == "system", F.concat(F.lit("[SYS]"), body, F.lit("[/SYS]")))
        .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(body, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), body, F.lit("</s>")))
    )


def _render(turns: Column, body) -> Column:
    return F.concat(F.lit("<s>"), F.array_join(F.transform(turns, lambda t: _turn(t["role"], body(t))), ""))


def segments(formatted: Column) -> Column:
    """The turns of a formatted text as (role, head, body, tail): body is still escaped, head
    and tail are the characters before and after it."""
    parts = F.split(F.substr(formatted, F.lit(4)), _CLOSE)

    def one(s: Column) -> Column:
        name_end = F.instr(s, "[/ROLE]")
        other = s.startswith("[ROLE]") & (name_end > 0)
        role = (
            F.when(s.startswith("[SYS]"), "system").when(s.startswith("[INST]"), "user")
            .when(other, unescape(F.substr(s, F.lit(7), name_end - 7))).otherwise("assistant")
        )
        head = F.when(s.startswith("[SYS]"), 5).when(s.startswith("[INST]"), 6).when(other, name_end + 6).otherwise(0)
        tail = F.when(s.startswith("[SYS]"), 6).when(s.startswith("[INST]"), 7).otherwise(4)
        return F.struct(role.alias("role"), head.alias("head"), F.substr(s, head + 1).alias("body"), tail.alias("tail"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), one)


def parse(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text stands for."""
    return F.transform(segments(formatted), lambda s: F.struct(s["role"].alias("role"), unescape(s["body"]).alias("text")))


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points of every assistant body."""
    zero = F.struct(F.lit(3).alias("at"), F.expr("CAST(ARRAY() AS ARRAY<STRUCT<start: INT, length: INT>>)").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        start, n = acc["at"] + s["head"], F.length(s["body"])
        here = F.array(F.struct(start.alias("start"), n.alias("length")))
        return F.struct(
            (start + n + s["tail"]).alias("at"),
            F.when(s["role"] == "assistant", F.concat(acc["spans"], here)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(segments(formatted), zero, step, lambda acc: acc["spans"])


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    turns, said = F.col("turns"), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    one = grouped.select("conv_id", F.transform("rows", said).alias("turns"))
    plain = one.withColumn("plain", _render(turns, lambda t: t["text"]))
    alone = lambda t: parse(_render(F.array(t), lambda x: x["text"])) == F.array(t)
    some = _render(turns, lambda t: F.when(alone(t), t["text"]).otherwise(escape(t["text"])))
    safe = _render(turns, lambda t: escape(t["text"]))
    first = plain.withColumn("formatted", F.when(parse(F.col("plain")) == turns, F.col("plain")))
    second = first.withColumn("some", F.when(F.col("formatted").isNull(), some))
    done = second.select(
        "conv_id",
        F.when(F.col("formatted").isNotNull(), F.col("formatted")).when(parse(F.col("some")) == turns, F.col("some")).otherwise(safe).alias("formatted"),
    )
    return done.withColumn("loss_spans", loss_spans(F.col("formatted")))


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when read back: counts and digests per conversation."""
    text = F.col("formatted")
    bodies = F.transform("loss_spans", lambda s: unescape(F.substr(text, s["start"] + 1, s["length"])))
    read = formatted.withColumns({"turns": parse(text), "loss": F.array_join(bodies, "")})
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
