"""Chat formatting from event logs, in DataFrame operations only.

A log row is (conv_id, seq, turn, kind, role, text):

    message     opens the turn with this role and text, replacing what it held
    delta       appends its text to the turn
    edit        replaces the text of the turn
    regenerate  throws the text of the turn away; deltas that follow rebuild it

The template writes one turn as `### role: text</turn>\\n`. Inside roles and texts a
backslash is doubled and a backslash is put inside each control string, so no control
string of the template can stand in them and removing the backslashes gives the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

HEAD, END = "### ", "</turn>"
# possessive: matching does not go back, so a long role does not deepen the stack
_TURN = "(?s)^### ((?:[^\\\\:]++|\\\\.)*+): (.*+)$"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit(END), F.lit("<\\/turn>"))
    return F.replace(out, F.lit(HEAD), F.lit("#\\## "))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def fold_messages(events: DataFrame) -> DataFrame:
    """One row (conv_id, turn, role, text) per turn: events in the order of `seq`.

    Null role or text counts as empty, a null kind as a delta. Equal `seq` in a turn
    are ordered by kind, role and text, so repeated rows give a defined result. Rows
    without conv_id, turn or seq form groups of null like any other value. A turn
    whose last state is empty stays, as an empty message. Other columns are left out."""
    event = F.struct("seq", F.coalesce("kind", F.lit("delta")).alias("kind"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(event)).alias("log"))
    # the text starts anew at the last message, edit or regeneration; deltas after it are joined at once
    state = F.aggregate(
        "log", F.struct(F.lit("").alias("role"), F.lit(0).alias("at"), F.lit(0).alias("start")),
        lambda s, e: F.struct(
            F.when((e["kind"] == "message") | (s["role"] == ""), e["role"]).otherwise(s["role"]).alias("role"),
            (s["at"] + 1).alias("at"),
            F.when(e["kind"].isin("message", "edit"), s["at"]).when(e["kind"] == "regenerate", s["at"] + 1)
             .otherwise(s["start"]).alias("start")))
    said = F.transform(F.slice("log", F.col("s.start") + 1, F.size("log")), lambda e: e["text"])
    return log.withColumn("s", state).select(
        "conv_id", "turn", F.col("s.role").alias("role"), F.array_join(said, "").alias("text"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the rendered conversation and, for each turn
    of `loss_role`, struct(turn number from 0, start, length) of its text in code
    points of `formatted`.

    An empty log gives no row. A conversation is one output value, so its turns meet
    in one row; conversations are spread over all tasks."""
    turn = F.struct("turn", F.concat(F.lit(HEAD), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\:")),
                                     F.lit(": ")).alias("head"),
                    escaped(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss"))
    chats = fold_messages(events).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(END + "\n"))), "")
    sizes = F.transform("turns", lambda t, i: F.struct(
        t["loss"].alias("loss"), i.alias("turn"), F.length(t["head"]).cast("long").alias("head"),
        F.length(t["text"]).cast("long").alias("length")))
    tail = len(END) + 1
    spans = F.aggregate(
        sizes, F.struct(F.lit(0).cast("long").alias("at"),
                        F.array().cast("array<struct<turn:int,start:bigint,length:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + t["head"] + t["length"] + tail).alias("at"),
            F.when(t["loss"], F.concat(s["spans"], F.array(F.struct(
                t["turn"].alias("turn"), (s["at"] + t["head"]).alias("start"), t["length"].alias("length")))))
             .otherwise(s["spans"]).alias("spans")))
    return chats.select("conv_id", rendered.alias("formatted"), spans["spans"].alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The way back: (conv_id, turns, loss_texts, formatted) with turns as
    array<struct<role,text>> and the unescaped texts under the loss mask."""
    pieces = F.split("formatted", END + "\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.regexp_extract(p, _TURN, 1)).alias("role"), F.regexp_extract(p, _TURN, 2).alias("raw")))
    return (formatted.withColumn("parsed", turns)
            .select("conv_id", "formatted",
                    F.transform("parsed", lambda t: F.struct(t["role"].alias("role"), unescaped(t["raw"]).alias("text"))
                                ).alias("turns"),
                    # the mask names the turn and how much of it counts
                    F.transform("loss_spans", lambda s: unescaped(
                        F.substring(F.get(F.col("parsed"), s["turn"])["raw"], F.lit(1), s["length"].cast("int")))
                        ).alias("loss_texts")))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and SHA-256 digests of what `read_chats` returns."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
