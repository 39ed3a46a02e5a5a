"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log has one row an event: conv_id, seq, msg (message key within the conversation),
kind, role, text. Kinds, in order of seq (ties: kind, role, text):

* ``message``: the message begins with this role and text.
* ``delta``: text is appended.
* ``edit``: text replaces what the message holds.
* ``regenerate``: the message begins anew with this text (null: empty), and messages
  that began after it, before this event, leave the conversation.
* ``delete``: the message leaves.

Messages are folded one by one (their events sorted and folded, so a hot conversation
is dealt by message), then ordered by the seq of their first event within their
conversation and rendered:

    <|im_start|>ROLE newline TEXT <|im_end|> newline

Inside roles and texts a backslash is doubled, ``<|`` becomes ``<\\|`` and, in roles, a
newline becomes ``\\n``; so control strings stand only where the template put them, and
escapes are undone exactly. ``spans`` has a struct a turn: start and end (code points,
end exclusive) of the turn's escaped text in ``formatted``, and whether it is under the
loss mask (role in loss_roles).

Nulls: a null text is empty, a null role is empty, a null seq sorts first, a null
conv_id is a conversation of its own. Unknown kinds count as ``message`` without one
before, and change nothing after one. Messages whose first event is not a ``message``
begin there with an empty role. An empty log gives no rows. The rendered conversation
is one row, as its digest is over all of it; that row is the bound on memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column, line: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if line else c


def unescape(c: Column, line: bool = False) -> Column:
    def rest(x: Column) -> Column:
        x = F.replace(x, F.lit("\\|"), F.lit("|"))
        return F.replace(x, F.lit("\\n"), F.lit("\n")) if line else x

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), rest), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at, role, text): the final messages, at the seq of their first event."""
    e = events.select("conv_id", "seq", "msg", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = e.groupBy("conv_id", "msg").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log"))
    log = F.col("log")
    live = F.coalesce(F.array_max(F.transform(log, lambda x, i: F.when(x["kind"].isin("edit", "regenerate") | (i == 0), i))), F.lit(0))
    text = F.array_join(F.transform(F.filter(log, lambda x, i: (i == live) | ((i > live) & (x["kind"] == "delta"))), lambda x: x["text"]), "")
    role = F.coalesce(F.element_at(F.filter(log, lambda x: x["kind"] == "message"), 1)["role"], F.element_at(log, 1)["role"])
    again = F.array_max(F.transform(F.filter(log, lambda x: x["kind"] == "regenerate"), lambda x: x["seq"]))
    folded = grouped.select("conv_id", "msg", F.element_at(log, 1)["seq"].alias("at"), role.alias("role"), text.alias("text"), again.alias("again"), F.exists(log, lambda x: x["kind"] == "delete").alias("gone"))
    before = Window.partitionBy("conv_id").orderBy("at", "msg").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.max("again").over(before)
    return folded.withColumn("cut", cut).where("not gone and (cut is null or at is null or cut < at)").select("conv_id", "at", "msg", "role", "text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n_turns, formatted, spans)."""
    m = messages.select("conv_id", "at", "msg", F.col("role").isin(*loss_roles).alias("loss"), F.concat(F.lit(START), escape(F.col("role"), True), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + F.lit(len(END))
    past = Window.partitionBy("conv_id").orderBy("at", "msg").rowsBetween(Window.unboundedPreceding, 0)
    m = m.withColumn("stop", F.sum(size).over(past) - F.lit(len(END)))
    turn = F.struct("at", "msg", F.concat("head", "body", F.lit(END)).alias("piece"), F.struct((F.col("stop") - F.char_length("body")).alias("start"), F.col("stop").alias("end"), "loss").alias("span"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return g.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), F.transform("t", lambda x: x["span"]).alias("spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text), read back from formatted, and loss_text, the unescaped text under the mask."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        return F.struct(unescape(F.substring(head, len(START) + 1, 2147483647), True).alias("role"), unescape(F.substr(p, F.char_length(head) + 2)).alias("text"))

    def masked(p: Column, i: Column) -> Column:
        span = F.element_at("spans", i + 1)
        begin = F.when(i == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(i, F.lit(1)))["end"] + len(END))
        return F.when(span["loss"], unescape(F.substr(p, (span["start"] - begin + 1).cast("int"), (span["end"] - span["start"]).cast("int")))).otherwise(F.lit(""))

    out = formatted.withColumn("pieces", pieces)
    return out.withColumn("turns", F.transform("pieces", turn)).withColumn("loss_text", F.array_join(F.transform("pieces", masked), "")).drop("pieces")


def digests(parsed: DataFrame) -> DataFrame:
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def rows_to_events(conversations: DataFrame) -> DataFrame:
    """The log of a table of turns: every row begins a message, whose text then streams in as one delta.

    Rows are numbered by turn, then role and text, so repeated turns stay apart.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("msg"))
    kinds = F.explode(F.array(F.struct(F.lit("message").alias("kind"), (2 * F.col("msg")).alias("seq"), F.lit("").alias("part")), F.struct(F.lit("delta").alias("kind"), (2 * F.col("msg") + 1).alias("seq"), F.col("text").alias("part"))))
    return numbered.select("conv_id", "msg", "role", kinds.alias("e")).select("conv_id", "msg", "role", "e.kind", "e.seq", F.col("e.part").alias("text"))
