"""Event-sourced chat reconstruction and rendering, in DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence. Each message folds its events: `message`, `edit`
and `regenerate` set its text anew, `delta` appends, `delete` removes it. Finished messages are rendered with a
template that marks turns; control strings within texts and roles are escaped reversibly, so the output can be read
back. The loss mask is the places of assistant texts in the output.

A null text or role is empty. Events of a message tie by kind and then text; turns are ordered by place, then message.
Repeated rows are events, or messages, of their own. A null conversation id is an id like others. An empty table gives
an empty result. Other columns are ignored. A conversation is one output row, so it is what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The template's control strings; a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<s>[INST]", "[/INST]", "</s>"
CONTROL = (("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]"))
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A text without control strings; the escape character itself is doubled."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, shown in CONTROL:
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return out


def unescape(text: Column) -> Column:
    """What escape was given. Doubled escape characters are split off first, so the rest can't be mistaken."""
    parts = F.split(text, "\\\\\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, place, message, role, text) of the messages that a log (conv_id, place, message, seq, event, role, text) ends with."""
    kind = F.coalesce(F.col("event"), F.lit("message"))
    row = F.struct("seq", kind.alias("event"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"), "place")
    grouped = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(row)).alias("log"))
    sets = F.filter("log", lambda e: e["event"] != "delta")
    numbered = grouped.withColumn("_last", F.coalesce(F.array_max(F.transform(F.col("log"), lambda e, i: F.when(e["event"] != "delta", i))), F.lit(0)))
    live = F.slice("log", F.col("_last") + 1, F.size("log"))
    first = F.coalesce(F.get(sets, F.lit(0)), F.get("log", F.lit(0)))
    told = numbered.select("conv_id", "message", first["place"].alias("place"), first["role"].alias("role"), F.get("log", F.col("_last"))["event"].alias("_state"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))
    return told.filter("_state <> 'delete'").drop("_state")


def starts(lengths: Column) -> Column:
    """The running sums before each of an array of lengths, in blocks so that long arrays stay cheap."""
    block = 256
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int")), lambda b: F.slice(lengths, b * block + 1, F.lit(block)))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def run(xs: Column, begin: Column) -> Column:
        first = F.struct(begin.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(xs, first, step, lambda a: a["out"])

    def all_of(bs: Column) -> Column:
        begins = run(F.transform(bs, total), F.lit(0).cast("long"))
        return F.flatten(F.zip_with(bs, begins, run))

    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.array(blocks), all_of)[0])


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of folded messages; spans are (start, end) in code points, end exclusive."""
    turn = F.struct("place", "message", F.col("role").alias("role"), F.col("text").alias("text"))
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = whole.withColumn("_shown", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss"))))
    parts = shown.withColumn("_parts", F.transform("_shown", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE), t["text"], F.lit(END))))
    placed = parts.withColumn("_at", starts(F.transform("_parts", lambda p: F.length(p).cast("long"))))
    before = len(OPEN) + len(CLOSE)
    spans = F.zip_with("_shown", "_at", lambda t, at: F.when(t["loss"], F.struct((at + before + F.length(t["role"])).alias("start"), (at + before + F.length(t["role"]) + F.length(t["text"])).alias("end"))))
    return placed.select("conv_id", F.array_join("_parts", "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Fold a log and render its conversations."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns, an array of (role, text), and loss_text, both from the rendered output alone."""
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        body = F.substring(p, len(OPEN) + 1, 2**31 - 1)
        role = F.substring_index(body, CLOSE, 1)
        return F.struct(unescape(role).alias("role"), unescape(body.substr(F.length(role) + len(CLOSE) + 1, F.length(body))).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": loss})


def message_log(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A table of finished messages as a log; rows that repeat a turn are messages of their own."""
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("place"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("place", "role", "text")
    return named.withColumn("message", F.row_number().over(order).cast("long")).withColumns({"seq": F.lit(0).cast("long"), "event": F.lit("message")})
