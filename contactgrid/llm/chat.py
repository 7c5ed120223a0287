"""Chat formatting in budgeted windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The control strings of the template.
BEGIN, HEAD, HEAD_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
#: What follows the first character of a control string.
_REST = r"(?=/?s>|/?INST\])"
#: A token, as the budget counts: a run of letters, a digit, or any other character but white space.
TOKEN = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]"
#: Control tokens of a turn.
MARKS = 3


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one into each control string, so that none is left."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])" + _REST, r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\" + _REST, "$1"), F.lit("\\\\"), F.lit("\\"))


def format_windows(turns: DataFrame, budget: int = 768, history_tokens: int = 192, history_turns: int = 2) -> DataFrame:
    """Conversations as training windows: conv_id, window (from 0), formatted, n_context, n_tokens, loss.

    A turn is [INST]role[/INST]text</s>, a window <s> and its turns. Running sums of turn tokens deal a
    conversation's turns to slots of what the budget leaves beside the system turn and the history; turns
    within one slot are a span, a turn across slots is a span of its own. A window is the system turn, as
    many of the last turns before its span as history_turns and history_tokens allow, and its span. Its
    first n_context turns are such repeats; loss has the [start, end) places, in code points, of the text of
    the span's assistant turns, so that each is trained on once. A system turn of over half the budget, or
    a single turn of more than the budget, makes a longer window: no turn is cut.

    Turns are ordered by turn, then role, then text; nulls first. Null text or role: empty. Equal rows are
    turns of their own. Null conv_id: one conversation. Other columns play no part. No rows: no rows.
    One shuffle, by conv_id; what follows keeps its partitioning.
    """
    one = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("place", F.row_number().over(one)).withColumn("tokens", F.regexp_count("text", F.lit(TOKEN)) + MARKS)
    t = t.withColumn("end", F.sum("tokens").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(HEAD_END))
    body = escape(F.col("text"))
    t = t.withColumn("piece", F.concat(head, body, F.lit(TURN_END))).withColumn("skip", F.length(head)).withColumn("chars", F.length(body))
    turn = F.struct("place", "tokens", "piece")
    t = t.withColumn("system", F.first(F.when(F.col("role") == "system", turn), ignorenulls=True).over(whole))
    room = budget - history_tokens - F.least(F.coalesce("system.tokens", F.lit(0)), F.lit(budget // 2))
    t = t.withColumn("slot", F.floor((F.col("end") - F.col("tokens")) / room)).withColumn("last_slot", F.floor((F.col("end") - 1) / room))
    t = t.withColumn("across", F.col("slot") != F.col("last_slot"))
    turned = (F.lag("slot").over(one) != F.col("slot")) | (F.lag("across").over(one) != F.col("across"))
    t = t.withColumn("turned", F.coalesce(turned, F.lit(False)).cast("int"))
    t = t.withColumn("window", F.sum("turned").over(one.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    t = t.withColumn("chars_end", F.sum(F.length("piece")).over(one.rowsBetween(Window.unboundedPreceding, 0)))
    past, used = [], F.lit(0)
    for k in range(1, history_turns + 1):
        before = F.lag(turn, k).over(one)
        used = used + before["tokens"]
        past.insert(0, F.when((used <= history_tokens) & ~F.coalesce(before["place"] == F.col("system.place"), F.lit(False)), before["piece"]))
    t = t.withColumn("past", F.filter(F.array(*past), lambda x: x.isNotNull()))
    first_system = F.when(F.col("system.place") < F.col("place"), F.array("system.piece")).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("context", F.concat(first_system, "past"))
    own = F.struct("place", "piece", "skip", "chars", "chars_end", "tokens", (F.col("role") == "assistant").alias("target"))
    w = t.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(own)).alias("own"), F.min_by("context", "place").alias("context"))
    w = w.withColumn("lead", F.concat(F.lit(BEGIN), F.array_join("context", "")))
    w = w.withColumn("base", F.length("lead") - F.col("own")[0]["chars_end"] + F.length(F.col("own")[0]["piece"]))
    start = lambda x: F.col("base") + x["chars_end"] - F.length(x["piece"]) + x["skip"]
    spans = F.transform(F.filter("own", lambda x: x["target"]), lambda x: F.struct(start(x).alias("start"), (start(x) + x["chars"]).alias("end")))
    return w.select(
        "conv_id", "window",
        F.concat("lead", F.array_join(F.transform("own", lambda x: x["piece"]), "")).alias("formatted"),
        F.size("context").alias("n_context"),
        (F.regexp_count(F.array_join("context", ""), F.lit(TOKEN)) + F.aggregate("own", F.lit(0), lambda a, x: a + x["tokens"])).cast("long").alias("n_tokens"),
        spans.alias("loss"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """What windows hold, from their text and loss places alone: conv_id, window, turns (role, text; without repeats), targets."""
    parts = F.split(F.substring(F.col("formatted"), len(BEGIN) + 1, 2**31 - 1), TURN_END, -1)
    parts = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(part: Column) -> Column:
        role_text = F.split(F.substring(part, len(HEAD) + 1, 2**31 - 1), r"\[/INST\]", -1)
        return F.struct(unescape(role_text[0]).alias("role"), unescape(role_text[1]).alias("text"))

    targets = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), x["start"].cast("int") + 1, (x["end"] - x["start"]).cast("int"))))
    return windows.withColumn("turns", F.transform(parts, turn)).withColumn("targets", targets)


def conversation_digests(windows: DataFrame) -> DataFrame:
    """A row for each conversation: counts and SHA-256 of what its windows give back."""
    said = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    w = read_windows(windows).select(
        "conv_id", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", said), "").alias("said"),
        F.array_join("targets", "").alias("loss"), F.length("formatted").alias("chars"),
    )
    c = w.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "said", "loss"))).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    joined = lambda f: F.array_join(F.transform("w", lambda x: x[f]), "")
    return c.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(joined("said"), 256).alias("turns_sha256"),
        F.length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
