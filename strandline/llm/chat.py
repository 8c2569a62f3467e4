"""Chat formatting in budgeted windows, as DataFrame expressions only.

Prefix sums of turn tokens put each turn into one window; a window repeats the system turn and a limited
stretch of the turns before it, and only assistant texts that are new in it carry loss.

The template, of every window: ``<s>``, then for each turn ``[TURN]``, the role (percent-encoded), a line
feed, the text and ``</s>``.  A control string inside a text gets a backslash behind its first character,
one that has backslashes there gets one more, and reading takes one away: nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.text import words

START, TURN, END = "<s>", "[TURN]", "</s>"
#: What follows the first character of the control strings <s> </s> [INST] [/INST] [TURN] <<SYS>> <</SYS>>.
_REST = r"(s>|/s>|INST\]|/INST\]|TURN\]|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<|\[)\\(\\*)" + _REST, "$1$2$3")


def windows(rows: DataFrame, budget: int = 512, history_turns: int = 2, history_tokens: int = 128, overhead: int = 4) -> DataFrame:
    """(conv_id, window, formatted, n_turns, n_repeated, loss): one row per window of each conversation.

    A turn weighs its words plus ``overhead``; new turns get what the system turn and ``history_tokens``
    leave of ``budget``.  Windows break between turns only, so a longer turn stands alone and over budget
    rather than being cut.  ``n_repeated`` leading turns are context; ``loss`` lists (start, length) in code
    points of ``formatted``.

    Rows of a conversation are taken by turn (null first), ties by role, then text; repeated rows are
    turns of their own.  A null role or text is empty, null conv_ids are one conversation, and a system
    row counts as the system turn only where it comes first.  A conversation's prefix sums run in one
    task, in a sort that spills; its windows are built in many.  An empty table gives an empty result;
    other columns are not read.
    """
    by_turn = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", F.size(words(F.col("text"))) + overhead)
    rows = rows.withColumn("idx", F.row_number().over(by_turn))
    system = (F.col("idx") == 1) & (F.col("role") == "system")
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumns(
        {
            "system": system,
            "room": F.greatest(F.lit(1), F.lit(budget - history_tokens) - F.first(F.when(system, F.col("tokens")).otherwise(0)).over(by_turn)),
            "before": F.coalesce(F.sum(F.when(system, 0).otherwise(F.col("tokens"))).over(by_turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    rows = rows.withColumn("raw", F.floor(F.col("before") / F.col("room")))
    rows = rows.withColumn("new", F.coalesce((F.col("raw") != F.lag("raw").over(by_turn)).cast("int"), F.lit(0)))
    rows = rows.withColumn("window", F.sum("new").over(by_turn.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns(
        {
            "next": F.collect_list(F.struct("window", "before")).over(by_turn.rowsBetween(1, history_turns)),
            "last": F.max("window").over(whole),
        }
    )
    again = F.transform(F.filter("next", lambda x: (x["window"] != F.col("window")) & (x["before"] - F.col("before") <= history_tokens)), lambda x: x["window"])
    spread = F.when(F.col("system"), F.sequence(F.lit(0).cast("long"), F.col("last"))).otherwise(F.array_distinct(F.concat(F.array("window"), again)))
    shown = rows.withColumn("shown", F.explode(spread))
    turn = F.struct("idx", F.concat(F.lit(TURN), F.url_encode("role"), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("shown") != F.col("window")).alias("repeat"), ((F.col("role") == "assistant") & (F.col("shown") == F.col("window"))).alias("loss"))
    out = shown.groupBy("conv_id", F.col("shown").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    text = F.concat(F.lit(START), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), ""))

    def step(state: Column, t: Column) -> Column:
        at = state["at"] + F.length(t["head"])
        size = F.length(t["body"])
        spans = F.when(t["loss"], F.concat(state["spans"], F.array(F.struct(at.alias("start"), size.alias("length"))))).otherwise(state["spans"])
        return F.struct((at + size + len(END)).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(len(START)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    repeated = F.size(F.filter("turns", lambda t: t["repeat"]))
    return out.select("conv_id", "window", text.alias("formatted"), F.size("turns").alias("n_turns"), repeated.alias("n_repeated"), F.aggregate("turns", zero, step, lambda s: s["spans"]).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` plus ``turns array<struct<role,text>>`` (new turns only, parsed) and ``loss_text`` (unescaped)."""
    parts = F.split("formatted", r"\[TURN\]")
    parts = F.slice(parts, F.col("n_repeated") + 2, F.size(parts))
    head = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substring(x, F.length(head(x)) + 2, F.length(x) - F.length(head(x)) - 1 - len(END))
    turns = F.transform(parts, lambda x: F.struct(F.url_decode(head(x)).alias("role"), unescape(body(x)).alias("text")))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})
