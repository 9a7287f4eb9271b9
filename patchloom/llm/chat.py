"""Chat formatting in budgeted windows, in SQL functions only.

A turn is written ``<|im_start|>role``, a line end, the text, ``<|im_end|>`` and a line end. Signs
that could be read as control strings are escaped reversibly: any ``<``, backslashes, ``|`` gets
one more backslash, so no ``<|`` is left; in roles a backslash becomes ``\\s`` and a line end ``\\n``.

Prefix sums of turn tokens choose turn-aligned spans: what is left of the budget after the system
turn and the history is halved, turns that start in the same half go together, and a turn longer
than a half goes alone; so a window exceeds the budget only if a single turn does. Each later
window repeats the system turn and then up to ``history_turns`` turns, of up to ``history`` tokens,
that end the window before. Targets are the assistant texts; repeated turns are masked, so each
target counts once. Tokens are words, numbers and signs, counted by pattern.

With ``spans="longest"`` a window takes the longest run of turns that fits what is left after the
system turn and the history, which fills windows better; then what is gathered at once are 64 such
rooms of a conversation.

A conversation is sorted and summed as a stream within its partition; only windows, which the
budget bounds, are gathered.

Defined results: null texts and roles are empty; null turns come first; rows of one turn follow
role, then text; rows with a null conv_id make up one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"
BUDGET, HISTORY, HISTORY_TURNS = 512, 64, 2
#: Ways to choose spans, and the rooms of a stretch in which the longest runs are sought.
HALVES, LONGEST, ROOMS = "halves", "longest", 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _longest(rows: DataFrame) -> DataFrame:
    """Sets ``fresh`` where the longest run of turns that fits ``room`` starts.

    Prefix sums cut a conversation into stretches of ROOMS times the room, which bound what is
    gathered; a stretch is cut into runs from its first turn on, so only its last run is short.
    """
    stretch = F.floor((F.col("sum") - F.col("tokens")) / (F.col("room") * ROOMS)).alias("stretch")
    names = [c for c in rows.columns if c != "conv_id"]
    held = rows.groupBy("conv_id", stretch).agg(F.array_sort(F.collect_list(F.struct("n", *(c for c in names if c != "n")))).alias("turns"))
    begin = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("fresh"))

    def step(acc: Column, t: Column) -> Column:
        fits = (acc["used"] > 0) & (acc["used"] + t["tokens"] <= t["room"])
        used = F.when(fits, acc["used"] + t["tokens"]).otherwise(t["tokens"])
        return F.struct(used.alias("used"), F.concat(acc["fresh"], F.array((~fits).cast("int"))).alias("fresh"))

    held = held.withColumn("fresh", F.aggregate("turns", begin, step)["fresh"])
    out = held.select("conv_id", F.inline(F.arrays_zip("turns", F.col("fresh").alias("fresh"))))
    return out.select("conv_id", *(F.col("turns")[c].alias(c) for c in names), F.when(F.col("turns.n") == 1, 0).otherwise(F.col("fresh")).alias("fresh"))


def turns(conversations: DataFrame, budget: int, history: int, history_turns: int, spans: str = HALVES) -> DataFrame:
    """A row for each turn of each window: conv_id, window, place (order in it), repeated, role, text."""
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("tokens", (F.regexp_count("text", F.lit(TOKEN)) + 4).cast("long"))
    conv = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(
        "*",
        F.row_number().over(conv).alias("n"),
        F.sum("tokens").over(upto).alias("sum"),
        F.first(F.when(F.col("role") == "system", F.struct("role", "text", "tokens"))).over(upto).alias("system"),
    )
    left = F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))
    if spans == LONGEST:
        rows = _longest(rows.withColumn("room", F.greatest(F.lit(1), left)))
    else:
        room = F.greatest(F.lit(1), F.floor(left / 2))
        rows = rows.withColumn("half", F.floor((F.col("sum") - F.col("tokens")) / room)).withColumn("alone", (F.col("tokens") > room).cast("int"))
        rows = rows.withColumn("cut", 2 * F.sum("alone").over(upto) - F.col("alone"))
        fresh = F.coalesce((F.lag("half").over(conv) != F.col("half")) | (F.lag("cut").over(conv) != F.col("cut")), F.lit(False))
        rows = rows.withColumn("fresh", fresh.cast("int"))
    conv = Window.partitionBy("conv_id").orderBy("n")
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("window", F.sum("fresh").over(upto))
    rows = rows.withColumn("next", F.lead("window").over(conv))
    # The turns that end a window and start the one after it as history.
    back = Window.partitionBy("conv_id", "window").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.max("next").over(back).alias("after"), F.sum("tokens").over(back).alias("tail"), F.count(F.lit(1)).over(back).alias("from_end"))
    kept = (F.col("after") > F.col("window")) & (F.col("tail") <= history) & (F.col("from_end") <= history_turns)
    is_system = (F.col("n") == 1) & (F.col("role") == "system")
    part = lambda window, place, repeated, role, text: F.struct(
        window.cast("long").alias("window"), place.cast("long").alias("place"), F.lit(repeated).alias("repeated"), role.alias("role"), text.alias("text")
    )
    copies = F.array(
        part(F.col("window"), F.col("n"), False, F.col("role"), F.col("text")),
        F.when(kept & ~is_system, part(F.col("window") + 1, F.col("n"), True, F.col("role"), F.col("text"))),
        F.when((F.col("fresh") == 1) & F.col("system").isNotNull(), part(F.col("window"), F.lit(0), True, F.col("system.role"), F.col("system.text"))),
    )
    return rows.select("conv_id", F.inline(F.filter(copies, lambda c: c.isNotNull())))


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, spans: str = HALVES) -> DataFrame:
    """conv_id, window, formatted, loss (array of start, end in code points of formatted), repeated_turns."""
    rows = turns(conversations, budget, history, history_turns, spans)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    target = (F.col("role") == "assistant") & ~F.col("repeated")
    one = F.struct("place", "repeated", F.concat(head, body, F.lit(END + "\n")).alias("written"), F.length(head).alias("head"), F.length(body).alias("body"), target.alias("target"))
    windows = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + t["head"]
        span = F.struct(a.alias("start"), (a + t["body"]).alias("end"))
        return F.struct((acc["at"] + F.length(t["written"])).alias("at"), F.when(t["target"], F.concat(acc["loss"], F.array(span))).otherwise(acc["loss"]).alias("loss"))

    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda t: t["written"]), "").alias("formatted"),
        F.aggregate("turns", begin, step)["loss"].alias("loss"),
        F.size(F.filter("turns", lambda t: t["repeated"])).alias("repeated_turns"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text; without the repeated ones) and targets (texts under the mask), from formatted text."""
    written = F.split("formatted", r"<\|im_start\|>", -1)
    own = F.slice(written, F.col("repeated_turns") + 2, F.size(written))

    def turn(t: Column) -> Column:
        line = F.instr(t, "\n")
        text = F.substring(t, line + 1, F.length(t) - line - len(END) - 1)
        return F.struct(unescape_role(F.substring(t, F.lit(1), line - 1)).alias("role"), unescape(text).alias("text"))

    target = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return windows.select("conv_id", "window", F.transform(own, turn).alias("turns"), target.alias("targets"), F.length("formatted").cast("long").alias("chars"))
