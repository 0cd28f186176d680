"""Chat formatting in budgeted windows of whole turns.

A token is a run of up to six letters, of up to three digits, or one other
visible character; exact counts of a tokenizer may be given in their place.
Prefix sums of the turns' tokens put every turn on a line, which is cut into
cells of the room that the system turn leaves. The turns that lie in a cell are
a span of at most that room; a turn across a border goes before those of the
cell that it ends in if all of it fits, else it is a span of its own. So spans
are turn-aligned, no turn waits for the end of the one before to be known, and
only a single turn longer than the room makes a window exceed the budget.

A window shows its span's turns as new ones. It repeats the system turn, then
the last turns before its span as far as the history limit and the budget go;
only new assistant turns are under the loss mask, so each is a target once. A
system turn of over three quarters of the budget isn't repeated and counts as
any other turn; windows stay in the budget without it. Turns are never cut.

    ### role: text</turn>

is a turn. In roles and texts, `\\`, `#`, `<` (in roles also `:`) become `\\b`,
`\\h`, `\\l` (`\\c`), so no text holds a control string, and back again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, MIDDLE, END = "### ", ": ", "</turn>\n"
CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
BLOCK = 512
TOKEN = r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
#: A system turn that leaves less of the budget isn't repeated.
LEAST_ROOM = 0.25


def escape(text: Column, codes: tuple = CODES[:3]) -> Column:
    for raw, code in codes:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def near_spans(rows: DataFrame, history: int) -> DataFrame:
    """_c, _cell, spans: the spans that turns of a cell may stand in, new or
    repeated: at most two of the cell itself and of each of the two after it."""
    part = lambda across, c: F.when(F.col("across") == F.lit(across), F.col(c))
    ends = [F.min(part(True, "start")).alias("a0"), F.max(part(True, "end")).alias("a1"), F.min(part(False, "start")).alias("i0"), F.max(part(False, "end")).alias("i1")]
    cells = rows.groupBy("conv_id", "cell").agg(*ends, F.first("room").alias("room"))
    fits = F.coalesce(F.col("i1") - F.col("a0") <= F.col("room"), F.lit(False))
    limit = lambda first, last: F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - (last - first)))
    span = lambda n, first, last: F.named_struct(F.lit("window"), 2 * F.col("cell") + n, F.lit("first"), first, F.lit("last"), last, F.lit("limit"), limit(first, last))
    across = F.when(F.col("a0").isNotNull(), span(0, F.col("a0"), F.when(fits, F.col("i1")).otherwise(F.col("a1"))))
    inside = F.when(F.col("i0").isNotNull() & ~fits, span(1, F.col("i0"), F.col("i1")))
    held = cells.withColumn("s", F.array_compact(F.array(across, inside)))
    held = held.select(F.col("conv_id").alias("_c"), F.explode(F.array(*[F.col("cell") - i for i in range(3)])).alias("_cell"), "s")
    return held.groupBy("_c", "_cell").agg(F.flatten(F.collect_list("s")).alias("spans"))


def windows(conversations: DataFrame, budget: int = 512, history: int = 128, tokens: str | None = None) -> DataFrame:
    """conv_id, window, formatted, repeated (turns at its start that other
    windows have as new ones), loss (array of start, length in code points).

    Rows are turns, in order of turn, then role and text; nulls there count as
    empty, or as first for turn. Rows of a null conv_id form one conversation.
    Repeated rows are turns of their own. A system turn counts as such if it is
    the first turn. `tokens` names a column of exact token counts of the
    formatted turns. An empty table gives no rows; other columns are not read.
    """
    given = F.lit(None).cast("long") if tokens is None else F.col(tokens).cast("long")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), given.alias("tokens"))
    shown = F.concat(F.lit(START), escape(F.col("role"), CODES), F.lit(MIDDLE), escape(F.col("text")), F.lit(END))
    rows = rows.withColumn("shown", shown).withColumn("tokens", F.greatest(F.lit(1), F.coalesce("tokens", F.regexp_count("shown", F.lit(TOKEN)))).cast("long"))
    firsts = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens", "shown")).alias("f"))
    lead = (F.col("f.role") == "system") & (F.col("f.tokens") <= budget * (1 - LEAST_ROOM))
    firsts = firsts.select(F.col("conv_id").alias("_conv"), F.when(lead, F.struct("f.tokens", "f.shown")).alias("system"))
    # prefix sums inside blocks of turns, then over the blocks: no conversation is sorted in one task
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    sums = rows.groupBy("conv_id", "block").agg(F.sum("tokens").alias("sum"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    # the system turn comes to the blocks of a conversation, and with them to its rows
    sums = sums.join(firsts, F.col("_c").eqNullSafe(F.col("_conv"))).drop("_conv")
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("tokens").over(order)).join(sums, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b")))
    rows = rows.withColumn("end", F.col("before") + F.col("end")).withColumn("start", F.col("end") - F.col("tokens")).drop("_c", "_b", "before")
    rows = rows.withColumn("room", F.lit(budget) - F.coalesce("system.tokens", F.lit(0)))
    rows = rows.withColumn("cell", F.floor((F.col("end") - 1) / F.col("room"))).withColumn("across", F.col("start") < F.col("cell") * F.col("room"))
    spans = near_spans(rows, history)
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("cell") == F.col("_cell"))).drop("_c", "_cell")
    own = lambda s: (s["first"] <= F.col("start")) & (F.col("end") <= s["last"])
    before = lambda s: (F.col("start") < s["first"]) & (s["first"] - F.col("start") <= s["limit"])
    rows = rows.withColumn("span", F.explode(F.filter("spans", lambda s: own(s) | before(s)))).drop("spans")
    rows = rows.withColumn("fresh", F.col("start") >= F.col("span.first")).withColumn("window", F.col("span.window"))
    # the system turn stands in front of every window that doesn't hold it as a new turn
    rows = rows.filter(F.col("fresh") | F.col("system").isNull() | (F.col("start") > 0))
    target = F.when(F.col("fresh") & (F.col("role") == "assistant"), F.length(F.concat(F.lit(START), escape(F.col("role"), CODES), F.lit(MIDDLE))))
    turn = F.struct("start", "shown", "fresh", target.alias("skip"))
    held = rows.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.first("system").alias("system"))
    system = F.struct(F.lit(-1).cast("long").alias("start"), F.col("system.shown").alias("shown"), F.lit(False).alias("fresh"), F.lit(None).cast("int").alias("skip"))
    lead = F.col("system").isNotNull() & (F.get("turns", F.lit(0))["start"] > 0)
    held = held.withColumn("turns", F.when(lead, F.concat(F.array(system), F.col("turns"))).otherwise(F.col("turns")))
    none = F.array().cast("array<struct<start:int,length:int>>")
    span = lambda at, t: F.struct((at + t["skip"]).alias("start"), (F.length(t["shown"]) - t["skip"] - len(END)).alias("length"))
    step = lambda s, t: F.struct((s["at"] + F.length(t["shown"])).alias("at"), F.when(t["skip"].isNotNull(), F.concat(s["loss"], F.array(span(s["at"], t)))).otherwise(s["loss"]).alias("loss"))
    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), none.alias("loss")), step, lambda s: s["loss"])
    return held.select(
        "conv_id", "window", F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda t: ~t["fresh"])).alias("repeated"), loss.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the new turns), targets
    (texts under the loss mask), n_chars, from the formatted windows alone."""
    parts = F.split("formatted", END, -1)
    own = F.slice(parts, F.col("repeated") + 1, F.greatest(F.size(parts) - 1 - F.col("repeated"), F.lit(0)))
    middle = lambda p: F.instr(p, MIDDLE)
    turn = lambda p: F.struct(unescape(F.substring(p, F.lit(len(START) + 1), middle(p) - len(START) - 1)).alias("role"), unescape(F.substring(p, middle(p) + len(MIDDLE), F.length(p))).alias("text"))
    text = F.col("formatted")
    targets = F.transform("loss", lambda s: unescape(F.substring(text, s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "window", F.transform(own, turn).alias("turns"), targets.alias("targets"), F.length("formatted").alias("n_chars"))
