"""Chat formatting with budgeted windows, in DataFrame functions only.

A conversation is cut at turns into windows. Prefix sums of turn tokens choose the spans: a turn opens a new window when
the window's own turns would exceed the budget, and where a section of the conversation begins (each ``SECTION``
budgets), so that spans are chosen within a section at a time. Each window after the first starts with the
conversation's leading system turn and a limited history of the turns before it; what is repeated is never a target.
Turns stay rows of their own until a window's turns meet, which its budget bounds.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` a turn. In roles and texts, ``^`` is put after every ``<`` that ``|`` or
``^`` follows, so ``<|`` occurs in control strings alone; a line break in a role becomes ``<|nl|>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>\n", "<|nl|>"
#: Tokens (words and single other characters, one a turn at least) of a window's own turns, and of the history repeated
#: before them; and budgets of a section.
BUDGET = 512
HISTORY = 128
SECTION = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=[|^])", "<^")


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<^"), F.lit("<"))


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).cast("long")


def format_windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, n_repeated (leading turns repeated from before), n_turns (its own), formatted, loss.

    ``loss`` holds [start, end) code point ranges of ``formatted``: the escaped texts of the window's own assistant
    turns. Every turn is an own turn of exactly one window. Null texts and roles are empty; turns order by turn (nulls
    first), then role and text; repeated rows are repeated turns; a null conv_id is a conversation. A turn longer than
    the budget is a window of its own. Other columns are ignored.
    """
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    ).withColumn("n", F.greatest(token_count(F.col("text")), F.lit(1).cast("long")))
    # before: tokens of the turns before this one; back: the first turn whose history, up to this one, is within the
    # limit; led: whether the conversation has a system turn in front.
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(in_order) - 1).withColumn("led", F.first("role").over(in_order) == "system")
    rows = rows.withColumn("before", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    rows = rows.withColumn("back", F.min("pos").over(Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, 0)))
    section = F.floor(F.col("before") / (budget * SECTION)).alias("section")
    slim = F.struct("pos", "n", "before", "back", "led")
    sections = rows.groupBy("conv_id", section).agg(F.sort_array(F.collect_list(slim)).alias("ts"))

    # Places at which windows open, in one pass over a section: a turn that does not fit opens the next one.
    zero = F.struct(F.array().cast("array<int>").alias("opens"), F.lit(0).cast("long").alias("from"))

    def fit(acc: Column, t: Column) -> Column:
        opens = (F.size(acc["opens"]) == 0) | (t["before"] + t["n"] - acc["from"] > budget)
        here = F.concat(acc["opens"], F.array(t["pos"]))
        return F.struct(F.when(opens, here).otherwise(acc["opens"]).alias("opens"), F.when(opens, t["before"]).otherwise(acc["from"]).alias("from"))

    opens = F.aggregate("ts", zero, fit, lambda acc: acc["opens"])
    start, last = F.element_at("ts", 1)["pos"], F.element_at("ts", -1)["pos"]

    def span(a: Column, i: Column) -> Column:
        first = F.element_at("ts", a - start + 1)
        end = F.coalesce(F.try_element_at("opens", i + 2), last + 1)
        # Histories reach back over whole turns, not over the system turn, which is put first.
        return F.struct(a.alias("a"), end.alias("b"), F.greatest(first["back"], F.when(first["led"], 1).otherwise(0)).alias("first"), (first["led"] & (a > 0)).alias("lead"))

    spans = sections.withColumn("opens", opens).select("conv_id", F.explode(F.transform("opens", span)).alias("w")).select("conv_id", "w.*")
    spans = spans.withColumn("window", F.row_number().over(Window.partitionBy("conv_id").orderBy("a")) - 1)
    none = F.array().cast("array<int>")
    old = F.concat(F.when(F.col("lead"), F.array(F.lit(0))).otherwise(none), F.when(F.col("first") < F.col("a"), F.sequence("first", F.col("a") - 1)).otherwise(none))
    places = F.concat(old, F.sequence("a", F.col("b") - 1))
    members = spans.select(F.col("conv_id").alias("conv"), "window", "a", F.explode(places).alias("place"))
    texts = rows.select("conv_id", "pos", "role", "text")
    met = members.join(texts, F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("place") == F.col("pos")))
    whole = met.groupBy("conv_id", "window").agg(F.first("a").alias("a"), F.sort_array(F.collect_list(F.struct("pos", "role", "text"))).alias("ts"))
    spans = whole.select("conv_id", "window", F.filter("ts", lambda t: t["pos"] < F.col("a")).alias("old"), F.filter("ts", lambda t: t["pos"] >= F.col("a")).alias("own"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))

    def turns_text(a: Column) -> Column:
        return F.transform(a, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("target")))

    def joined(a: Column) -> Column:
        return F.array_join(F.transform(a, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")

    parts = spans.select("conv_id", "window", F.size("old").alias("n_repeated"), F.size("own").alias("n_turns"), joined(turns_text(F.col("old"))).alias("prefix"), turns_text(F.col("own")).alias("parts"))
    empty = F.struct(F.char_length("prefix").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("loss"))

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["head"])
        end = start + F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(p["target"], F.concat(acc["loss"], span)).otherwise(acc["loss"]).alias("loss"))

    return parts.select("conv_id", "window", "n_repeated", "n_turns", F.concat("prefix", joined(F.col("parts"))).alias("formatted"), F.aggregate("parts", empty, advance, lambda acc: acc["loss"]).alias("loss"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Conversations read back from formatted windows: conv_id, turns (array of role and text), targets (the texts under the loss), formatted_chars.

    A row holds a whole conversation, as it was before it was cut.
    """
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p.startswith(START))
    own = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces))
    body = F.transform(own, lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(
        body,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    targets = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    read = windows.select("conv_id", F.struct("window", turns.alias("turns"), targets.alias("targets"), F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    whole = read.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return whole.select(
        "conv_id",
        F.flatten(F.col("ws.turns")).alias("turns"),
        F.flatten(F.col("ws.targets")).alias("targets"),
        F.aggregate("ws.chars", F.lit(0).cast("long"), lambda acc, n: acc + n).alias("formatted_chars"),
    )
