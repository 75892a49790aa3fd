"""Chat formatting in budgeted windows; DataFrame expressions alone.

Prefix sums of the turns' tokens cut a conversation into windows at turn borders: each takes new turns up to its budget, after
the system turn and as much of the turns before as a smaller budget lets it repeat. The loss falls on new assistant turns; what
is repeated is masked. A turn is written ``<|role|>text<|end|>``; bars and backslashes within roles and texts are written \\p and
\\b, and in roles < is written \\l, since the mark's bar follows them, so that nothing said can look like a mark, and reading is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Estimated tokens of a window, of them at most HISTORY for repeated turns (other than the system turn); tokens of a turn's marks.
BUDGET, HISTORY, MARKS = 512, 128, 4
END = "<|end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("|"), F.lit("\\p"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\p"), F.lit("|")), F.lit("\\b"), F.lit("\\"))


def tokens(text: Column) -> Column:
    """Estimate: a token for every four characters begun, and those of the marks."""
    return (F.ceil(F.length(text) / 4) + MARKS).cast("bigint")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """A row for each window: conv_id, window (from 0), formatted, repeated (how many turns at its start are repeated) and loss
    (array of start and end, in characters of ``formatted``, of the texts that count for the loss).

    Defined results: rows of a conversation go by turn, then role, then text, nulls first; a null text or role is empty; a null
    conv_id is a conversation; a system turn counts as such if it comes first; a turn above the budget has a window to itself,
    which exceeds it; repeated rows are turns like any other; an empty table gives no rows; other columns are ignored. A
    conversation is put together in one row, which its digest needs anyway.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = F.struct("turn", "role", "text", F.concat(F.lit("<|"), escape_role(F.col("role")), F.lit("|>"), escape(F.col("text")), F.lit(END)).alias("written"), tokens(escape(F.col("text"))).alias("n"))
    c = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(made)).alias("turns"))
    # sums[i]: tokens of the first i turns
    c = c.withColumn("sums", F.aggregate("turns", F.array(F.lit(0).cast("bigint")), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t["n"]))))
    c = c.withColumn("system", F.when(F.element_at("turns", 1)["role"] == "system", 1).otherwise(0))
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.when(F.col("system") == 1, F.element_at("turns", 1)["n"]).otherwise(0))
    c = c.withColumn("room", room)
    # Greedy: a window starts at the first turn whose end lies beyond the room after the last start
    starts = F.aggregate(
        F.sequence(F.lit(0), F.size("turns") - 1),
        F.array(F.lit(0)),
        lambda a, i: F.when((i > F.element_at(a, -1)) & (F.element_at(F.col("sums"), i + 2) - F.element_at(F.col("sums"), F.element_at(a, -1) + 1) > F.col("room")), F.concat(a, F.array(i))).otherwise(a),
    )
    c = c.withColumn("starts", starts)

    def window(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("turns"))
        before = F.element_at(F.col("sums"), start + 1)
        # The earliest turn from which the history fits, the system turn apart
        old = F.size(F.filter(F.slice(F.col("sums"), F.lit(1), start), lambda s: before - s > history))
        old = F.greatest(old, F.least(F.col("system"), start))
        kept = F.when(start > 0, F.col("system")).otherwise(0)
        repeated = F.concat(F.slice("turns", F.lit(1), kept), F.slice("turns", old + 1, start - old))
        return F.struct(k.alias("window"), repeated.alias("old"), F.slice("turns", start + 1, end - start).alias("new"))

    rows = c.select("conv_id", F.explode(F.transform("starts", window)).alias("w")).select("conv_id", "w.*")
    written = F.array_join(F.transform(F.concat("old", "new"), lambda t: t["written"]), "")
    # Ends of the new turns in the formatted text, turn by turn
    first = F.length(F.array_join(F.transform("old", lambda t: t["written"]), "")).cast("bigint")
    ends = F.aggregate("new", F.array(first), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.length(t["written"]))))
    loss = F.filter(
        F.transform("new", lambda t, i: F.struct((F.element_at(ends, i + 1) + F.length(escape_role(t["role"])) + 4).alias("start"), (F.element_at(ends, i + 2) - len(END)).alias("end"), (t["role"] == "assistant").alias("counts"))),
        lambda s: s["counts"],
    )
    return rows.select("conv_id", "window", written.alias("formatted"), F.size("old").alias("repeated"), F.transform(loss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """From windows alone: conv_id, the turns as array of role and text, the texts under the loss, and the characters written."""
    marks = F.slice(F.split("formatted", r"<\|", -1), F.lit(2), F.lit(1 << 30))  # role|>text, then end|>, for each turn
    turns = F.filter(marks, lambda x, i: i % 2 == 0)
    new = F.slice(turns, F.col("repeated") + 1, F.size(turns) - F.col("repeated"))
    read = F.transform(new, lambda x: F.struct(unescape(F.substring_index(x, "|>", 1)).alias("role"), unescape(F.substring_index(x, "|>", -1)).alias("text")))
    lost = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    rows = formatted.select("conv_id", F.struct("window", read.alias("turns"), lost.alias("loss"), F.length("formatted").cast("bigint").alias("chars")).alias("w"))
    c = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return c.select("conv_id", F.flatten("ws.turns").alias("turns"), F.flatten("ws.loss").alias("loss"), F.aggregate("ws.chars", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("formatted_chars"))


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted windows hold, read back from them."""
    back = read_back(windows(conversations))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
