"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns get their place and their token prefix sum in two levels: inside chunks of ``CHUNK`` turn
numbers, then over the chunks' totals, so a very long conversation is spread over tasks. What the
budget leaves beside a conversation's system turn is cut into eighths: five are the stride of its
windows, one is the reserve, and two hold repeated history. A turn belongs to the window in whose
stride its first token falls; a turn that crosses the end of its stride by being longer than the
reserve gets a window of its own. Every later window repeats the system turn and the ``HISTORY``
turns before it (those within the reserve). So no window passes the budget but for a single turn
that does, or a turn of its own window that is longer than the stride. A system turn above seven
eighths of the budget cannot be repeated within it and is written once. Repeated turns are marked,
and only new assistant texts are under the loss mask: each target is trained on once.

A turn's tokens are a column of the input, or an estimate: a quarter of the written characters,
escapes included, and four for the marks. Texts in scripts without spaces take more tokens than
that; give their counts.

A turn is written ``<s>[INST]role[/INST]text</s>``, a repeated one ``<s><<REPEAT>>[INST]...``.
Inside roles and texts ``&`` becomes ``&amp;`` and the first character of a control string
``&lt;`` or ``&lb;``; undoing these in reverse order gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from geotransfer.llm.common import null_safe

CHUNK, HISTORY = 256, 2
BUDGET = 2048
CONTROLS = ["<s>", "</s>", "<<REPEAT>>", "[INST]", "[/INST]"]


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(("&lt;" if c[0] == "<" else "&lb;") + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&lb;", "["), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def tokens(text: Column) -> Column:
    """Estimated tokens of a written text: a quarter of its characters, and four for the marks."""
    return F.floor((F.length(escaped(text)) + 3) / 4).cast("bigint") + 4


def placed(df: DataFrame, conv: str, turn: str, role: str, text: str, n_tokens: str | None = None) -> DataFrame:
    """Rows with ``pos`` (from 1 in each conversation), ``n`` tokens, ``upto`` (prefix sum), window ``w``, the
    conversation's ``reserve`` and whether its system turn is repeated (``led``)."""
    text_ = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), text_.alias("text"),
                     (tokens(text_) if n_tokens is None else F.coalesce(F.col(f"`{n_tokens}`").cast("bigint"), tokens(text_))).alias("n"),
                     F.floor(F.col(f"`{turn}`") / CHUNK).alias("chunk"))
    inner = Window.partitionBy("conv", "chunk").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("r", F.count("*").over(inner)).withColumn("t", F.sum("n").over(inner))
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "chunk").agg(F.count("*").alias("rows"), F.sum("n").alias("sum")).select(
        "conv", "chunk", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows0"),
        F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum0"))
    joined = local.join(totals, null_safe(local, totals, ("conv", "chunk"))).select(
        local["conv"], "role", "text", "n", (F.col("r") + F.col("rows0")).alias("pos"), (F.col("t") + F.col("sum0")).alias("upto"))
    heads = joined.where((F.col("pos") == 1) & (F.col("role") == "system") & (F.col("n") <= BUDGET * 7 // 8)).select(
        F.col("conv").alias("c"), F.col("n").alias("system"))
    sized = joined.join(heads, F.col("conv").eqNullSafe(F.col("c")), "left").withColumns({
        "led": F.col("system").isNotNull(), "room": F.lit(BUDGET) - F.coalesce("system", F.lit(0))}).drop("c", "system")
    reserve = F.floor(F.col("room") / 8)
    stride = F.col("room") - 3 * reserve
    begin = F.floor((F.col("upto") - F.col("n")) / stride)
    crossing = F.floor((F.col("upto") - 1) / stride) > begin
    return sized.withColumns({"w": 2 * begin + (crossing & (F.col("n") > reserve)).cast("bigint"), "reserve": reserve}).drop("room")


def windows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            n_tokens: str | None = None) -> DataFrame:
    """``conv``, ``w``, ``formatted`` and ``loss`` (array of start from 0 and length, in characters).

    Rows are ordered by turn (null first), role and text; rows equal in all are neighbours and
    each is a turn. Null roles and texts are empty. Null conversation ids form one conversation.
    Turns stay whole, so a turn longer than the budget makes a window longer than it. ``n_tokens``
    names a column of token counts; where it is null the estimate stands in. An empty table gives
    no window. Extra columns are not read.
    """
    rows = placed(df, conv, turn, role, text, n_tokens)
    system = (F.col("pos") == 1) & F.col("led")
    first = rows.groupBy("conv", "w").agg(F.min("pos").alias("first")).where("first > 1").select(
        F.col("conv").alias("c"), F.col("w").alias("to"), "first",
        F.explode(F.array_distinct(F.filter(F.array(F.lit(1).cast("bigint"), *[F.col("first") - k for k in range(1, HISTORY + 1)]),
                                            lambda p: p >= 1))).alias("p"))
    history = (F.col("pos") >= F.col("first") - HISTORY) & (F.col("n") <= F.col("reserve"))
    again = rows.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("p"))).where(system | history).select(
        "conv", F.col("to").alias("w"), "pos", "role", "text", F.lit(True).alias("again"))
    members = rows.select("conv", "w", "pos", "role", "text", F.lit(False).alias("again")).unionByName(again)
    head = F.concat(F.lit("<s>"), F.when(F.col("again"), "<<REPEAT>>").otherwise(""), F.lit("[INST]"), escaped(F.col("role")),
                    F.lit("[/INST]"))
    blocks = members.select("conv", "w", "pos", "again", "role", head.alias("head"), escaped(F.col("text")).alias("body")
                            ).withColumn("block", F.concat("head", "body", F.lit("</s>")))
    inside = Window.partitionBy("conv", "w").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    spans = blocks.withColumn("at", F.coalesce(F.sum(F.length("block")).over(inside), F.lit(0)) + F.length("head"))
    target = (F.col("role") == "assistant") & ~F.col("again")
    return spans.groupBy("conv", "w").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(target, F.struct(F.col("at").alias("start"), F.length("body").alias("length"))))).alias("loss"))


def parsed(formatted: DataFrame) -> DataFrame:
    """``conv``, ``w``, ``turns`` (role, text, again) and ``targets`` (texts under the mask), read from the output."""
    pieces = F.filter(F.split("formatted", "</s>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        again = F.startswith(p, F.lit("<s><<REPEAT>>"))
        rest = F.substr(p, F.when(again, 20).otherwise(10))
        cut = F.instr(rest, "[/INST]")
        return F.struct(unescaped(F.substr(rest, F.lit(1), cut - 1)).alias("role"),
                        unescaped(F.substr(rest, cut + 7)).alias("text"), again.alias("again"))

    targets = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"])))
    return formatted.select("conv", "w", "formatted", F.transform(pieces, turn).alias("turns"), targets.alias("targets"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the output alone: turns and targets in order, and the characters written.

    A digest of a whole conversation needs its text in one value; it is gathered here and nowhere before.
    """
    own = F.filter("turns", lambda t: ~t["again"])
    per = parsed(formatted).select(
        "conv", F.size(own).alias("n"), F.length("formatted").alias("chars"),
        F.struct("w", F.array_join(F.transform(own, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
                 F.array_join("targets", "").alias("loss")).alias("part"))
    whole = per.groupBy("conv").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                    F.sort_array(F.collect_list("part")).alias("parts"))
    loss = F.array_join(F.transform("parts", lambda p: p["loss"]), "")
    return whole.select("conv", "n_turns", F.sha2(F.array_join(F.transform("parts", lambda p: p["said"]), ""), 256).alias("turns_sha256"),
                        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
