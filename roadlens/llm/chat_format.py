"""Chat formatting in budgeted windows (operator 12); DataFrame functions only.

Each conversation becomes training texts of at most ``budget`` tokens.  Prefix sums of the turns'
tokens choose the spans: with a cell of half the budget, a turn belongs to the cell in which its
last token lies, and a cell's turns are one span; a turn that begins before its cell is a span of
its own if the cell would hold more than its size.  So every turn is fresh in exactly one window,
windows need no greedy walk, and a conversation of any length is formatted in parallel.

A window begins with the conversation's system turn (its first turn, if that is its role), goes on
with up to ``history_turns`` turns before the span, as far as they fit in ``history_tokens`` and in
what is left of the budget, and ends with the span.  What is repeated is context: the loss mask
(spans of code points) covers the texts of the span's assistant turns only, so each is learnt once.
A window is longer than the budget only if one turn, or the system turn, is longer than a cell.

Template:  <turn ROLE>TEXT</turn>\\n .  Inside a text a backslash goes between ``<`` and what would
follow it in a mark (more backslashes allowed between), in a role ``\\``, ``<`` and ``>`` become
``\\s``, ``\\l`` and ``\\g``; ``read_back`` undoes both.  A turn costs its words, digits and other
marks, and ``MARKS`` for the template.

Places and prefix sums come from a range partition by (conversation, turn); one row per partition
(its first and last conversation) goes to the driver.  Windows are keyed by (conversation, cell),
and copies of a system turn by (conversation, cells / 64), so no conversation is one task.

Edge cases: null texts and roles are empty, null turns come first, rows of one turn in the order
of role and text hash, rows without a conversation id form one; repeated rows are turns of their
own; an empty text has no loss characters; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import cut

TOKEN = "[A-Za-z]+|[0-9]|[^A-Za-z0-9\\x00-\\x20]"
MARKS = 4
SALT_CELLS = 64
END = "</turn>\n"


def escaped_text(col: Column) -> Column:
    return F.regexp_replace(col, "<(\\\\*/?turn)", "<\\\\$1")


def unescaped_text(col: Column) -> Column:
    return F.regexp_replace(col, "<\\\\(\\\\*/?turn)", "<$1")


def escaped_role(col: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("<", "\\l"), (">", "\\g")):
        col = F.replace(col, F.lit(plain), F.lit(code))
    return col


def unescaped_role(col: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\s")):
        col = F.replace(col, F.lit(code), F.lit(plain))
    return col


def open_mark(role: Column) -> Column:
    return F.concat(F.lit("<turn "), escaped_role(role), F.lit(">"))


def prefix_sums(turns: DataFrame) -> DataFrame:
    """Adds rank (place in the conversation) and upto (tokens up to and with the turn)."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "_same", "_row")]
    tagged = turns.withColumn("_same", F.xxhash64("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = cut(tagged.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                 .select("conv", "role", "text", "cost", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    runs = placed.groupBy("_part", "conv").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))
    held = runs.groupBy("_part").agg(F.min(F.struct("conv", "n", "cost")).alias("first"),
                                     F.max(F.struct("conv", "n", "cost")).alias("last")).orderBy("_part").collect()
    rows, open_conv, n_before, cost_before = [], None, 0, 0
    for r in held:
        first, last = r["first"], r["last"]
        if open_conv != (first["conv"],):
            n_before = cost_before = 0
        rows.append((r["_part"], first["conv"], n_before, cost_before))
        if first["conv"] != last["conv"]:
            n_before = cost_before = 0
        n_before, cost_before, open_conv = n_before + last["n"], cost_before + last["cost"], (last["conv"],)
    kind = turns.schema["conv"].dataType.simpleString()
    offsets = spark.createDataFrame(rows, f"p int, c {kind}, n_before long, cost_before long")     # a row per partition
    inside = Window.partitionBy("_part", "conv").orderBy("_at")
    summed = placed.select("*", (F.row_number().over(inside) - 1).cast("long").alias("_n"), F.sum("cost").over(inside).alias("_cost"))
    return (summed.join(F.broadcast(offsets), (F.col("_part") == F.col("p")) & F.col("conv").eqNullSafe(F.col("c")), "left")
            .select("conv", "role", "text", "cost", (F.col("_n") + F.coalesce("n_before", F.lit(0))).alias("rank"),
                    (F.col("_cost") + F.coalesce("cost_before", F.lit(0))).alias("upto")))


def spans(turns: DataFrame, cell_size: int) -> DataFrame:
    """Adds cell and part: together they name the turn's window."""
    cell = F.expr(f"(upto - 1) div {cell_size}")
    before = F.col("upto") - F.col("cost") < F.col("cell") * cell_size
    total = F.sum("cost").over(Window.partitionBy("conv", "cell"))
    return turns.withColumn("cell", cell).withColumn("part", F.when((total > cell_size) & before, 0).otherwise(1))


def format_windows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                   budget: int = 1024, history_turns: int = 4, history_tokens: int = 256) -> DataFrame:
    """One row per window: conv, cell, part (their order), text, n_turns, n_context (its leading turns that
    are repeated), tokens, loss (array of start and length in code points, from 0)."""
    flat = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    flat = flat.withColumn("cost", F.regexp_count("text", F.lit(TOKEN)).cast("long") + MARKS)
    turns = cut(spans(prefix_sums(flat), budget // 2))
    windows = turns.groupBy("conv", "cell", "part").agg(
        F.min("rank").alias("first"), F.min(F.col("upto") - F.col("cost")).alias("start"), F.sum("cost").alias("fresh"))
    system = turns.where("rank = 0 and role = 'system'").select(F.col("conv").alias("c"), F.col("text").alias("system"), F.col("cost").alias("system_cost"))
    last = turns.groupBy("conv").agg(F.max("cell").alias("last")).withColumnRenamed("conv", "d")
    copies = (system.join(last, F.col("c").eqNullSafe(F.col("d")))
              .select("c", "system", "system_cost", F.explode(F.sequence(F.lit(0), F.expr(f"last div {SALT_CELLS}"))).alias("salt")))
    windows = (windows.where("first > 0").join(copies, F.col("conv").eqNullSafe(F.col("c")) & (F.expr(f"cell div {SALT_CELLS}") == F.col("salt")), "left")
               .select("conv", "cell", "part", "first", "start", "system", "system_cost",
                       F.least(F.lit(history_tokens), F.lit(budget) - F.col("fresh") - F.coalesce("system_cost", F.lit(0))).alias("room")))
    place = ["conv", "cell", "part"]
    kept = windows.where("system is not null").select(*place, F.lit(-1).cast("long").alias("rank"), F.lit("system").alias("role"),
                                                     F.col("system").alias("text"), F.col("system_cost").alias("cost"))
    wanted = windows.where("room > 0").select(*place, "start", "room", F.col("system").isNotNull().alias("has_system"),
                                              F.explode(F.sequence(F.greatest(F.lit(0), F.col("first") - history_turns), F.col("first") - 1)).alias("rank"))
    earlier = turns.select(F.col("conv").alias("c"), F.col("rank").alias("r"), "role", "text", "cost", "upto")
    history = (wanted.join(earlier, F.col("conv").eqNullSafe(F.col("c")) & (F.col("rank") == F.col("r")))
               .where("start - (upto - cost) <= room and not (has_system and rank = 0)").select(*place, "rank", "role", "text", "cost"))
    context = kept.unionByName(history).withColumn("fresh", F.lit(False))
    everything = turns.select(*place, "rank", "role", "text", "cost").withColumn("fresh", F.lit(True)).unionByName(context)
    pieces = everything.select(*place, "rank", "fresh", "cost", open_mark(F.col("role")).alias("mark"), escaped_text(F.col("text")).alias("body"),
                               (F.col("fresh") & (F.col("role") == "assistant")).alias("learnt"))
    joined = pieces.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("rank", "fresh", "cost", "mark", "body", "learnt"))).alias("t"))
    # start of each learnt body: a running length over the pieces
    at = F.aggregate("t", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss")),
                     lambda a, x: F.struct(
                         (a["at"] + F.length(x["mark"]) + F.length(x["body"]) + len(END)).alias("at"),
                         F.when(x["learnt"], F.concat(a["loss"], F.array(F.struct((a["at"] + F.length(x["mark"])).alias("start"),
                                                                                 F.length(x["body"]).alias("length")))))
                         .otherwise(a["loss"]).alias("loss")), lambda a: a["loss"])
    return joined.select(F.col("conv").alias(conv), "cell", "part",
                         F.array_join(F.transform("t", lambda x: F.concat(x["mark"], x["body"], F.lit(END))), "").alias("text"),
                         F.size("t").alias("n_turns"), F.size(F.filter("t", lambda x: ~x["fresh"])).alias("n_context"),
                         F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x["cost"]).alias("tokens"), at.alias("loss"))


def read_back(windows: DataFrame) -> DataFrame:
    """Adds turns (role, text) and learnt (texts under the loss mask), both parsed from the window's text."""
    parts = F.split(F.col("text"), "</turn>\n")
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescaped_role(F.substr(p, F.lit(7), F.instr(p, F.lit(">")) - 7)).alias("role"),
        unescaped_text(F.substr(p, F.instr(p, F.lit(">")) + 1)).alias("text")))
    return windows.withColumn("turns", turns).withColumn("learnt", F.transform(
        "loss", lambda s: unescaped_text(F.substr(F.col("text"), s["start"] + 1, s["length"]))))


def digests(windows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest of a whole conversation needs its whole text in one row; formatting does not."""
    back = read_back(windows)
    fresh = F.slice("turns", F.col("n_context") + 1, F.size("turns") - F.col("n_context"))
    each = back.select(conv, "cell", "part", F.size(fresh).cast("long").alias("n"), F.length("text").cast("long").alias("chars"),
                       F.array_join(F.transform(fresh, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
                       F.array_join("learnt", "").alias("learnt"))
    whole = each.groupBy(conv).agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                   F.array_sort(F.collect_list(F.struct("cell", "part", "turns", "learnt"))).alias("w"))
    learnt = F.array_join("w.learnt", "")
    return whole.select(conv, "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"),
                        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), "formatted_chars")
