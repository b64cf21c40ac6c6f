"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only.

Each source's documents are put in a fixed shuffled order (by a digest of id and text) and their words cut into blocks of equal
size. The mix is a row of slots. Slot k has the golden-ratio point frac((k + 1/2) * 0.618...), which the
cumulative needs of the sources (blocks that their targets come to) map to a source; the r-th slot of a source takes its r-th block, starting over when the
blocks run out. So the points alone decide how many blocks a source gives, which, and in what order; the golden ratio keeps each
count within a few blocks of the need. Ranks beyond CAP rounds of a source's blocks are void, so no document passes CAP times its
size. SLOTS fixes how fine the schedule is, so its size does not grow with the input.

Sources come in code point order, null last, with WEIGHTS repeating. Shares of all words that would pass
CAP times their source are cut to it and the excess goes to the others by weight.

Documents: null and empty texts have size 0 and are taken 0 times. Null sources are a source. Rows with null or equal ids are
each counted; equal rows (ties of the shuffled order) are interchangeable, so the layout of the table never shows in the result.
An empty table gives an empty result. Extra columns, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieveline.llm.common import SPACE, written

WEIGHTS, CAP, SLOTS, CELLS = (5, 2, 1), 3, 1 << 20, 1 << 14
#: Documents in one run of the shuffled order, about; runs are sorted apart and joined by their sums. Parts of the schedule that are ranked apart.
RUN, PARTS = 50_000, 256
GOLDEN = 0.6180339887498949


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(rf"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) rows -> source, sidx, s (its size), target; one row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("s"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("sidx", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("bigint"))
    s = s.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("sidx") - 1, F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double"))
    s = s.withColumn("cap", F.col("s") * float(CAP)).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "sidx").rowsBetween(Window.unboundedPreceding, -1)
    # the level a source would get if all of smaller ratio were cut to their caps; the first not below its ratio is the level of all
    s = s.withColumn("level", (F.sum("s").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(everything))
    return s.select("source", "sidx", "s", F.least("cap", F.coalesce("level", F.lit(0.0)) * F.col("w")).alias("target"))


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """32 hexadecimal digits that put documents in their shuffled order."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))


def shares(sources: DataFrame, block: int) -> DataFrame:
    """Adds to targets() the words meant for a source, its blocks, the blocks that it needs, and the sum of the needs before it."""
    s, goal = F.col("s"), F.round("target").cast("bigint")
    one = F.lit(block)
    out = sources.withColumn("goal", goal).withColumn("blocks", F.ceil(s / one).cast("bigint"))
    need = F.when(s > 0, F.floor(F.col("goal") / s) * F.col("blocks") + F.ceil(F.pmod(F.col("goal"), F.greatest(s, F.lit(1))) / one)).otherwise(0)
    out = out.withColumn("need", need.cast("bigint"))
    return out.withColumn("lo", F.coalesce(F.sum("need").over(Window.orderBy("sidx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def schedule(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """sources(sidx, blocks, need, lo) -> slot, sidx, rank (from 0 within the source), block: what each slot of the mix takes."""
    total = int(sources.agg(F.sum("need")).first()[0] or 0)
    x = (F.col("id") + 0.5) * GOLDEN
    point = F.least(F.floor((x - F.floor(x)) * total).cast("bigint"), F.lit(max(0, total - 1)))
    cell, part = max(1, -(-total // CELLS)), max(1, -(-total // PARTS))
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("at")).withColumn("cell", F.floor(F.col("at") / cell).cast("bigint"))
    spans = sources.where("need > 0").select("sidx", "blocks", "need", "lo", F.explode(F.sequence(F.floor(F.col("lo") / cell).cast("bigint"), F.floor((F.col("lo") + F.col("need") - 1) / cell).cast("bigint"))).alias("cell"))
    drawn = slots.join(spans, "cell").where("at >= lo and at < lo + need").select("slot", "sidx", "blocks", F.floor(F.col("slot") / part).cast("bigint").alias("part"))
    # ranks within parts of the schedule, and the slots that a source had in the parts before
    drawn = written(spark, drawn.withColumn("rank", F.row_number().over(Window.partitionBy("sidx", "part").orderBy("slot"))), "slots")
    had = drawn.groupBy("sidx", "part").agg(F.count("*").alias("n"))
    had = had.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("sidx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = drawn.join(had, ["sidx", "part"]).withColumn("rank", (F.col("rank") - 1 + F.col("before")).cast("bigint"))
    return ranked.where(F.col("rank") < CAP * F.col("blocks")).select("slot", "sidx", "rank", F.pmod("rank", "blocks").alias("block"))


def mixed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows(row, doc_id, source, size, key), row unique -> row, doc_id, size, source_size, target, taken, first_slot (the first in which any of its words is taken), slots (in order, where its first word is taken)."""
    base = written(spark, rows.select("row", "doc_id", "source", F.col("size").cast("bigint").alias("size"), "key"), "sizes")
    sources = written(spark, targets(base), "sources")
    total, n = base.agg(F.sum("size"), F.count("*")).first()
    block = max(1, -(-(total or 0) // SLOTS))
    sources = written(spark, shares(sources, block), "shares")
    taken = schedule(spark, sources).groupBy("sidx", "block").agg(F.count("*").alias("times"), F.sort_array(F.collect_list("slot")).alias("slots"))  # CAP slots a block at most

    runs = max(64, -(-n // RUN))
    # runs follow the order of the keys
    run = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * F.lit(runs) / F.lit(1 << 32)).cast("bigint")
    keyed = base.withColumn("run", run)
    in_run = Window.partitionBy("source", "run").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "run").agg(F.sum("size").alias("run_size"))
    sums = sums.withColumn("start", F.coalesce(F.sum("run_size").over(Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.join(sources.select(F.col("source").alias("source_"), "sidx", "s", "target"), F.col("source").eqNullSafe(F.col("source_"))).select(F.col("source").alias("source_"), F.col("run").alias("run_"), "start", "sidx", "s", "target")
    keyed = keyed.withColumn("before", F.coalesce(F.sum("size").over(in_run), F.lit(0)))
    placed = keyed.join(sums, F.col("source").eqNullSafe(F.col("source_")) & (F.col("run") == F.col("run_")))
    placed = placed.select("row", "doc_id", "size", F.col("s").alias("source_size"), "target", "sidx", (F.col("start") + F.col("before")).alias("a"))
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block).cast("bigint"), F.floor((F.col("a") + F.col("size") - 1) / block).cast("bigint"))))
    at = F.greatest("a", F.col("block") * block)
    cut = cut.withColumn("over", F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block) - at)
    cut = cut.join(taken, ["sidx", "block"], "left")
    some = cut.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(F.coalesce(F.col("times") * F.col("over"), F.lit(0))).cast("bigint").alias("taken"), F.min(F.get("slots", F.lit(0))).alias("first_slot"), F.min_by("slots", "block").alias("slots"))
    none = placed.where("size = 0").select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.lit(None).cast("bigint").alias("first_slot"), F.lit(None).cast("array<bigint>").alias("slots"))
    return some.unionByName(none)


def _rows(docs: DataFrame, row: Column) -> DataFrame:
    return docs.select(row.alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text").cast("string")).alias("key"))


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (the slot of the mix in which any of its words is first taken; -1 if none is) for every row of documents."""
    out = mixed(spark, _rows(docs, F.monotonically_increasing_id()))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix: each row as often as the words taken from it make it up, to the nearest whole number (0 to CAP).

    Copies are dealt to files by the slots in which their first words are taken, and each file is in slot order, so that a reader
    meets the sources as the schedule mixes them. A copy without such a slot of its own stands with the row's last one, or with the row's first taken word.
    """
    cols = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(cols)))).withColumn("row", F.monotonically_increasing_id())
    kept = written(spark, plain, "mix-input")
    named = kept.select("row", *(F.col(f"c{i}").alias(c) for i, c in enumerate(cols) if c in ("doc_id", "source", "text")))
    out = mixed(spark, _rows(named, F.col("row"))).where("size > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = out.withColumn("times", times).where("times > 0").select("row", F.explode(F.transform(F.sequence(F.lit(0), F.col("times") - 1), lambda i: F.coalesce(F.get("slots", i), F.get("slots", F.size("slots") - 1), F.col("first_slot")))).alias("slot"))
    copies = written(spark, copies, "copies")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = max(1, (copies.agg(F.max("slot")).first()[0] or 0) // (16 * files))
    mix = kept.join(copies, "row").withColumn("part", F.floor(F.col("slot") / part))
    mix = mix.repartition(files, "part").sortWithinPartitions("slot", "row")
    return mix.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(cols)))
