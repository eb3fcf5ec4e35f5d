"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a hashed order and their words cut into equal blocks. Slot i of the schedule is the
golden-ratio point frac(i / phi) mapped through the sources' cumulative numbers of wanted blocks; the k-th slot of a
source takes its block k modulo the number of its blocks. A source's targets stop at twice its size, so no block is
taken more than twice.

Null text: size 0, taken 0. Null source: a source of its own, last in the order. Repeated rows: each counts by itself.
A source without words has target 0. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weatherloom.llm.shared import CELLS, WORD, locate, number_of, running, stored

#: Multiplier of the golden-ratio points: 2^31 / phi, odd, so the points visit every multiple of 2^-31 once.
GOLDEN, PERIOD = 1327217885, 1 << 31


def row_hash(text: str, key: str):
    """Shuffle key of a document, from its id and text."""
    return number_of(F.concat_ws(":", F.lit("mix"), F.col(key).cast("string"), F.md5(F.col(text))))


def sized(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    """Id, source, word count and shuffle key of each document; the text goes no further."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        row_hash(text, key).alias("h"),
    )


def targets(light: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """One row per source: ``place`` in code-point order (null last), rows, source_size, weight and target.

    The level at which water fills the sources: target = least(most * size, weight * level). Sorted by size / weight, the
    level is where the first k sources are full and the rest share what is left. All windows are over one row a source.
    """
    sums = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    filled = (
        sums.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.sum("source_size").over(everything) * share - F.col("full")) / F.col("open"))
    )
    ratio = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))
    level = F.min(ratio).over(everything)["level"]  # of the first source that stays below its cap
    return filled.select(
        "source", "place", "rows", "source_size", F.least(F.col("cap"), F.col("weight") * F.coalesce(level, F.lit(float("inf")))).alias("target")
    )


def with_blocks(plan: DataFrame, block_words: int, least_blocks: int) -> DataFrame:
    """Adds ``blocks`` (equal to within a word) and ``quota``: how many block slots the source's target needs."""
    size = F.col("source_size")
    blocks = F.greatest(F.ceil(size / block_words), F.least(size, F.lit(least_blocks))).cast("long")
    quota = F.when(size > 0, F.round(F.col("target") * F.col("blocks") / size)).otherwise(0).cast("long")
    return plan.withColumn("blocks", blocks).withColumn("quota", quota)


def offsets(light: DataFrame, plan: DataFrame, rows_per_cell: int) -> DataFrame:
    """Adds ``start``: words before the document in its source's shuffled order.

    A source is cut into cells of the hash; a window sees one cell, and cell sums shift it. A cell far above its expected
    rows holds one row many times, which ``running`` counts first.
    """
    cell = F.floor(F.col("h") / float(1 << 60) * F.ceil(F.col("rows") / rows_per_cell))
    placed = light.join(F.broadcast(plan), light.source.eqNullSafe(plan.source)).drop(plan.source).withColumn("cell", cell)
    sums = stored(placed.groupBy("place", "cell").agg(F.sum("size").alias("words"), F.count("*").alias("n")), "mix-cells")
    earlier = Window.partitionBy("place").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("place", "cell", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("shift"))
    run = running(placed, ["place", "cell"], ["h", "doc_id", "size"], sums.filter(F.col("n") > 8 * rows_per_cell))
    return run.join(shift, ["place", "cell"]).withColumn("start", F.col("run") + F.col("shift")).drop("run", "number", "shift")


def schedule(spark, plan: DataFrame, slots: int, chunks: int, least_chunk: int) -> DataFrame:
    """The slots: ``slot``, ``place`` of the source and ``rank`` among that source's slots.

    Ranks are taken inside chunks of the schedule and shifted by the counts of earlier chunks.
    """
    upto = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    wanted = plan.filter("quota > 0").select("place", F.sum("quota").over(upto).alias("end"))
    ends = wanted.select(F.col("end").cast("double").alias("key"), F.floor(F.col("end") * (CELLS / slots)).cast("int").alias("cell"))
    numbered = wanted.select("place", (F.row_number().over(Window.orderBy("place")) - 1).cast("long").alias("nth"))
    point = F.pmod((F.col("id") % PERIOD) * GOLDEN, F.lit(PERIOD)) / float(PERIOD) * slots
    chunk = max(least_chunk, -(-slots // chunks))
    at = locate(
        spark.range(slots).withColumn("point", point),
        ends.filter(F.col("key") < slots),
        F.col("point"),
        F.floor(F.col("point") * (CELLS / slots)).cast("int"),
        "nth",
    )
    dealt = at.join(F.broadcast(numbered), "nth").select(F.col("id").alias("slot"), "place", F.floor(F.col("id") / chunk).alias("chunk"))
    counts = dealt.groupBy("place", "chunk").count()
    earlier = Window.partitionBy("place").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("place", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    nth = F.row_number().over(Window.partitionBy("place", "chunk").orderBy("slot")) - 1
    return dealt.withColumn("nth", nth).join(shift, ["place", "chunk"]).select("slot", "place", (F.col("nth") + F.col("shift")).alias("rank"))


def block_edge(block, size, blocks):
    return F.floor(block * (size / blocks) + 1e-9).cast("long")


def taken_words(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    block_words: int = 256,
    least_blocks: int = 512,
    rows_per_cell: int = 1000,
    chunks: int = 4096,
    least_chunk: int = 512,
) -> DataFrame:
    """Columns doc_id, source, h, size, source_size, target, taken: the words that the mix takes from each document."""
    spark = docs.sparkSession
    light = stored(sized(docs, text, source, key), "mix-sizes")
    plan = stored(with_blocks(targets(light, weights, share, most), block_words, least_blocks), "mix-plan")
    slots, cells = plan.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    placed = stored(offsets(light, plan, max(rows_per_cell, cells // 20_000)), "mix-offsets")
    limits = plan.select("place", "blocks", F.floor(F.col("blocks") * most).alias("most_slots"))
    used = (
        schedule(spark, plan, max(1, slots), chunks, least_chunk)
        .join(F.broadcast(limits), "place")
        .filter(F.col("rank") < F.col("most_slots"))  # nobody's words are taken more often than allowed
        .groupBy("place", (F.col("rank") % F.col("blocks")).alias("block"))
        .agg(F.count("*").alias("uses"))
    )
    width = F.col("source_size") / F.col("blocks")
    first = F.floor(F.col("start") / width)
    last = F.floor((F.col("start") + F.col("size") - 1) / width)
    pieces = (
        placed.filter("size > 0")
        # one block more on each side, for rounding; pieces without words are dropped
        .withColumn("block", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("blocks") - 1))))
        .withColumn("lo", F.greatest("start", block_edge(F.col("block"), F.col("source_size"), F.col("blocks"))))
        .withColumn("hi", F.least(F.col("start") + F.col("size"), block_edge(F.col("block") + 1, F.col("source_size"), F.col("blocks"))))
        .filter("hi > lo")
        .select("place", "block", "start", (F.col("hi") - F.col("lo")).alias("words"))
    )
    # "start" tells a source's documents with words apart, repeated rows too
    got = pieces.join(used, ["place", "block"]).groupBy("place", "start").agg(F.sum(F.col("words") * F.col("uses")).alias("got"))
    taken = F.when(F.col("size") > 0, F.coalesce("got", F.lit(0))).otherwise(0).cast("long")
    return placed.join(got, ["place", "start"], "left").select("doc_id", "source", "h", "size", "source_size", "target", taken.alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """Columns doc_id, source, size, source_size, target, taken. Options as in ``taken_words``."""
    return taken_words(docs, **options).drop("h")


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The mix as documents: each row as often as the mix takes its words, rounded (0 to 2 times). Rows that repeat id,
    source and text cannot be told apart: their mean is rounded up for as large a share of them as it exceeds a whole
    number. Rows without words are left out."""
    taken = taken_words(docs, text=text, source=source, key=key, **options).filter("size > 0")
    sums = taken.groupBy("doc_id", "source", "h").agg((F.sum("taken") / F.sum("size")).alias("_mean"), F.count("*").alias("_rows"))
    wanted = sums.filter((F.col("_mean") >= 0.5) | (F.col("_rows") > 1) & (F.col("_mean") > 0))
    wanted = wanted.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("h").alias("_of"), "_mean", "_rows")
    # the row travels as one column, whatever its columns are called
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).alias("_d"), F.col(source).alias("_s"), row_hash(text, key).alias("_h"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_h") == F.col("_of"))
    spread = ((F.monotonically_increasing_id() % PERIOD) * GOLDEN) % PERIOD / float(PERIOD)
    found = rows.join(wanted, same).withColumn("_spread", spread)
    copies = F.when(F.col("_rows") == 1, F.round("_mean")).otherwise(F.floor(F.col("_mean") + F.col("_spread"))).cast("int")
    return found.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
