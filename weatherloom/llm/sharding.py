"""Sharding with sampled splitters: records are range-partitioned at size-weighted sample quantiles.

Law ``bytes``: the shards' sizes are near equal. Records are ordered by (MD5 of the text, MD5 of the id, id), so equal
texts are neighbours. Where the running size crosses a multiple of total / shards, a shard ends; the end moves to the
nearer edge of a group of equal texts unless the group is larger than ``group_share`` of a shard.

Null text: size 1, CRC 0, a neighbour of empty texts. Null id: as the id "". Repeated rows: each has its own slot.
Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weatherloom.llm.shared import CELLS, locate, number_of, running, stored


def records(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """What sharding needs of a document: id, size, CRC and the two sort keys. No text goes further."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        number_of(F.col(text)).alias("h1"),
        number_of(F.col(key).cast("string")).alias("h2"),
    )


def splitters(light: DataFrame, ranges: int, per_range: int, rows: int, total: int) -> DataFrame:
    """``ranges - 1`` quantiles of a sample whose chance grows with size plus the mean size.

    The mean size is added so that many tiny records cannot overfill a range. About ``ranges * per_range`` rows are
    drawn, by hashes, so a rerun draws the same.
    """
    weight = F.col("size") + total / rows
    chance = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 20)) / float(1 << 20)
    draws = F.floor(weight * (ranges * per_range / (2.0 * total)) + chance)
    sample = light.select("h1", "h2", draws.alias("draws")).filter("draws > 0")
    order = Window.orderBy("h1", "h2")
    running = sample.withColumn("upto", F.sum("draws").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = sample.agg(F.sum("draws").alias("all"))
    placed = running.crossJoin(whole).select(  # one row
        "h1", "h2", F.floor(F.col("upto") * ranges / F.col("all")).alias("quantile")
    )
    bounds = placed.filter("quantile between 1 and %d" % (ranges - 1)).groupBy("quantile").agg(F.min(F.struct("h1", "h2")).alias("key"))
    return bounds.select("key", cell_of(F.col("key.h1")).alias("cell")).distinct()


def cell_of(h1):
    return F.floor(h1 / float(1 << 60) * CELLS).cast("int")


def subdivide(ranged: DataFrame, most: int) -> DataFrame:
    """Adds ``piece``: a range of more than ``most`` rows is cut into equal key intervals, by the text's key or, where all
    texts of the range are equal, by the id's key. One row per range is broadcast."""
    span = ranged.groupBy("range").agg(
        F.ceil(F.count("*") / most).alias("pieces"),
        *[f(c).alias(f"{name}_{c}") for c in ("h1", "h2") for name, f in (("lo", F.min), ("hi", F.max))],
    )

    def cut(c):
        width = (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1.0) / F.col("pieces")
        return F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width), F.col("pieces") - 1)

    piece = F.when(F.col("pieces") == 1, 0).when(F.col("lo_h1") == F.col("hi_h1"), cut("h2")).otherwise(cut("h1"))
    return ranged.join(F.broadcast(span), "range").withColumn("piece", piece.cast("long")).select(*ranged.columns, "piece")


def positions(light: DataFrame, rows: int, total: int, rows_per_range: int, per_range: int, least_ranges: int) -> DataFrame:
    """Adds ``before`` (size of all earlier records) and ``rank`` (their number) in the order (h1, h2, doc_id).

    Ranks are taken inside ranges of bounded size and shifted by the sums of earlier ranges, so no window sees all rows.
    """
    ranges = max(least_ranges, -(-rows // rows_per_range))
    bounds = splitters(light, ranges, per_range, rows, total)
    ranged = locate(light, bounds, F.struct("h1", "h2"), cell_of(F.col("h1")), "range")
    cut = stored(subdivide(ranged, 2 * max(1, -(-rows // ranges))), "shard-ranges")
    sums = stored(cut.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-pieces")
    earlier = Window.orderBy("range", "piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "range",
        "piece",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"),
    )
    inside = running(cut, ["range", "piece"], ["h1", "h2", "doc_id", "size"], sums.filter(F.col("n") > 8 * max(1, -(-rows // ranges))))
    return inside.join(F.broadcast(offsets), ["range", "piece"]).select(
        *light.columns,
        (F.col("run") + F.col("bytes_before")).alias("before"),
        (F.col("number") + F.col("rows_before")).alias("rank"),
    )


def shard_ends(placed: DataFrame, total: int, shards: int, group_share: float) -> list[int]:
    """Where shards end, as running sizes: multiples of total / shards, moved to the edge of a small group of equal texts.

    At most ``shards - 1`` rows come to the driver.
    """
    wanted = [total * j // shards for j in range(1, shards)]
    crossed = placed.filter(F.exists(F.array(*map(F.lit, wanted)), lambda w: (w >= F.col("before")) & (w < F.col("before") + F.col("size"))))
    groups = placed.join(F.broadcast(crossed.select("h1").distinct()), "h1", "left_semi").groupBy("h1")
    edges = groups.agg(F.min("before").alias("lo"), F.max(F.col("before") + F.col("size")).alias("hi")).collect()
    ends = []
    for w in wanted:
        lo, hi = next(((e.lo, e.hi) for e in edges if e.lo <= w < e.hi), (w, w))
        ends.append((lo if w - lo <= hi - w else hi) if hi - lo <= group_share * total / shards else w)
    return ends


def shard_by_size(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    key: str = "doc_id",
    rows_per_range: int = 200_000,
    samples_per_range: int = 64,
    least_ranges: int = 64,
    group_share: float = 0.01,
) -> DataFrame:
    """Columns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (null for this law)."""
    light = stored(records(docs, text, key), "shard-records")
    rows, total = light.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not rows:
        placed, ends, firsts = light.withColumns({"before": F.lit(0), "rank": F.lit(0)}), [], {}
    else:
        placed = stored(positions(light, rows, total, rows_per_range, samples_per_range, least_ranges), "shard-positions")
        ends = shard_ends(placed, total, shards, group_share)
    shard = sum((F.when(F.col("before") >= end, 1).otherwise(0) for end in ends), F.lit(0)).cast("int")
    numbered = placed.withColumn("shard", shard)
    if rows:
        firsts = {r.shard: r.first for r in numbered.groupBy("shard").agg(F.min("rank").alias("first")).collect()}
    first = F.lit(0)
    for s, at in firsts.items():
        first = F.when(F.col("shard") == s, at).otherwise(first)
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
