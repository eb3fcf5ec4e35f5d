"""How a table of rows meets a smaller table: checked broadcast, split hot keys, or one-row cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weatherloom.sources.writers import scratch_dir

MAX_BROADCAST_ROWS = 100_000
MAX_BROADCAST_BYTES = 64 << 20
#: A hot key is cut until a part is at most this share of what one shuffle partition gets on average.
PART_OF_A_PARTITION = 8


def _width(df: DataFrame) -> Column:
    """Bytes of a row: 16 for a plain column, the text of others."""

    def of(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 16
        if kind.startswith(("array", "map", "struct")):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)) + 16
        return F.lit(16)

    return sum((of(n, t) for n, t in df.dtypes), F.lit(0))


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame | None:
    """The frame with a broadcast hint if it has at most ``max_rows`` rows and ``max_bytes`` bytes, else None.

    Both are counted first, so ``df`` should be a stored table (see :func:`stored`).
    """
    seen = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(_width(df)), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["rows"] <= max_rows and seen["bytes"] <= max_bytes else None


def stored(df: DataFrame, name: str) -> DataFrame:
    """Computes a table now and reads it back from the shared scratch folder.

    Cuts the lineage: later passes do not compute it again, and a lost executor costs a
    re-read only.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, keys: Sequence[str], share: int | None = None) -> DataFrame:
    """``(keys, _parts)`` of the keys with more than a ``share``-th of the rows, and into how many parts each is cut.

    Keys are counted (combined on the map side). There are fewer than ``share`` of them, since their shares add up to at
    most one: that bounds the broadcast. By default a part is at most an eighth of an average shuffle partition.
    """
    if share is None:
        share = PART_OF_A_PARTITION * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    parts = F.ceil(F.col("_rows") * F.lit(share) / F.lit(max(total, 1)))
    return counts.filter(F.col("_rows") * F.lit(share) > total).select(*keys, parts.cast("int").alias("_parts"))


def join_statistics(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    spread: int | None = None,
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Left join per-key statistics onto rows when one key may own a large share of them.

    The statistics are stored first. If they then count at most ``max_rows``, they are
    broadcast and the rows do not move at all. Otherwise hot keys, found by counting, are cut into parts by
    a hash of ``spread_by`` and only their statistics rows are repeated, once for a part; all others
    meet by key alone. ``spread`` is the share (one ``spread``-th of the rows) from which a key is cut.
    """
    table = stored(stats, "statistics")
    small = broadcast_if_small(table, max_rows)
    if small is not None:
        return rows.join(small, list(keys), "left")
    hot = F.broadcast(hot_keys(rows, keys, spread))
    without = F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))  # meets nothing, so it may go anywhere
    parts = F.when(without, F.lit(1 << 20)).otherwise(F.coalesce("_parts", F.lit(1)))
    part = F.pmod(F.xxhash64(*spread_by), parts).cast("int")
    salted = rows.join(hot, list(keys), "left").withColumn("_part", part).drop("_parts")
    copies = table.join(hot, list(keys), "left")
    copies = copies.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return salted.join(copies, [*keys, "_part"], "left").drop("_part")


def with_scalars(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate on every row.

    ``one_row`` must be a global aggregate: it has exactly one row for any input size,
    so its broadcast is bounded.
    """
    return rows.crossJoin(F.broadcast(one_row))
