"""Ordinals of all rows in a total order, batches of them, and islands of time within keys, without a window over all rows or over a hot key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import persisted

#: The layout of Spark's row numbers, partition above and index in it below.
_SHIFT = 33


def _placed(rows: DataFrame, order: list[Column | str], parts: int | None) -> DataFrame:
    """The rows in range partitions of ``order``, checkpointed, with ``_part`` and their ``_index`` in it from 0 on."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = persisted(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", _SHIFT)).withColumn("_index", F.col("_at").bitwiseAND(F.lit((1 << _SHIFT) - 1))).drop("_at")


def ranked(rows: DataFrame, order: list[Column | str], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """``rows`` with ``name``, their number from 1 on in ``order``, as row_number() over all rows would give it.

    Two passes: rows are range-partitioned by sampled bounds and sorted, which gives each its index in its partition; the sizes of the
    partitions (one row each, so at most ``parts``) are summed and move the indexes on. However many rows share an hour, a
    shard or a name, a range splits them, as long as ``order`` ends in a column that tells rows apart; rows that tie in all of it meet
    in one partition and are numbered as they come. The sorted rows are checkpointed between the passes, so a lost executor can't
    renumber them.
    """
    placed = _placed(rows, order, parts)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    moved = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    return placed.join(F.broadcast(moved), "_part").withColumn(name, F.col("_before") + F.col("_index") + 1).drop("_part", "_index", "_before")


def batched(rows: DataFrame, order: list[Column | str], per: int, name: str = "batch", parts: int | None = None) -> DataFrame:
    """``rows`` with the number, from 0 on, of the batch of ``per`` rows that they fall in."""
    return ranked(rows, order, "_ordinal", parts).withColumn(name, F.floor((F.col("_ordinal") - 1) / per).cast("bigint")).drop("_ordinal")


def islands(rows: DataFrame, key: str, moment: str, last: str, loose: Column, gap: int, own: str = "id", parts: int | None = None) -> DataFrame:
    """``rows`` with ``island``, counted from 0 within ``key`` in order of (``moment``, ``own``): a new one where ``moment`` is more than ``gap`` after all earlier ``last``.

    A key with a ``loose`` row is one island. Rows are range-partitioned by (key, moment, own), so a key that holds most rows is
    dealt to many partitions. What a partition's share of a key must know of the shares before it (their greatest ``last``, their number of
    islands) comes from a table with a row for each key and partition; all other windows are within one share.
    """
    columns = rows.columns
    placed = _placed(rows.withColumn("_loose", F.coalesce(loose, F.lit(False))), [key, moment, own], parts).drop("_index")
    share = ["_part", key]
    inside = Window.partitionBy(*share).orderBy(moment, own)
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = placed.groupBy(*share).agg(F.max(last).alias("_end"), F.max("_loose").alias("_any")).select(*share, F.max("_end").over(earlier).alias("_carried"), F.max("_any").over(Window.partitionBy(key)).alias("_any"))
    seen = F.greatest(F.max(last).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carried"))
    opens = F.when(~F.col("_any") & (F.col(moment) > seen + gap), 1).otherwise(0)
    marked = persisted(placed.join(ends, share).withColumn("_opens", opens))
    counts = marked.groupBy(*share).agg(F.sum("_opens").alias("_n")).select(*share, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_islands"))
    numbered = marked.join(counts, share).withColumn("island", F.col("_islands") + F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.select(*columns, "island")
