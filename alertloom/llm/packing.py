"""Conflict-constrained best-fit packing of texts into bins of one size."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bins:
    """Open bins ordered by residual; each carries bitmaps of the sources and duplicate clusters that it holds."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least = capacity, least
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.filled: list[int] = []

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for an item: the tightest bin that has room and neither bitmap holds its bits, else a new bin."""
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order):
            room, b = self.order[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del self.order[at]
                break
            at += 1  # the successor: the next tightest
        else:
            b, room = len(self.filled), self.capacity
            self.sources.append(0)
            self.clusters.append(0)
            self.filled.append(0)
        offset = self.filled[b]
        self.filled[b] += size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if room - size >= self.least:
            bisect.insort(self.order, (room - size, b))
        return b, offset


def pack(sizes, sources, clusters, capacity: int) -> tuple[list[int], list[int]]:
    """Bins and offsets of items in the given order; a None source or cluster conflicts with nothing."""
    own: tuple[dict, dict] = ({}, {})
    bits = [[0 if v is None else 1 << names.setdefault(v, len(names)) for v in values] for values, names in ((sources, own[0]), (clusters, own[1]))]
    bins = Bins(capacity, min(sizes, default=1))
    placed = [bins.put(s, a, b) for s, a, b in zip(sizes, *bits, strict=True)]
    return [p[0] for p in placed], [p[1] for p in placed]


def _group(capacity: int):
    def run(keys, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], kind="stable", na_position="last").reset_index(drop=True)
        clean = lambda column: [None if v is None or v is pd.NA or v != v else v for v in column.tolist()]
        b, offset = pack([int(s) for s in rows["size"]], clean(rows["source"]), clean(rows["cluster"]), capacity)
        return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "size": rows["size"], "bin_group": np.full(len(rows), keys[0]), "bin": b, "bin_offset": offset})

    return run


def pack_documents(docs: DataFrame, capacity: int = 32768, group_rows: int = 4000, source: str | None = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start, size, bin_group, bin, bin_offset: every piece of every text in exactly one bin of ``capacity`` bytes.

    A text over ``capacity`` UTF-8 bytes is cut into pieces of ``capacity`` and a rest. No bin holds two pieces of one source
    or of one duplicate cluster (``cluster`` names a column; by default equal texts are a cluster). Pieces are dealt by a
    hash of doc_id and piece to about rows / ``group_rows`` groups that pack apart, so a hot source, a hot cluster and a very long text
    spread over all groups and no task holds more than its share; best fit decreasing runs inside each. Empty and null texts have size 0: they have
    piece 0, size 0, and no bin (null bin). A null source conflicts with nothing. Equal rows are packed one by one.
    """
    columns = [F.col("doc_id"), F.col(source).cast("string").alias("source") if source else F.lit(None).cast("string").alias("source"), (F.col(cluster) if cluster else F.xxhash64("text")).cast("string").alias("cluster"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")]
    items = docs.select(*columns)
    items = items.select("doc_id", "source", "cluster", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / capacity)))).alias("piece"))
    items = items.select("doc_id", "source", "cluster", "piece", (F.col("piece") * capacity).alias("start"), F.least(F.lit(capacity).cast("long"), F.col("bytes") - F.col("piece") * capacity).alias("size"))
    rows = docs.count()
    groups = max(1, -(-rows // group_rows))
    full = F.col("size") == capacity
    dealt = items.where(~full & (F.col("size") > 0)).withColumn("g", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    packed = dealt.groupBy("g").applyInPandas(_group(capacity), f"doc_id {kind}, piece long, start long, size long, bin_group long, bin long, bin_offset long")
    alone = items.where(full).select("doc_id", "piece", "start", "size", F.lit(-1).cast("long").alias("bin_group"), F.monotonically_increasing_id().alias("bin"), F.lit(0).cast("long").alias("bin_offset"))
    none = items.where("size = 0").select("doc_id", "piece", "start", "size", *(F.lit(None).cast("long").alias(c) for c in ("bin_group", "bin", "bin_offset")))
    return packed.unionByName(alone).unionByName(none)
