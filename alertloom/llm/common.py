"""Shared building blocks: shared-folder checkpoints, byte-level text blocks, hashing, graph components.

Text operators run as ``mapInArrow`` over the Arrow buffers of a text column: a batch is cut into
blocks of bounded bytes and numpy works on the raw UTF-8 bytes, so no per-character Python objects
exist and memory does not follow the length of a batch.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 21

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = (x + _GOLD).astype(U64, copy=False)
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


#: A random 64-bit value for each byte.
BYTE_HASH = mix64(np.arange(256, dtype=U64) + U64(0x5EED))

#: ASCII upper case to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), dtype=U64)
    done = 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * U64(pow(base, done, 1 << 64))
        done += take
    return out


_POWERS: dict[str, np.ndarray] = {}


def powers(kind: str, n: int) -> np.ndarray:
    """Cached powers of the rolling-hash base ("up") or of its inverse ("down")."""
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        have = _POWERS[kind] = _powers(_BASE if kind == "up" else _BASE_INVERSE, max(n, BLOCK_BYTES + 1))
    return have[:n]


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end] (per-element uint64 codes), the same wherever a slice lies."""
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers("up", len(values)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers("down", len(values) + 1)[starts]
    return mix64(raw + (ends - starts).astype(U64) * _M2)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a block passes ``limit`` only for one longer text.

    Null texts count as empty.
    """
    text = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    n = len(text)
    if not n:
        return
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=kind, count=n + 1, offset=text.offset * width).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    if text.null_count:  # a null's bytes, if any, are not text
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        if (np.diff(at)[~valid] != 0).any():
            raw = np.concatenate([raw[at[i] : at[i + 1]] for i in np.flatnonzero(valid)] or [raw[:0]])
            at = np.concatenate([[0], np.cumsum(np.where(valid, np.diff(at), 0))])
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
        yield first, end, raw[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs of non-space bytes within a text), and the index of each text's first word."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True  # a word never crosses two texts
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array whose i-th value is data[offsets[i]:offsets[i + 1]], without a copy per value."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def shared_folder(session: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode, else an error."""
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        path = session.conf.get("spark.checkpoint.dir", None)
        if path is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="alertloom-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the folder that the cluster shares (spark.checkpoint.dir) and cut from their lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened by underscores where a column has that name already (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def release(session: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished stages now: it does so when the driver's garbage is collected, which may be much later."""
    gc.collect()
    session.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, for large tables: the rows as compressed Parquet files in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(session: SparkSession, least: int = 1) -> int:
    """The number of shuffle partitions that the session is set to."""
    return max(least, int(session.conf.get("spark.sql.shuffle.partitions")))


def pack(keys: np.ndarray, values: list[np.ndarray], parts: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Split parallel arrays by keys % parts into one group of arrays for each part that has any."""
    part = (keys % U64(parts)).astype(np.int64)
    order = np.argsort(part.astype(np.uint16) if parts <= 65536 else part, kind="stable")
    part = part[order]
    values = [v[order] for v in values]
    cuts = np.flatnonzero(np.diff(part)) + 1
    edges = np.concatenate([[0], cuts, [len(part)]])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield int(part[a]), [v[a:b] for v in values]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, comp): for each node of an edge the smallest node that links reach.

    Alternating large-star and small-star steps (Kiveris et al. 2014) until the edges no longer change; every step is a
    distributed aggregation, its result is checkpointed, and only a count reaches the driver. A step groups a node's
    neighbours by min() with map-side combining and a join, so a hub is never collected into one task.
    """
    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    links = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = digest(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        links, before, state = checkpointed(small), state, None
        state = digest(links)
        if state == before:
            break
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("comp")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
