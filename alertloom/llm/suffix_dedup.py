"""Suffix-array dedup: every byte covered by a 400-byte string that starts anywhere else is removed.

Equal strings meet through their minimizer: among the hashes of all 32-byte grams of a 400-byte window the least one
depends on the window's bytes alone. A maximal run of windows with one minimizer is a *stretch* (about 185 windows, so
stretches hold each byte three times, but only hashes of most of them move):

1. every stretch gives its minimizer and a 128-bit hash of its bytes;
2. stretches with equal bytes are repeated as a whole;
3. where one minimizer has several different stretches, one text of each is fetched, the stretches of a bounded part
   are joined with distinct separators, and common prefixes are derived on their Burrows-Wheeler transform: breadth-first
   backward extension sets the LCP values 0, 1, 2, ... in turn and stops at the minimum length. Rows whose value is then
   still unset share a prefix of at least that length with the row before;
4. a minimizer whose different stretches are too many bytes for one task is dealt out by window instead: 128-bit
   hashes of all its windows are counted in packed parts, which gives the same result for any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, U64, checkpointed, mix64, pack, partitions, release, slice_hashes, text_blocks, written

GRAM = 32
PART_BYTES = 1 << 19
_SECOND = mix64(np.arange(256, dtype=U64) + U64(0x7EA))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each position; the last 31 positions have none."""
    h, step = BYTE_HASH[data], 1
    while step < GRAM:
        h = h[:-step] * U64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    return mix64(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i + width]) for each full window, by prefix and suffix minima of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, U64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, start in the block, end, minimizer, whether its gram occurs twice in it) of all stretches of a block."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, np.zeros(0, U64), np.zeros(0, bool)
    h = gram_hashes(data)
    least = sliding_min(h, length - GRAM + 1)
    size = np.diff(offsets)
    full = np.flatnonzero(size >= length)
    counts = size[full] - length + 1
    text = np.repeat(full, counts)
    if not len(text):
        return empty, empty, empty, np.zeros(0, U64), np.zeros(0, bool)
    window = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[text]
    m = least[window]
    first = np.concatenate([[True], (m[1:] != m[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(m)) - 1
    start, end, key = window[at], window[last] + length, m[at]
    # a window can only be equal to another of its own stretch if the gram is there twice; at most one occurrence serves length - GRAM + 1 windows
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    lo, hi = np.searchsorted(ordered, key, side="left"), np.searchsorted(ordered, key, side="right")
    twice = np.zeros(len(at), bool)
    for i in np.flatnonzero(hi - lo > 1):
        where = order[lo[i] : hi[i]]
        twice[i] = np.searchsorted(where, end[i] - GRAM + 1) - np.searchsorted(where, start[i]) > 1
    return text[at], start, end, key, twice


def _stretches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_blocks(batch):
                text, start, end, key, twice = stretches(data, offsets, length)
                raw = data.tobytes()
                whole = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + text)), pa.array((start - offsets[text]).astype(np.int32)), pa.array((end - start).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(whole, pa.binary()), pa.array(twice)],
                    ["text_key", "start", "size", "gram", "whole", "twice"],
                )

    return run


def sorted_suffixes(symbol: np.ndarray, largest: int) -> np.ndarray:
    """The suffix array by prefix doubling: each round sorts only the suffixes that others still equal."""
    n, bits = len(symbol), int(largest).bit_length() + 1
    step = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(step):
        key[: n - i] |= (symbol[i:] + 1) << ((step - 1 - i) * bits)
    suffix = np.argsort(key)
    rows, ordered = np.arange(n), key[suffix]
    rank = np.empty(n, np.int64)
    while True:
        first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        start = np.flatnonzero(first)
        sizes = np.diff(np.append(start, len(first)))
        rank[suffix[rows]] = np.repeat(rows[start], sizes)
        rows = rows[np.repeat(sizes > 1, sizes)]
        if not len(rows):
            return suffix
        own = suffix[rows]
        after = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + after
        order = np.argsort(key)
        suffix[rows], ordered = own[order], key[order]
        step *= 2


def repeated_starts(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece the positions whose ``length`` bytes also start elsewhere in the pieces.

    The suffix array (prefix doubling) gives the transform; the LCP values below ``length`` come from it in rising order.
    """
    m = len(pieces)
    sizes = np.array([len(p) + 1 for p in pieces])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    n = int(edges[-1])
    symbol = np.zeros(n, np.int64)
    bytes_at = np.ones(n, bool)
    bytes_at[edges[1:] - 1] = False
    symbol[bytes_at] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + m
    symbol[edges[1:] - 1] = np.arange(m)  # separators: all different, so nothing matches across them
    suffix = sorted_suffixes(symbol, m + 256)
    transform = symbol[suffix - 1]
    by_symbol = np.argsort(transform, kind="stable")  # row t of the first column is row by_symbol[t] of the last
    first_column = transform[by_symbol]
    change = np.concatenate([[True], first_column[1:] != first_column[:-1]])
    new = np.flatnonzero(change)  # boundaries with the LCP value of the last level: first 0
    target = np.flatnonzero(~change)
    above, below = by_symbol[target - 1], by_symbol[target]
    # two rows next to each other with one symbol extend to target[below] as soon as a boundary parts them; others wait in a list
    beside = np.full(n, -1, np.int64)
    near = below == above + 1
    beside[below[near]] = target[near]
    far, above, below = target[~near], above[~near], below[~near]
    unset = ~change
    for _ in range(1, length):
        found = beside[new]
        found = found[found >= 0]
        if len(far) and len(new):
            hit = np.searchsorted(new, below, side="right") > np.searchsorted(new, above, side="right")
            found = np.concatenate([found, far[hit]])
            far, above, below = far[~hit], above[~hit], below[~hit]
        if not len(found):
            break
        unset[found] = False
        new = np.sort(found)
    target = np.flatnonzero(unset)
    starts = np.unique(np.concatenate([suffix[target], suffix[target - 1]]))
    cuts = np.searchsorted(starts, edges)
    return [starts[cuts[i] : cuts[i + 1]] - edges[i] for i in range(m)]


def merged(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The union of [s, s + length) for ascending s, as maximal ranges."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.concatenate([[0], cut + 1])].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


_RANGES = "array<struct<a:int,b:int>>"


def _on_transform(length: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = repeated_starts([bytes(p) for p in rows["piece"]], length)
        return pd.DataFrame({"whole": rows["whole"], "ranges": [[{"a": a, "b": b} for a, b in merged(s, length)] for s in found]})

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            raw = text.as_py().encode()
            for w in wanted.as_py():
                out[0].append(w["gram"])
                out[1].append(w["whole"])
                out[2].append(raw[w["start"] : w["start"] + w["size"]])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], ["gram", "whole", "piece"])


def _windows(length: int, parts: int):
    """Per batch and part: (hash, hash, stretch, position) of all windows of the stretches, packed; a stretch is named by the first 8 bytes of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole, piece in zip(batch.column(0), batch.column(1), strict=True):
                data = np.frombuffer(piece.as_py(), np.uint8)
                at = np.arange(len(data) - length + 1)
                one, two = (slice_hashes(codes[data], at, at + length) for codes in (BYTE_HASH, _SECOND))
                name = np.full(len(at), np.frombuffer(whole.as_py(), U64, count=1)[0])
                got = list(pack(one, [one, two, name, at.astype(U64)], parts))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([np.stack(g[1], 1).tobytes() for g in got], pa.binary())], ["part", "blob"])

    return run


def _repeated_windows(parts: int):
    """Of a part, the windows whose hashes occur twice, packed by stretch."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["blob"]), U64).reshape(-1, 4)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        same = np.concatenate([[False], (x[1:, 0] == x[:-1, 0]) & (x[1:, 1] == x[:-1, 1])])
        x = x[same | np.concatenate([same[1:], [False]])]
        got = list(pack(mix64(x[:, 2]), [x[:, 2], x[:, 3]], parts)) if len(x) else []
        return pd.DataFrame({"part": pd.Series([g[0] for g in got], dtype="int32"), "blob": [np.stack(g[1], 1).tobytes() for g in got]})

    return run


def _joined_windows(length: int):
    """The ranges that a part's repeated windows cover in each of its stretches."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["blob"]), U64).reshape(-1, 2)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        edges = np.concatenate([[0], np.flatnonzero(x[1:, 0] != x[:-1, 0]) + 1, [len(x)]])
        names = [x[a, 0].tobytes() for a in edges[:-1]]
        ranges = [[{"a": p, "b": q} for p, q in merged(x[a:b, 1].astype(np.int64), length)] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({"name": names, "ranges": ranges})

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, gone, spans, shas = [], [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            at, kept, runs = 0, [], 0
            end = -1
            for r in sorted((r["a"], r["b"]) for r in ranges.as_py() or ()):
                if r[0] > end:
                    runs += 1
                    kept.append(raw[max(at, 0) : r[0]])
                end = at = max(end, r[1])
            kept.append(raw[at:])
            rest = b"".join(kept)
            sizes.append(len(raw))
            gone.append(len(raw) - len(rest))
            spans.append(runs)
            shas.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, length: int = 400, hot_bytes: int = PART_BYTES) -> DataFrame:
    """text_key (first 16 bytes of the text's SHA-256) and ranges: what is repeated in each text that has any, in UTF-8 bytes."""
    keyed = docs.select(F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("text_key"), "text").where(F.octet_length("text") >= length)
    found = written(keyed.mapInArrow(_stretches(length), "text_key binary, start int, size int, gram long, whole binary, twice boolean"))
    kinds = found.groupBy("gram", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.min(F.struct("text_key", "start", "size")).alias("rep"))
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("variants"), F.sum("rep.size").alias("bytes"), F.max("twice").alias("any_twice"), F.max("n").alias("most")).where("variants > 1 or any_twice or most > 1")
    kinds = checkpointed(kinds.join(grams, "gram").select("gram", "whole", "n", "rep", "bytes", ((F.col("variants") > 1) | F.col("any_twice")).alias("open")))
    release(docs.sparkSession)
    wanted = kinds.where("open")  # also those repeated as a whole: others may share windows with them
    parts = max(partitions(docs.sparkSession), (wanted.where(F.col("bytes") <= hot_bytes).agg(F.sum("rep.size")).first()[0] or 0) // PART_BYTES + 1)
    by_text = wanted.groupBy(F.col("rep.text_key").alias("text_key")).agg(F.collect_list(F.struct("gram", "whole", "rep.start", "rep.size")).alias("wanted"))
    pieces = keyed.join(by_text, "text_key").select("text", "wanted").mapInArrow(_slices, "gram long, whole binary, piece binary").groupBy("gram", "whole").agg(F.first("piece").alias("piece"))
    pieces = checkpointed(pieces.join(kinds.select(F.col("gram").alias("g"), F.col("whole").alias("w"), "bytes"), (F.col("gram") == F.col("g")) & (F.col("whole") == F.col("w"))).select("gram", "whole", "piece", "bytes"))
    release(docs.sparkSession)
    cold = pieces.where(F.col("bytes") <= hot_bytes).withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(parts)))
    own = cold.select("part", "whole", "piece").groupBy("part").applyInPandas(_on_transform(length), f"whole binary, ranges {_RANGES}")
    big = pieces.where(F.col("bytes") > hot_bytes)
    dealt = 4 * partitions(docs.sparkSession)
    windows = big.select("whole", "piece").repartition(partitions(docs.sparkSession)).mapInArrow(_windows(length, dealt), "part int, blob binary")
    twice = windows.groupBy("part").applyInPandas(_repeated_windows(dealt), "part int, blob binary").groupBy("part").applyInPandas(_joined_windows(length), f"name binary, ranges {_RANGES}")
    hot = big.select("whole").join(twice, F.substring("whole", 1, 8) == F.col("name")).select("whole", "ranges")
    part = own.unionByName(hot).where("size(ranges) > 0").withColumnRenamed("whole", "w")
    judged = kinds.join(part, kinds.whole == F.col("w"), "left").where("n > 1 or ranges is not null")
    every = F.array(F.struct(F.lit(0).alias("a"), F.col("rep.size").alias("b")))
    judged = judged.select(F.col("gram").alias("g"), F.col("whole").alias("w"), F.when(F.col("n") > 1, every).otherwise(F.col("ranges")).alias("ranges"))
    hits = found.join(judged, (found.gram == F.col("g")) & (found.whole == F.col("w"))).select("text_key", "start", F.explode("ranges").alias("r"))
    hits = hits.select("text_key", (F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b")).alias("b")).distinct()
    out = checkpointed(hits.groupBy("text_key").agg(F.collect_list(F.struct("a", "b")).alias("ranges")))
    release(docs.sparkSession)
    return out


def remove_repeats(docs: DataFrame, length: int = 400, hot_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text, any other columns).

    A byte is removed if a string of ``length`` bytes covers it that also starts at another place of the corpus, in the
    same text or another; strings are judged on the input and overlaps count. Matches never cross texts. Null texts count
    as empty; texts under ``length`` bytes lose nothing; of equal texts all copies go, as do repeated rows. Hashes of
    stretches have 128 bits. ``hot_bytes``: beyond this many bytes of different stretches a minimizer is dealt by window.
    """
    ranges = repeated_ranges(docs, length, hot_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", "text", F.substring(F.unhex(F.sha2("text", 256)), 1, 16).alias("text_key"))
    return keyed.join(ranges, "text_key", "left").select("doc_id", "text", "ranges").mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
