"""Exact dedup by content-defined chunk recipes.

A text is cut where its own bytes say so; each chunk becomes an identifier; a text is then its ordered list of
identifiers (its recipe). Chunk bytes cross the network once, to verify that no two different chunks share an
identifier; after that only recipes (about 1/60 of a text) move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, U64, binary_array, checkpointed, mix64, text_blocks

AVERAGE, LEAST, MOST = 1024, 128, 16384


def cut_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk offsets over all texts of a block, and how many chunks each text has.

    A cut follows each byte where a hash of the 16 bytes up to it is 0 modulo AVERAGE, but no chunk is under LEAST
    bytes (save a text's last) or over MOST, so equal texts have equal cuts and any text has bounded chunks.
    """
    h = BYTE_HASH[data]
    for step in (1, 2, 4, 8):
        h[step:] = h[step:] * U64(0x9E3779B97F4A7C15) + h[:-step] if len(h) > step else h[step:]
    hits = np.flatnonzero(mix64(h) & U64(AVERAGE - 1) == 0) + 1
    cuts, counts = [0], np.zeros(len(offsets) - 1, dtype=np.int64)
    bounds = np.searchsorted(hits, offsets + 16)  # the hash of a text's first bytes would see the text before it
    upto = np.searchsorted(hits, offsets)
    for i in range(len(offsets) - 1):
        at, end, had = int(offsets[i]), int(offsets[i + 1]), len(cuts)
        for hit in hits[bounds[i] : max(bounds[i], upto[i + 1])].tolist() if end - at > LEAST else ():
            while hit - at > MOST:
                at += MOST
                cuts.append(at)
            if hit - at >= LEAST and hit < end:
                at = hit
                cuts.append(at)
        while end - at > MOST:
            at += MOST
            cuts.append(at)
        if end > at:
            cuts.append(end)
        counts[i] = len(cuts) - had
    return np.array(cuts, dtype=np.int64), counts


def _identifier(chunk: bytes, width: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=width).digest()


def _chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch):
                cuts, _ = cut_points(data, offsets)
                chunks = binary_array(data, cuts)
                raw = data.tobytes()
                ids = [_identifier(raw[a:b], width) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), chunks], ["chunk_id", "chunk"])

    return run


def _recipes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch):
                cuts, counts = cut_points(data, offsets)
                raw = data.tobytes()
                ids = [_identifier(raw[a:b], width) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                upto = np.concatenate([[0], np.cumsum(counts)]).tolist()
                recipes = [b"".join(ids[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
                shas = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(recipes, pa.binary()), pa.array(shas)], ["doc_id", "recipe", "text_sha256"])

    return run


def verified_width(docs: DataFrame, width: int = 16) -> int:
    """The least identifier width, from ``width`` bytes on by doubling, under which no two different chunks of the corpus share an identifier.

    Chunks are compared by their bytes: a chunk and its identifier are shuffled once, deduplicated before and after
    the shuffle, and identifiers with two contents are counted.
    """
    texts = docs.select("text")
    while True:
        chunks = texts.mapInArrow(_chunks(width), "chunk_id binary, chunk binary").distinct()
        if width >= 64 or chunks.groupBy("chunk_id").count().where("count > 1").limit(1).count() == 0:
            return width
        width *= 2


def exact_duplicates(docs: DataFrame, width: int = 16) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs`` (doc_id, text, any other columns).

    Texts are equal when identical byte for byte; a null text counts as empty, and all empty texts are equal. Of equal
    texts the largest doc_id stays; rows that repeat that doc_id are all marked kept, as they are one document. A null
    doc_id never stays unless all of its group are null (then keep_id is null and kept true). Empty tables give no rows; other
    columns are not read.
    """
    docs = docs.select("doc_id", "text")
    width = verified_width(docs, width)
    rows = checkpointed(docs.mapInArrow(_recipes(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, recipe binary, text_sha256 string"))
    # only groups of several rows are joined back; they are written, so that Spark can split a group that holds a third of all rows
    groups = checkpointed(rows.groupBy(F.col("recipe").alias("of")).agg(F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    keep = F.when(F.col("of").isNull(), F.col("doc_id")).otherwise(F.col("most"))
    joined = rows.join(groups, rows.recipe == groups.of, "left")
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
