"""Quality by nearest-neighbour voting among broadcast labelled latent-semantic vectors.

A text's features are counts of hashed three-byte shapes and of hashed words over its whole bytes. A singular value
decomposition of the labelled texts' weighted counts gives the latent space. Both the projection and the labelled
vectors have sizes fixed by parameters, so they are broadcast; every document is then projected and compared with all
labelled vectors in blocks of exact cosine products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, LOWER, U64, fresh, mix64, slice_hashes, text_blocks, words_of

SHAPES, WORDS = 1024, 1024


def _shape_codes() -> np.ndarray:
    """Bytes by kind: lower case, upper case, digit, space, line end, beyond ASCII, and each other character for itself."""
    code = np.zeros(256, dtype=np.int64)
    code[48:58], code[65:91], code[97:123], code[128:] = 1, 2, 3, 4
    code[[32, 9]], code[[10, 13]] = 5, 6
    rest = [c for c in range(33, 128) if code[c] == 0]
    code[rest] = 7 + np.arange(len(rest))
    return code


_SHAPE = _shape_codes()
_SHAPE_SPAN = int(_SHAPE.max()) + 1
_SLOT = (mix64(np.arange(_SHAPE_SPAN**3, dtype=U64)) % U64(SHAPES)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """float32 (texts, SHAPES + WORDS): log-damped shares of shapes and of words; an empty text is all zero."""
    n = len(offsets) - 1
    out = np.zeros((n, SHAPES + WORDS), dtype=np.float32)
    if len(data) >= 3:
        c = _SHAPE[data]
        slots = _SLOT[(c[:-2] * _SHAPE_SPAN + c[1:-1]) * _SHAPE_SPAN + c[2:]]
        for i in range(n):
            a, b = int(offsets[i]), int(offsets[i + 1])
            if b - a >= 3:
                out[i, :SHAPES] = np.bincount(slots[a : b - 2], minlength=SHAPES)
    starts, ends, upto = words_of(data, offsets)
    if len(starts):
        slots = (slice_hashes(BYTE_HASH[LOWER[data]], starts, ends) % U64(WORDS)).astype(np.int64)
        for i in range(n):
            if upto[i + 1] > upto[i]:
                out[i, SHAPES:] = np.bincount(slots[upto[i] : upto[i + 1]], minlength=WORDS)
    for part in (out[:, :SHAPES], out[:, SHAPES:]):
        total = part.sum(axis=1, keepdims=True)
        np.divide(part * 100, total, out=part, where=total > 0)
    return np.log1p(out, out=out)


@dataclass
class Voters:
    """What is broadcast: bounded by the sample size, the feature count and the rank alone."""

    weight: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int
    sharpness: float

    def score(self, counts: np.ndarray) -> np.ndarray:
        """The similarity-weighted share of label 1 among each text's nearest labelled texts; the prior where none is similar."""
        own = unit((counts * self.weight) @ self.projection)
        k = min(self.neighbours, len(self.labels))
        if not k:
            return np.full(len(counts), self.prior)
        near = own @ self.vectors.T
        if k < near.shape[1]:
            at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            near, voted = np.take_along_axis(near, at, axis=1), self.labels[at]
        else:
            voted = np.broadcast_to(self.labels, near.shape)
        w = np.maximum(near.astype(np.float64), 0) ** self.sharpness
        total = w.sum(axis=1)
        return np.where(total > 0, (w * voted).sum(axis=1) / np.maximum(total, 1e-300), self.prior)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay zero."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch, limit=1 << 19):
            f = np.rint(features(data, offsets) * 50).clip(0, 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array([r.tobytes() for r in f], pa.binary())], ["quality", "f"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 4000, rank: int = 32, neighbours: int = 15, sharpness: float = 8.0, folds: int = 5, held: int = 0) -> Voters:
    """Voters from at most ``sample`` labelled documents (the bound; those of the least hash of doc_id) whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    A doc_id with several labels counts as 1 if most are. Without labelled documents the prior is 0.5 and all score it.
    """
    marked = labels.where(f"{label} is not null and doc_id is not null").groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("quality"))
    marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # `sample` rows are broadcast at most
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # one text a doc_id, however often it repeats
    texts = texts.groupBy("doc_id", "quality").agg(least.alias("t")).select("quality", "t.text")
    got = texts.repartition(8).mapInArrow(_sampled, "quality int, f binary").groupBy().applyInArrow(_decomposed(rank), "weight binary, projection binary, vectors binary, labels binary, prior double")
    model = got.collect()  # a row, or none without labelled documents; its size follows the parameters alone
    if not model:
        return Voters(np.ones(SHAPES + WORDS, np.float32), np.zeros((SHAPES + WORDS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5, 1, sharpness)
    weight, projection, vectors = (np.frombuffer(model[0][c], np.float32) for c in ("weight", "projection", "vectors"))
    labels = np.frombuffer(model[0]["labels"], np.float64)
    return Voters(weight, projection.reshape(len(weight), -1), vectors.reshape(len(labels), -1), labels, model[0]["prior"], neighbours, sharpness)


def _decomposed(rank: int):
    """The model of the sampled texts, whose number is bounded, in one task: its matrices take some 300 MB, which the driver needs not hold."""

    def run(got: pa.Table) -> pa.Table:
        y = got["quality"].to_numpy().astype(np.float64)
        f = got["f"].to_pylist()
        order = sorted(range(len(f)), key=lambda i: (y[i], f[i]))  # the same voters whatever order the rows come in
        x = np.frombuffer(b"".join(f), np.uint8).reshape(len(y), -1)[order].astype(np.float32) / 50
        y = y[order]
        weight = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.2).astype(np.float32)
        x *= weight
        x = unit(x)
        gram = x.T.astype(np.float64) @ x
        axes = np.linalg.eigh(gram)[1]
        projection = axes[:, ::-1][:, :rank].astype(np.float32)
        parts = {"weight": weight, "projection": projection, "vectors": unit(x @ projection), "labels": y}
        return pa.table({**{c: pa.array([v.tobytes()], pa.binary()) for c, v in parts.items()}, "prior": pa.array([float(y.mean())])})

    return run


def _score(voters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = voters.value
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch, limit=1 << 19):
                scores = np.concatenate([own.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a in range(0, end - first, 256) for b in [min(a + 256, end - first)]])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, end - first) for i in range(batch.num_columns - 1)), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, carry: bool = False, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold) of every row of ``docs``; with ``carry`` also all its columns.

    Scores depend on texts alone. Empty and null texts have no direction: they score the labelled share of 1. A null doc_id counts
    as the empty text for ``held_out``. Repeated rows score alike; of a labelled doc_id with several texts one is learned from.
    Empty tables give no rows. With ``carry`` a column of ``docs`` that is named as a result gives way to it.
    """
    voters = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    folds, held = options.get("folds", 5), options.get("held", 0)
    names = [c for c in docs.columns if c.lower() not in ("text", "held_out", "score", "predicted")] if carry else ["doc_id"]
    kept = fresh(docs.columns, "kept")[0]
    rows = docs.select(*(F.col(f"`{c}`") for c in names), *([F.col("text").alias(kept)] if carry else []), "text")  # the text goes on beside its score
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    scored = rows.mapInArrow(_score(voters), schema + ", score double")
    more = [F.col(f"`{c}`") if c != "text" else F.col(kept).alias("text") for c in docs.columns if c in names or c == "text"] if carry else [F.col("doc_id")]
    return scored.select(*more, (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
