"""Phrase collocations: exact phrase counts by minimal perfect hashing over Apriori-safe candidates.

Texts are split into pieces and words, and words that are frequent enough become integers; the streams of integers are
written once. Phrases grow by one word a level. A phrase is a candidate of a level if both its parts of one word less are
frequent and if the counter that its hash shares with others reaches the threshold (neither test ever loses a frequent
phrase). Each heavy counter has an owner, one of the mappers that met it: owners hand on their counters' keys, and a further pass
the keys that no owner had, so a frequent phrase is not handed on by every mapper that meets it. Counters of a fixed number fill up as tables grow,
until chance alone makes each heavy; so if there are more words than counters, each key has a counter of its own: mappers deal their keys and
counts to parts by hash, and a part hands on the keys whose sum reaches the threshold. A minimal perfect hash gives each candidate a slot, where its key is stored; a mapper finds the slots of all phrases of its
streams, drops those whose stored key differs, counts them by ``bincount`` into one array, and the arrays of all mappers are
summed by a tree of small groups. Counts of the parts of a cut are read by slot.

A hash holds at most ``most`` keys, which bounds what is broadcast and what a mapper counts in; more candidates are dealt to
several hashes, which are counted one after another.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, LOWER, U64, binary_array, checkpointed, mix64, pack, release, text_blocks, written

LONGEST, LEAST, SCALE, COVER, TOP = 4, 30, 2_000_000, 80, 2000
MOST = 1 << 22
COUNTERS = 1 << 24
CHUNK = 1 << 16
FAN = 16
#: Phrases that a mapper holds before it deals them, and occurrences for each part that they are dealt to.
HELD = PART = 1 << 21

#: The bytes that end a piece, and those that separate its words.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", 10, 11, 12, 13]] = True
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9]] = True

_ZSTD = pa.Codec("zstd")


def _lean(run: Callable) -> Callable:
    """A mapper that gives freed memory back after each task: workers are reused, and what they hold is their executor's."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return wrapped


class PerfectHash:
    """A minimal perfect hash of different 64-bit keys with the keys by slot, and a count for each slot.

    Levels of bits (Limasset et al. 2017): a key that is alone at its place of a level has its bit there, the others go on to
    the next level; its slot is the number of bits set before its own.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        base, rest, slots = 0, keys.astype(U64), []
        while len(rest):
            size = -(-max(64, 2 * len(rest)) // 64) * 64
            place = self._place(rest, len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(U64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            self.levels.append((base, size, words, before))
            held = alone[place]
            slots.append(rest[held][np.argsort(place[held])])
            base, rest = base + len(slots[-1]), rest[~held]
        self.keys = np.concatenate(slots) if slots else np.zeros(0, dtype=U64)
        self.counts = np.zeros(len(self.keys), dtype=np.int64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys ^ U64((level + 1) * 0x9E37_79B9 & 0xFFFF_FFFF)) % U64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not stored."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (base, size, words, before) in enumerate(self.levels):
            place = self._place(keys[todo], level, size)
            word, bit = words[place >> 6], (place & 63).astype(U64)
            here = (word >> bit) & U64(1) == 1
            slot = base + before[place >> 6] + np.bitwise_count(word & ((U64(1) << bit) - U64(1)))
            slot = slot[here]
            own = todo[here]
            out[own] = np.where(self.keys[slot] == keys[own], slot, -1)
            todo = todo[~here]
            if not len(todo):
                break
        return out


class Slots:
    """The hashes of one level, each broadcast: phrases are dealt to them by their keys' hash, and slots are numbered through all of them."""

    def __init__(self, parts: list[Broadcast], starts: list[int]) -> None:
        self.parts, self.starts = parts, starts

    def deal(self, keys: np.ndarray) -> np.ndarray:
        return (mix64(keys ^ U64(0xD1CE)) % U64(len(self.parts))).astype(np.int64) if len(self.parts) > 1 else np.zeros(len(keys), dtype=np.int64)

    def find(self, keys: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot + 1 and count of each key that occurs ``least`` times, else 0."""
        slots, counts = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        dealt = self.deal(keys)
        for i, part in enumerate(self.parts):
            at = np.flatnonzero(dealt == i) if len(self.parts) > 1 else np.arange(len(keys))
            found = part.value.find(keys[at])
            at, found = at[found >= 0], found[found >= 0]
            n = part.value.counts[found]
            often = n >= least
            slots[at[often]], counts[at[often]] = found[often] + self.starts[i] + 1, n[often]
        return slots, counts

    def release(self) -> None:
        for part in self.parts:
            part.destroy()


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of a block as a dictionary array, the row of each, and whether a piece ends between it and the word before."""
    end = ENDS[data]
    inside = ~(end | BLANK[data])
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    held = data[inside]
    before = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(inside, dtype=np.int32)])
    at = np.append(before[starts], len(held))
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(end, dtype=np.int32)])[starts]
    fresh_piece = np.ones(len(starts), dtype=bool)
    fresh_piece[1:] = (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])
    return binary_array(LOWER[held], at).dictionary_encode(), row, fresh_piece


def _langs(batch: pa.RecordBatch, first: int, end: int) -> tuple[np.ndarray, list[str]]:
    codes = batch.column(1).slice(first, end - first).fill_null("und").dictionary_encode()
    return codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word and its count, of each block."""
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch, limit=BLOCK_BYTES):
            lang, names = _langs(batch, first, end)
            words, row, _ = _words(data, offsets)
            if not len(words):
                continue
            pairs, n = np.unique(lang[row].astype(np.int64) << 32 | words.indices.to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(pairs >> 32)), words.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _encode(tables: list[Broadcast]) -> Callable:
    """Streams of word numbers, 0 for a rare word and between pieces; a block's texts share a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_blocks(batch, limit=BLOCK_BYTES):
                lang, names = _langs(batch, first, end)
                words, row, starts_piece = _words(data, offsets)
                if not len(words):
                    continue
                indices = words.indices.to_numpy().astype(np.int64)
                of = lang[row].astype(np.int64)
                ids = np.zeros(len(indices), dtype=np.int32)
                for k, name in enumerate(names):
                    mine = of == k
                    own = np.zeros(len(words.dictionary), dtype=np.int32)
                    for table in tables:
                        if name in table.value:
                            known, first_id = table.value[name]
                            place = pc.index_in(words.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                            own = np.where(place >= 0, first_id + place, own)
                    ids[mine] = own[indices[mine]]
                gaps = np.flatnonzero(starts_piece)
                stream = np.insert(ids, gaps, 0)
                keep = np.ones(len(stream), dtype=bool)
                keep[1:] = (stream[1:] != 0) | (stream[:-1] != 0)  # one 0 stands for a run of them
                yield pa.RecordBatch.from_arrays([pa.array([stream[keep].astype("<i4").tobytes()], pa.binary())], ["ids"])

    return run


def _phrases(ids: np.ndarray, lower: list[Slots], least: int) -> np.ndarray:
    """The 64-bit keys of all phrases of one word more than the levels of ``lower``, whose two parts of one word less are frequent: slot of the first part, number of the last word."""
    have = slots = ids.astype(np.int64)
    size = 1
    while True:
        ok = (slots[:-1] > 0) & (slots[1:] > 0) if len(slots) > 1 else np.zeros(0, dtype=bool)
        at = np.flatnonzero(ok)
        keys = slots[at].astype(U64) << U64(32) | have[at + size].astype(U64)
        if size > len(lower):
            return keys
        grown = np.zeros(max(len(slots) - 1, 0), dtype=np.int64)
        grown[at] = lower[size - 1].find(keys, least)[0]
        slots, size = grown, size + 1


def _streams(batches: Iterator[pa.RecordBatch], lower: list[Slots], least: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column(0):
            yield _phrases(np.frombuffer(x.as_buffer(), dtype="<i4"), lower, least)


def _saturated(least: int | None) -> str:
    """The type of counts in chunks: a byte will do for counts that end at ``least``, as a sum reaches it or not all the same."""
    return "<i8" if least is None or least > 255 else "u1"


def _ended(counts: np.ndarray, least: int | None) -> np.ndarray:
    return counts if least is None else np.minimum(counts, least)


def _squeezed(values: np.ndarray) -> bytes:
    """The bytes of an array, most of whose values are small: Spark's own codec of shuffles looks for repeats only and leaves a multiple of them."""
    return values.nbytes.to_bytes(4, "little") + _ZSTD.compress(values.tobytes(), asbytes=True)


def _spread(squeezed: pa.Buffer | bytes, kind: np.dtype | str) -> np.ndarray:
    raw = memoryview(squeezed)
    return np.frombuffer(_ZSTD.decompress(raw[4:], int.from_bytes(raw[:4], "little")), dtype=kind)


def _chunks(counts: np.ndarray, least: int | None = None) -> Iterator[pa.RecordBatch]:
    """A mapper's array in chunks, with the mapper's number; chunks of zeros are left out. With ``least`` counts end there."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for i in range(0, len(counts), CHUNK):
        if counts[i : i + CHUNK].any():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i // CHUNK], pa.int32()), pa.array([_squeezed(_ended(counts[i : i + CHUNK], least).astype(_saturated(least)))], pa.binary())], ["part", "chunk", "counts"])


def _counters(lower: list[Slots], least: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.int32)
        for keys in _streams(batches, lower, least):
            np.add.at(counts, (mix64(keys) & U64(size - 1)).astype(np.int64), np.int32(1))
        yield from _chunks(counts, least)

    return run


def _turns(part: int | np.ndarray, places: np.ndarray, mappers: int) -> np.ndarray:
    """The turn of a mapper at each counter: of those that met a counter the one with the least turn owns it, and turns rotate."""
    return ((part + places) % mappers).astype(np.int32)


def _narrow(n: int) -> np.dtype:
    """The least type of numbers under ``n``."""
    return np.min_scalar_type(max(n - 1, 0)).newbyteorder("<")


class Heavy:
    """The bits of the heavy counters, and the mapper that owns each."""

    def __init__(self, sums: DataFrame, counters: int, mappers: int) -> None:
        bits, owners, kind = np.zeros(counters // 8, dtype=np.uint8), {}, _narrow(mappers)
        for row in sums.select("chunk", "counts", "owners").toLocalIterator():  # ``counters`` bounds what reaches the driver
            part = _spread(row["counts"], np.uint8)
            bits[row["chunk"] * (CHUNK // 8) :][: len(part)] = part
            owners[row["chunk"]] = _spread(row["owners"], kind)
        self.counters = counters
        self.words = bits.view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]
        self.owners = np.concatenate([owners[c] for c in sorted(owners)]) if owners else np.zeros(0, dtype=kind)

    def of(self, keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys whose counter is heavy, and whether mapper ``part`` owns it."""
        place = (mix64(keys) & U64(self.counters - 1)).astype(np.int64)
        word, bit = self.words[place >> 6], (place & 63).astype(U64)
        at = np.flatnonzero((word >> bit) & U64(1) == 1)
        rank = self.before[place[at] >> 6] + np.bitwise_count(word[at] & ((U64(1) << bit[at]) - U64(1)))
        return keys[at], self.owners[rank] == part


def _candidates(lower: list[Slots], least: int, heavy: Broadcast, known: Broadcast | None = None, deal: Callable[[np.ndarray], np.ndarray] | None = None, number: int = 0) -> Callable:
    """The different keys of the phrases whose heavy counter the mapper owns; with ``known``, those of any heavy counter dealt to ``number`` that are not known yet.

    Sets are merged while they are small and handed on when not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held, n = [], 0
        for keys in _streams(batches, lower, least):
            keys, mine = heavy.value.of(keys, part)
            if known is None:
                keys = np.unique(keys[mine])
            else:
                keys = np.unique(keys)
                keys = keys[deal(keys) == number]
                keys = keys[known.value.find(keys) < 0]
            held.append(keys)
            n += len(keys)
            if n > 1 << 20:
                held = [np.unique(np.concatenate(held))]
                n = len(held[0])
                if n > 1 << 19:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64), pa.int64())], ["key"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64), pa.int64())], ["key"])

    return run


def _planes(keys: np.ndarray) -> bytes:
    """Sorted keys, squeezed by planes of bytes: the upper ones hardly change."""
    return _squeezed(np.ascontiguousarray(keys.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T))


def _of_planes(squeezed: pa.Buffer | bytes) -> np.ndarray:
    return np.ascontiguousarray(_spread(squeezed, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _dealt_counts(lower: list[Slots], least: int, parts: int, most: int = HELD) -> Callable:
    """The different keys of about ``most`` phrases at a time and their counts, which end at ``least``: a row for each of ``parts`` parts of the keys."""
    kind = _saturated(least)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        rows = list(pack(mix64(keys ^ U64(0xFACE)), [keys, _ended(counts, least).astype(kind)], parts))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([_planes(r[1][0]) for r in rows], pa.binary()), pa.array([_squeezed(r[1][1]) for r in rows], pa.binary())], ["part", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for keys in _streams(batches, lower, least):
            held.append(keys)
            n += len(keys)
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _often(least: int) -> Callable:
    """The keys of a part whose counts sum to ``least`` at least."""
    kind = _saturated(least)

    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([_of_planes(x.as_buffer()) for x in table.column("keys")])
        counts = np.concatenate([_spread(x.as_buffer(), kind) for x in table.column("counts")])
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts[order], first, dtype=np.int64)
        return pa.table({"key": pa.array(keys[first[total >= least]].view(np.int64), pa.int64())})

    return run


def _slot_counts(lower: list[Slots], least: int, own: Broadcast, deal: Callable[[np.ndarray], np.ndarray], number: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = own.value
        counts = np.zeros(len(hashed.keys), dtype=np.int64)
        for keys in _streams(batches, lower, least):
            slots = hashed.find(keys[deal(keys) == number])
            counts += np.bincount(slots[slots >= 0], minlength=len(counts))  # ``most`` bounds it
        yield from _chunks(counts)

    return run


def _sum(least: int | None, last: bool) -> Callable:
    """The sum of a group's chunks; with ``least`` it ends there, and the ``last`` sum becomes the bits of those that reach it."""
    kind = _saturated(least)

    def run(table: pa.Table) -> pa.Table:
        total = np.sum([_spread(x.as_buffer(), kind) for x in table.column("counts")], axis=0, dtype=np.int64)
        total = _ended(total, least).astype(kind) if least is None or not last else np.packbits(total >= least, bitorder="little")
        return pa.table({"part": table.column("part").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "counts": pa.array([_squeezed(total)], pa.binary())})

    return run


def _sum_owned(least: int, mappers: int, last: bool, span: int) -> Callable:
    """As ``_sum`` with ``least``, with the owner of each counter that was met, at last of the heavy ones only: the mapper of the least turn.

    A chunk stands for ``span`` mappers. Its owners are numbered within these, so that few bytes go on; a mapper's own chunk has none.
    """
    summed, kind = _sum(least, last), _saturated(least)

    def run(table: pa.Table) -> pa.Table:
        first = None
        for child, chunk, counts, owners in zip(*(table.column(c) for c in ("child", "chunk", "counts", "owners")), strict=True):
            met = _spread(counts.as_buffer(), kind)
            at, start = np.flatnonzero(met), chunk.as_py() * CHUNK
            owner = child.as_py() * span + (_spread(owners.as_buffer(), _narrow(span)).astype(np.int64) if owners.is_valid else 0)
            if first is None:
                first = np.full(len(met), mappers, dtype=np.int32)
            first[at] = np.minimum(first[at], _turns(owner, at + start, mappers))
        out = summed(table)
        at = np.flatnonzero(first < mappers)
        if last:
            heavy = np.unpackbits(_spread(out.column("counts")[0].as_buffer(), np.uint8), count=len(first), bitorder="little") == 1
            at = np.flatnonzero(heavy)
        owner = (first[at].astype(np.int64) - at - start) % mappers
        owner = owner.astype(_narrow(mappers)) if last else (owner - table.column("part")[0].as_py() * span * FAN).astype(_narrow(span * FAN))
        return out.append_column("owners", pa.array([_squeezed(owner)], pa.binary()))

    return run


def tree_sum(chunks: DataFrame, mappers: int, least: int | None = None) -> DataFrame:
    """The sums of the mappers' chunks: FAN mappers' chunks at a time meet in a group, until one is left of each chunk.

    With ``least`` (chunks of counts that end there) the bits of those that reach it, and the mappers that own them.
    """
    last, every, span = False, mappers, 1
    if least is not None:
        chunks = chunks.select("part", "chunk", "counts", F.lit(None).cast("binary").alias("owners"))
    while not last:
        last = mappers <= FAN
        group = F.floor(F.col("part") / FAN).cast("int").alias("part")
        if least is None:
            chunks = chunks.select(group, "chunk", "counts").groupBy("part", "chunk").applyInArrow(_sum(least, last), "part int, chunk int, counts binary")
        else:
            up = chunks.select(group, F.col("part").alias("child"), "chunk", "counts", "owners")
            chunks = up.groupBy("part", "chunk").applyInArrow(_sum_owned(least, every, last, span), "part int, chunk int, counts binary, owners binary")
        mappers, span = -(-mappers // FAN), span * FAN
    return chunks


def _collected(chunks: DataFrame, out: np.ndarray, width: int) -> np.ndarray:
    """The chunks' arrays in ``out``, whose length bounds what reaches the driver."""
    for row in chunks.select("chunk", "counts").toLocalIterator():
        part = _spread(row["counts"], out.dtype.newbyteorder("<"))
        out[row["chunk"] * width :][: len(part)] = part
    return out


def _keys(rows: DataFrame) -> np.ndarray:
    return rows.toArrow().column(0).to_numpy().view(U64)  # bounded by the caller


def _shared(streams: DataFrame, mappers: int, lower: list[Slots], least: int, most: int, counters: int) -> tuple[DataFrame, int]:
    """The keys of the next level's phrases whose shared counter is heavy, and their number."""
    session = streams.sparkSession
    sums = tree_sum(streams.mapInArrow(_lean(_counters(lower, least, counters)), "part int, chunk int, counts binary"), mappers, least)
    heavy = session.sparkContext.broadcast(Heavy(sums, counters, mappers))
    owned = checkpointed(streams.mapInArrow(_lean(_candidates(lower, least, heavy)), "key long").distinct())
    n, found = owned.count(), owned
    groups = max(1, -(-n // most))
    deal = Slots([None] * groups, []).deal
    for i in range(groups):
        mine = owned if groups == 1 else owned.mapInArrow(_dealt(deal, i), "key long")
        known = session.sparkContext.broadcast(PerfectHash(np.sort(_keys(mine))))
        left = checkpointed(streams.mapInArrow(_lean(_candidates(lower, least, heavy, known, deal, i)), "key long").distinct())
        known.destroy()
        n, found = n + left.count(), found.unionByName(left)
    heavy.destroy()
    return found, n


def _level(streams: DataFrame, lower: list[Slots], least: int, most: int, counters: int, dealt: int) -> Slots:
    """The counted candidates of the next level; they come from shared counters, or from ``dealt`` parts if it is not 0."""
    session = streams.sparkSession
    mappers = streams.rdd.getNumPartitions()
    if dealt:
        counted = streams.mapInArrow(_lean(_dealt_counts(lower, least, dealt)), "part int, keys binary, counts binary")
        found = checkpointed(counted.groupBy("part").applyInArrow(_often(least), "key long"))
        n = found.count()
    else:
        found, n = _shared(streams, mappers, lower, least, most, counters)
    groups = max(1, -(-n // most))
    deal = Slots([None] * groups, []).deal
    parts, starts, base = [], [], 0
    for i in range(groups):
        mine = found if groups == 1 else found.mapInArrow(_dealt(deal, i), "key long")
        hashed = PerfectHash(np.sort(_keys(mine)))
        own = session.sparkContext.broadcast(hashed)
        counted = streams.mapInArrow(_lean(_slot_counts(lower, least, own, deal, i)), "part int, chunk int, counts binary")
        counts = _collected(tree_sum(counted, mappers), hashed.counts, CHUNK)
        own.destroy()
        often = counts >= least
        kept = PerfectHash(hashed.keys[often])  # later levels and cuts only read frequent phrases
        kept.counts[kept.find(hashed.keys[often])] = counts[often]
        parts.append(session.sparkContext.broadcast(kept))
        starts.append(base)
        base += len(kept.keys)
    return Slots(parts, starts)


def _dealt(deal: Callable, number: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(U64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[deal(keys) == number].view(np.int64), pa.int64())], ["key"])

    return run


def floor_ratio(a: np.ndarray, over: np.ndarray) -> np.ndarray:
    """floor(2000000 * a / over) for 2 * a <= over < 2 ** 53, in two steps of long division, as the product may pass 64 bits."""
    high, rest = np.divmod(a * 2000, over)
    return high * 1000 + rest * 1000 // over


def _table(parts: list[Slots], size: int, least: int, words: list[Broadcast]) -> Callable:
    """For each hash of the level: its frequent phrases with their counts, the counts of their cuts, their score, and the slots of shorter ones that they cover."""
    level = parts[size - 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                hashed = level.parts[i].value
                at = np.flatnonzero(hashed.counts >= least)
                for first in range(0, len(at), 1 << 16):
                    mine = at[first : first + (1 << 16)]
                    yield _rows(mine, hashed, level.starts[i], parts, size, least, words)

    return run


def _keys_by_slot(level: Slots, slots: np.ndarray) -> np.ndarray:
    """The stored keys of slots + 1."""
    out = np.zeros(len(slots), dtype=U64)
    at = np.searchsorted(level.starts, slots - 1, side="right") - 1
    for i in np.unique(at):
        out[at == i] = level.parts[i].value.keys[slots[at == i] - 1 - level.starts[i]]
    return out


def _word_columns(ids: np.ndarray, words: list[Broadcast]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """lang, word and count of word numbers, read by number."""
    lang, word, count = np.empty(len(ids), dtype=object), np.empty(len(ids), dtype=object), np.zeros(len(ids), dtype=np.int64)
    for table in words:
        for name, (known, first, counts) in table.value.items():
            here = np.flatnonzero((ids >= first) & (ids < first + len(known)))
            lang[here] = name
            word[here] = known.take(pa.array(ids[here] - first)).cast(pa.string()).to_numpy(zero_copy_only=False)
            count[here] = counts[ids[here] - first]
    return lang, word, count


def _rows(mine: np.ndarray, hashed: PerfectHash, start: int, parts: list[Slots], size: int, least: int, words: list[Broadcast]) -> pa.RecordBatch:
    a = hashed.counts[mine]
    key = hashed.keys[mine]
    ids: list[np.ndarray] = []
    for k in range(size, 1, -1):  # the stored keys give a phrase back, from its last word to its first
        ids.insert(0, (key & U64(0xFFFFFFFF)).astype(np.int64))
        first = (key >> U64(32)).astype(np.int64)
        if k > 2:
            key = _keys_by_slot(parts[k - 3], first)
    ids.insert(0, first)
    read = [_word_columns(x, words) for x in ids]
    inner: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {(i, i + 1): (ids[i], read[i][2]) for i in range(size)}  # slot + 1 and count of every part
    for length in range(2, size):
        for i in range(size - length + 1):
            inner[i, i + length] = parts[length - 2].find(inner[i, i + length - 1][0].astype(U64) << U64(32) | ids[i + length - 1].astype(U64), least)
    best = l = r = None
    for k in range(1, size):
        left, right = inner[0, k][1], inner[k, size][1]
        score = floor_ratio(a, left + right)
        lower = np.ones(len(a), dtype=bool) if best is None else score < best
        best, l, r = (np.where(lower, new, old) if old is not None else new for new, old in ((score, best), (left, l), (right, r)))
    covered = [[] for _ in a]
    for (i, j), (slots, counts) in inner.items():
        if 2 <= j - i < size:
            for x in np.flatnonzero(100 * a >= COVER * counts):
                covered[x].append({"size": j - i, "slot": int(slots[x])})
    phrase = read[0][1]
    for x in read[1:]:
        phrase = phrase + " " + x[1]
    fields = pa.list_(pa.struct([("size", pa.int32()), ("slot", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array(read[0][0], pa.string()), pa.array(np.full(len(a), size), pa.int32()), pa.array(mine + start + 1), pa.array(phrase, pa.string()), *map(pa.array, (a, l, r, best)), pa.array(covered, fields)], ["lang", "size", "slot", "phrase", "a", "l", "r", "score", "covers"])


def _word_tables(session: SparkSession, frequent: DataFrame, most: int) -> list[Broadcast]:
    """The frequent words by language, numbered from 1 on, in broadcasts of at most about ``most`` words."""
    n = frequent.count()
    groups, tables, number = max(1, -(-n // most)), [], 1
    for i in range(groups):
        rows = frequent.where(F.pmod(F.xxhash64("word"), F.lit(groups)) == i).toArrow()
        rows = rows.sort_by([("lang", "ascending"), ("word", "ascending")])
        table = {}
        for name in rows.column("lang").unique().to_pylist():
            own = rows.filter(pc.equal(rows.column("lang"), name))
            table[name] = (own.column("word").combine_chunks(), number, own.column("f").to_numpy())
            number += own.num_rows
        tables.append(session.sparkContext.broadcast(table))
    return tables


OUT = "lang string, size int, slot long, phrase string, a long, l long, r long, score long, covers array<struct<size:int,slot:long>>"


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, most: int = MOST, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): n of each lang; and of each frequent phrase of 2 to ``longest`` words its lang, size, slot, phrase, count a, the counts l and r of its lowest cut, score and the shorter phrases that it ``covers``.

    Null and empty texts have no words, a null lang is ``und``; repeated rows count as often as they occur; an empty table gives no rows.
    """
    session = docs.sparkSession
    docs = docs.select(F.col("text"), F.col("lang").cast("string"))
    counted = docs.mapInArrow(_lean(_count_words), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    counted = written(counted)
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    tokens = counted.where(F.col("f") >= least).agg(F.sum("f")).first()[0] or 0
    dealt = -(-tokens // PART) if tokens > counters else 0
    counters = min(counters, max(CHUNK, 1 << int(tokens // 8).bit_length()))
    tables = _word_tables(session, counted.where(F.col("f") >= least), most)
    known = [session.sparkContext.broadcast({k: v[:2] for k, v in t.value.items()}) for t in tables]
    streams = written(docs.mapInArrow(_lean(_encode(known)), "ids binary"))
    for table in known:
        table.destroy()
    levels: list[Slots] = []
    out = None
    for size in range(2, longest + 1):
        levels.append(_level(streams, list(levels), least, most, counters, dealt))
        hashes = session.range(len(levels[-1].parts)).repartition(len(levels[-1].parts), "id")
        rows = checkpointed(hashes.mapInArrow(_table(list(levels), size, least, tables), OUT))
        out = rows if out is None else out.unionByName(rows)
        release(session)
    for x in (*levels, *map(lambda t: Slots([t], []), tables)):
        x.release()
    return totals, out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int | None = TOP, most: int = MOST, counters: int = COUNTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases (all if None) by score and count, ties in byte order.

    A phrase inside a longer one that occurs at least 80 times for 100 of its own occurrences is dropped. ``least`` must be 1 or
    more; further columns of ``docs`` are not read.
    """
    totals, found = phrases(docs, least, longest, most, counters)
    covered = found.select(F.explode("covers").alias("c")).select(F.col("c.size").alias("size"), F.col("c.slot").alias("slot")).distinct()
    kept = found.drop("covers").join(covered, ["size", "slot"], "left_anti").join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank.cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
