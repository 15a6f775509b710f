"""N-gram Jaccard join with PartEnum signatures (Arasu, Ganti and Kaushik 2006).

Sets are the distinct 5-word shingles of texts. Sizes are cut into bands [l, r] with r about l / 0.75, so two sets
that link lie in one band or in neighbouring ones. Instance i serves the pairs of band i and those of band i - 1 with
band i; such sets differ in at most k_i elements. The feature domain is hashed into about k_i + 1 partitions of two
sub-partitions each, and of each partition the subsets of one sub-partition are enumerated (PartEnum's n2 = 2, k2 = 1): a
signature is the instance, the sub-partition and the set's projection on it. At most h sub-partitions hold one of h
differing elements, so a set with m non-empty ones shares at least m - h signatures with any set that it links with, where h
follows from its own size; empty projections are left out (a set with m <= h emits its empty ones too). Requiring m - h
shared signatures stands for enumerating the subsets of m - h sub-partitions. Subsets of two of three (n2 = 3) were
measured: 1.2 to 1.4 signatures a shingle in place of 1.1, and half as many sets again that pass step 2.

1. ``_summaries``: one row a text: set size, set key (a 64-bit hash of the set), signatures needed.
2. ``_blobs``, ``_count_shared``: signatures of all sets, packed by hash into blobs (8 bytes a signature, not a row each);
   each part is sorted and every set's shared signatures are counted. A set with fewer than it needs in both of its
   instances can't link with any other set; the rest are *survivors*. A common passage alone seldom passes this.
3. ``_hub_pairs``, ``_best``: in each bucket of survivors a few members that share most signatures are hubs, and
   each other member is paired with them. A member's pairs with a hub are counted over all its buckets, and those that
   share as many as a link implies, or most of all, are verified on the whole sets: a few pairs a member however large its group.
4. ``_shared_of``, ``_prefix``, ``_cross_pairs``: what may still link two components. Buckets are ordered by how many components
   they hold; sets that must share t of their signatures share one among all but the t - 1 last in that order, so very
   common buckets are not expanded. A pair that shares many such signatures meets in many parts: every set carries its LEADERS
   (the least of its prefix by hash), and a pair with common leaders is made at the first of them only, where both sets are. Pairs
   there of different components are verified. So every link between different texts is used or implied by others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, LOWER, U64, binary_array, checkpointed, components, mix64, pack, partitions, release, slice_hashes, text_blocks, words_of

WORDS = 5
#: 64-bit packed signatures: the low NODE_BITS name the set and its instance, the rest is the signature within its part.
NODE_BITS = 36
#: Hubs of a bucket, and pairs that a member tries however few signatures they share.
HUBS, BEST = 4, 3
#: Signatures of its prefix that a set carries along, so that a pair is made at one of them.
LEADERS = 8
#: Bits of a set's bitmap.
BITMAP = 512
#: About so many bytes of signatures or sets make one part.
PART_BYTES = 32 << 20
_NODE = U64((1 << NODE_BITS) - 1)
_NONE = U64((1 << 64) - 1)


def _bands(longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest size of each band: r is the largest size with 0.75 * r <= l, so two bands always hold all partners."""
    low, high, at = [], [], 1
    while at <= longest:
        top = max(at, at * 4 // 3)
        low.append(at)
        high.append(top)
        at = top + 1
    return np.array(low), np.array(high)


LOW, HIGH = _bands(1 << 40)


def differ(i: np.ndarray) -> np.ndarray:
    """The most elements by which linked sets of instance i differ: (a + b) / 7 at overlap 3 / 7 of a + b, a and b as allowed there."""
    return (2 * HIGH[i]) // 7


def parts_of(i: np.ndarray) -> np.ndarray:
    """How many sub-partitions instance i cuts the domain into: two for each of about k + 1 partitions."""
    return 2 * (differ(i) + 1) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    starts, ends, upto = words_of(data, offsets)
    if not len(starts):
        return [np.zeros(0, U64)] * (len(offsets) - 1)
    words = slice_hashes(BYTE_HASH[LOWER[data]], starts, ends)
    factors = mix64(np.arange(1, WORDS + 1, dtype=U64)) | U64(1)
    n = len(words) - WORDS + 1
    grams = mix64(sum((words[j : j + n] * factors[j] for j in range(WORDS)), np.zeros(max(n, 0), U64))) if n > 0 else np.zeros(0, U64)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= WORDS:
            g = np.sort(grams[a : b - WORDS + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            out.append(mix64((words[a:b] * factors[: b - a]).sum(dtype=U64, keepdims=True) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set, role) of all signatures, and (set, role) -> shared signatures that a partner implies.

    Role 0 is the set's own band as the upper one, role 1 the next instance, where its band is the lower one. The result
    is ordered by role and set.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    need = np.zeros((len(sets), 2), np.int64)
    if not len(full):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), need
    flat = np.concatenate([sets[i] for i in full])
    owner = np.repeat(full, sizes[full])
    band = np.searchsorted(LOW, sizes, side="right") - 1
    mixed = mix64(flat ^ U64(0xABCD))
    out = []
    for role in (0, 1):
        instance = band + role
        apart = (sizes + np.minimum(HIGH[instance], sizes * 4 // 3)) // 7  # the most elements by which a partner differs
        n = parts_of(instance)
        part = ((flat >> U64(32)) * n[owner].astype(U64)) >> U64(32)  # sorted sets have ascending parts
        cuts = np.concatenate([[0], np.flatnonzero((part[1:] != part[:-1]) | (owner[1:] != owner[:-1])) + 1])
        content = np.add.reduceat(mixed, cuts)
        whose, which = owner[cuts], part[cuts]
        used = np.bincount(whose, minlength=len(sets))
        need[:, role] = np.maximum(1, used - apart)
        poor = full[used[full] <= apart[full]].tolist()
        if poor:  # their empty sub-partitions count as well
            more = [(i, p) for i in poor for p in sorted(set(range(int(n[i]))) - set(which[whose == i].tolist()))]
            whose = np.concatenate([whose, np.array([m[0] for m in more], dtype=whose.dtype)])
            which = np.concatenate([which, np.array([m[1] for m in more], dtype=which.dtype)])
            content = np.concatenate([content, np.zeros(len(more), U64)])
            order = np.argsort(whose, kind="stable")
            whose, which, content = whose[order], which[order], content[order]
        out.append((mix64(content ^ mix64(which + mix64(instance[whose].astype(U64)))), whose, np.full(len(whose), role)))
    return *(np.concatenate([o[j] for o in out]) for j in range(3)), need


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each set's elements."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([[U64(0)], np.cumsum(mix64(flat ^ U64(0x1357)), dtype=U64)])
    return mix64(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(U64))


def _as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _node(key: np.ndarray, role: np.ndarray) -> np.ndarray:
    return ((key << U64(1)) | role.astype(U64)) & _NODE


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch):
            sets = shingle_sets(data, offsets)
            need = signatures(sets)[3]
            cols = [batch.column(i).slice(first, end - first) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(s) for s in sets], pa.int64()), _as_long(set_keys(sets)), pa.array(need[:, 0]), pa.array(need[:, 1])], [*batch.schema.names[:-1], "n_shingles", "key", "need0", "need1"])


def _blobs(parts: int):
    """Signatures by part, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch):
                sets = shingle_sets(data, offsets)
                key, once = np.unique(set_keys(sets), return_index=True)  # equal sets of a block go out once
                sig, whose, role, _ = signatures([sets[i] for i in once])
                got = list(pack(sig, [(mix64(sig) << U64(NODE_BITS)) | _node(key[whose], role)], parts))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1][0].tobytes() for g in got], pa.binary())], ["part", "blob"])

    return run


def _count_shared(parts: int):
    """Per part: how often each (set, instance) shares a signature with another set, packed by set for the sum."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        packed = np.unique(np.frombuffer(b"".join(rows["blob"]), U64))  # a group of equal sets is one entry
        sig = packed >> U64(NODE_BITS)
        same = np.concatenate([[False], sig[1:] == sig[:-1]])
        shared = same | np.concatenate([same[1:], [False]])
        node, count = np.unique(packed[shared] & _NODE, return_counts=True)
        got = list(pack(mix64(node), [node | (np.minimum(count, (1 << 27) - 1).astype(U64) << U64(NODE_BITS))], parts)) if len(node) else []
        return pd.DataFrame({"part": pd.Series([g[0] for g in got], dtype="int32"), "blob": [g[1][0].tobytes() for g in got]})

    return run


def _sum_shared(rows: pd.DataFrame) -> pd.DataFrame:
    packed = np.frombuffer(b"".join(rows["blob"]), U64)
    node, at = np.unique(packed & _NODE, return_inverse=True)
    total = np.bincount(at, weights=(packed >> U64(NODE_BITS)).astype(np.float64), minlength=len(node))
    return pd.DataFrame({"node": node.view(np.int64), "shared": total.astype(np.int64)})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in text_blocks(batch):
            sets = shingle_sets(data, offsets)
            flat = np.concatenate(sets).view(np.uint8)
            edges = np.concatenate([[0], np.cumsum([8 * len(s) for s in sets])])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), _as_long(set_keys(sets)), binary_array(flat, edges)], ["shared", "key", "hashes"])


_PACKED = "part int, heads binary, counts binary, values binary"
#: Columns of a head, which stands for one set in one instance: key, component, order as a hub, size << 32 | signatures needed << 1 | parity of the instance; then the set's bitmap.
_KEY, _COMP, _ORDER, _META = range(4)
_WIDE = 4 + BITMAP // 64


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """BITMAP bits a set: whether an odd number of its elements hash to each. Two sets differ in at least as many elements as bits."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, U64)
    at = owner * BITMAP + (mix64(flat) % U64(BITMAP)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * BITMAP) & 1).astype(np.uint8).reshape(len(sets), BITMAP)
    return np.packbits(odd, axis=1).view(U64)


def _packed(at: np.ndarray, parts: int, heads: np.ndarray, owner: np.ndarray, values: np.ndarray) -> dict[str, list]:
    """Rows by part ``at`` of values (n, c): a part's values, the heads that own them and how many each owns; ``owner`` ascends."""
    rows: dict[str, list] = {c: [] for c in ("part", "heads", "counts", "values")}
    for part, (own, *columns) in pack(at, [owner, *values.T], parts):
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for name, value in (("part", part), ("heads", heads[own[first]].tobytes()), ("counts", np.diff(np.append(first, len(own))).astype(np.uint32).tobytes()), ("values", np.stack(columns, 1).tobytes())):
            rows[name].append(value)
    return rows


def _as_frame(rows: dict[str, list]) -> pd.DataFrame:
    return pd.DataFrame(rows).astype({"part": "int32"})


def _unpacked(rows: pd.DataFrame, width: int, wide: int = _WIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(heads, index of each value's head, values) of a part."""
    heads = np.frombuffer(b"".join(rows["heads"]), U64).reshape(-1, wide)
    counts = np.frombuffer(b"".join(rows["counts"]), np.uint32)
    return heads, np.repeat(np.arange(len(heads)), counts), np.frombuffer(b"".join(rows["values"]), U64).reshape(-1, width)


def _labelled(parts: int):
    """Packed signatures of survivors: from key, hashes, comp and shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, comp = (batch.column(i).to_numpy().view(U64) for i in (0, 2))
            central = np.minimum(batch.column(3).to_numpy(), (1 << 24) - 1).astype(U64)
            sets = [np.frombuffer(x, U64) for x in batch.column(1).to_pylist()]
            sig, whose, role, need = signatures(sets)
            size = np.array([len(s) for s in sets], np.int64)
            band = np.searchsorted(LOW, size, side="right") - 1
            order = (U64((1 << 24) - 1) - central) << U64(40) | mix64(key) >> U64(24)
            meta = [size.astype(U64) << U64(32) | need[:, r].astype(U64) << U64(1) | ((band + r) & 1).astype(U64) for r in (0, 1)]
            bits = bitmaps(sets)
            heads = np.concatenate([np.concatenate([np.stack([key, comp, order, m], 1), bits], axis=1) for m in meta])
            rows = _packed(sig, parts, heads, whose + role * len(sets), sig[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), *(pa.array(rows[c], pa.binary()) for c in ("heads", "counts", "values"))], ["part", "heads", "counts", "values"])

    return run


def _size(heads: np.ndarray) -> np.ndarray:
    return (heads[:, _META] >> U64(32)).astype(np.int64)


def _need(heads: np.ndarray) -> np.ndarray:
    return (heads[:, _META] >> U64(1) & U64((1 << 31) - 1)).astype(np.int64)


def _buckets(heads: np.ndarray, who: np.ndarray, sig: np.ndarray, by: int) -> tuple[np.ndarray, ...]:
    """Head of each entry of the buckets that hold several components, ordered by signature and column ``by``; edges of the buckets; their signatures."""
    order = np.lexsort((heads[who, by], sig))
    who, sig = who[order], sig[order]
    comp = heads[who, _COMP]
    first = np.concatenate([[0], np.flatnonzero(sig[1:] != sig[:-1]) + 1]) if len(sig) else np.zeros(0, np.int64)
    if not len(first):
        return who, np.zeros(1, np.int64), sig
    sizes = np.diff(np.append(first, len(sig)))
    several = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
    keep = np.repeat(several, sizes)
    return who[keep], np.concatenate([[0], np.cumsum(sizes[several])]), sig[first[several]]


def _may_link(heads: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs (i, j) of heads of different components that their sizes and bitmaps allow to link."""
    size, comp = _size(heads), heads[:, _COMP]
    at = np.flatnonzero((comp[i] != comp[j]) & (np.minimum(size[i], size[j]) * 4 >= np.maximum(size[i], size[j]) * 3))
    apart = np.zeros(len(at), np.int64)
    for c in range(4, _WIDE):
        apart += np.bitwise_count(heads[i[at], c] ^ heads[j[at], c])
    return at[7 * apart <= size[i[at]] + size[j[at]]]


def _hub_pairs(parts: int):
    """Of each bucket, its members with its first HUBS in hub order; how often the part has each pair, packed by member."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heads, who, values = _unpacked(rows, 1)
        who, edges, _ = _buckets(heads, who, values[:, 0], _ORDER)
        begin, sizes = np.repeat(edges[:-1], np.diff(edges)), np.repeat(np.diff(edges), np.diff(edges))
        codes, times, n = np.zeros(0, np.int64), np.zeros(0, np.int64), len(heads)
        for t in range(HUBS):
            at = np.flatnonzero((np.arange(len(who)) - begin > t) & (sizes > t))
            i, j = who[at], who[begin[at] + t]
            ok = _may_link(heads, i, j)
            codes, where = np.unique(np.concatenate([codes, i[ok] * n + j[ok]]), return_inverse=True)
            times = np.bincount(where, weights=np.concatenate([times, np.ones(len(ok), np.int64)]), minlength=len(codes)).astype(np.int64)
        i, j = (codes // n, codes % n) if n else (codes, codes)
        return _as_frame(_packed(mix64(heads[i, _KEY]), parts, heads, i, np.stack([heads[j, _KEY], times.astype(U64)], 1)))

    return run


def _best(rows: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a member and a hub that share as many signatures as a link implies, and each member's BEST by how many they share."""
    heads, who, values = _unpacked(rows, 2)
    member, hub, times = heads[who, _KEY], values[:, 0], values[:, 1].astype(np.int64)
    odd = (heads[who, _META] & U64(1)).astype(np.int64)
    order = np.lexsort((odd, hub, member))
    member, hub, times, odd, need = member[order], hub[order], times[order], odd[order], _need(heads)[who][order]
    first = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (hub[1:] != hub[:-1]) | (odd[1:] != odd[:-1])])) if len(member) else np.zeros(0, np.int64)
    if not len(first):
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    total = np.add.reduceat(times, first)
    member, hub, need = member[first], hub[first], need[first]
    order = np.lexsort((-total, member))
    begin = np.flatnonzero(np.concatenate([[True], member[order][1:] != member[order][:-1]]))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    take = order[(rank < BEST) | (total >= need)[order]]
    return pd.DataFrame({"a": np.minimum(member[take], hub[take]).view(np.int64), "b": np.maximum(member[take], hub[take]).view(np.int64)}).drop_duplicates()


def _shared_of(parts: int):
    """Of each bucket with several components, to its sets: the signature and how many components it holds."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heads, who, values = _unpacked(rows, 1)
        who, edges, sig = _buckets(heads, who, values[:, 0], _COMP)
        comp = heads[who, _COMP]
        new = np.concatenate([[0], comp[1:] != comp[:-1]]).astype(np.int64) if len(comp) else np.zeros(0, np.int64)
        new[edges[:-1][: len(sig)]] = 1
        held = np.add.reduceat(new, edges[:-1]) if len(sig) else new
        sizes = np.diff(edges)
        order = np.argsort(who, kind="stable")
        out = np.stack([np.repeat(sig, sizes), np.repeat(held, sizes).astype(U64)], 1)[order]
        return _as_frame(_packed(mix64(heads[who[order], _KEY]), parts, heads, who[order], out))

    return run


def _prefix(parts: int):
    """Of each set's shared signatures all but the last (needed - 1), the fewest components first; packed by signature, heads with their leaders."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        heads, who, values = _unpacked(rows, 2)
        if not len(heads):
            return _as_frame(_packed(values[:, 0], parts, heads, who, values[:, :1]))
        _, first, owner = np.unique(heads[:, [_KEY, _META]], axis=0, return_index=True, return_inverse=True)
        heads, of = heads[first], owner.ravel()[who]  # a set's heads from several parts are one
        order = np.lexsort((values[:, 0], values[:, 1], of))
        of, sig = of[order], values[order, 0]
        shared = np.bincount(of, minlength=len(heads))
        begin = np.concatenate([[0], np.cumsum(shared)])[of]
        keep = np.arange(len(of)) - begin < shared[of] - _need(heads)[of] + 1
        of, sig = of[keep], sig[keep]
        return _as_frame(_packed(sig, parts, np.concatenate([heads, _leaders(of, sig, len(heads))], axis=1), of, sig[:, None]))

    return run


def _leaders(of: np.ndarray, sig: np.ndarray, n: int) -> np.ndarray:
    """The LEADERS least hashes of the signatures of each of n sets, in order; where it has fewer, _NONE."""
    mixed = mix64(sig)
    order = np.lexsort((mixed, of))
    of, mixed = of[order], mixed[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    out = np.full((n, LEADERS), _NONE)
    out[of[rank < LEADERS], rank[rank < LEADERS]] = mixed[rank < LEADERS]
    return out


def _made_here(heads: np.ndarray, i: np.ndarray, j: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """Whether the bucket of ``sig`` is where the pair (i, j) of heads is made: the first leader that both have, or any bucket if they have none in common."""
    a, b = heads[i, _WIDE:], heads[j, _WIDE:]
    first = np.full(len(i), _NONE)
    for c in range(LEADERS):
        first = np.minimum(first, np.where((a == b[:, c : c + 1]).any(axis=1), b[:, c], _NONE))
    return (first == _NONE) | (first == mix64(sig))


def _upper(heads: np.ndarray) -> np.ndarray:
    """Whether a head stands for its set in the instance of its own band (role 0)."""
    band = np.searchsorted(LOW, _size(heads), side="right") - 1
    return (heads[:, _META] & U64(1)).astype(np.int64) == band & 1


def _cross_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Of each bucket, pairs of members of different components that sizes and bitmaps allow to link and that are made there; buckets are taken in passes of bounded pairs.

    Two sets of one band meet in two instances; the one of their own band has every pair that links.
    """
    heads, who, values = _unpacked(rows, 1, _WIDE + LEADERS)
    names, name = np.unique(heads[:, _KEY], return_inverse=True)
    who, edges, sig = _buckets(heads, who, values[:, 0], _KEY)
    sig, upper = np.repeat(sig, np.diff(edges)), _upper(heads)
    after = np.repeat(edges[1:], np.diff(edges)) - np.arange(len(who)) - 1  # later members of the own bucket
    upto = np.concatenate([[0], np.cumsum(after)])
    codes, at = np.zeros(0, np.int64), 0
    while at < len(who):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + 2_000_000, side="right")) - 1)
        n = after[at:end]
        i = np.repeat(np.arange(at, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        own = sig[i]
        i, j = who[i], who[j]
        some = np.flatnonzero(upper[i] | upper[j])
        some = some[_may_link(heads, i[some], j[some])]
        ok = some[_made_here(heads, i[some], j[some], own[some])]
        a, b = name[i[ok]], name[j[ok]]
        codes = np.unique(np.concatenate([codes, np.minimum(a, b) * len(names) + np.maximum(a, b)]))
        at = end
    a, b = (names[codes // len(names)], names[codes % len(names)]) if len(codes) else (names[:0], names[:0])
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets have 100 * intersection >= 75 * union."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            if min(len(s), len(t)) * 4 < max(len(s), len(t)) * 3:
                keep.append(False)
                continue
            both = np.sort(np.concatenate([s, t]), kind="stable")
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= 75 * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("ha")), "a")
    both = with_a.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb")
    return both.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, text_key, kept for every row of ``docs`` (doc_id, text, any other columns).

    Texts are lower-cased (A-Z) and cut into words at space and 0x09-0x0D; a set is the distinct 5-word shingles, with
    fewer words the whole sequence as one, with none empty and linked with nothing. Two sets link when
    100 * |A and B| >= 75 * |A or B|. component_id is the smallest doc_id reachable by links, own one included. Null texts
    count as empty. A null doc_id takes part as a text; its own row has the smallest other doc_id of its component or null.
    Repeated rows are equal sets. ``kept``: the row with the smallest doc_id of its component stands for it (a null doc_id after
    all others; then the smallest text_key, an xxhash64 of the text), and so does each row that repeats it. Other columns are not read, so their names can't clash. Empty tables give no rows. Set
    elements and keys are 64-bit hashes. ``parts``: how many parts signatures are dealt to; by default as their bytes ask for.
    """
    session = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = checkpointed(docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(_summaries, f"doc_id {kind}, text_key long, n_shingles long, key long, need0 long, need1 long"))
    parts = parts or max(partitions(session), 10 * int(rows.agg(F.sum("n_shingles")).first()[0] or 0) // PART_BYTES + 1)
    blobs = docs.select("text").mapInArrow(_blobs(parts), "part int, blob binary")
    counted = blobs.groupBy("part").applyInPandas(_count_shared(parts), "part int, blob binary")
    shared = checkpointed(counted.groupBy("part").applyInPandas(_sum_shared, "node long, shared long"))
    del blobs, counted
    release(session)
    # one row of each set fetches its text: by doc_id too, so that copies of one text do not meet in one task
    sets = rows.where("n_shingles > 0").groupBy("key").agg(F.min(F.struct("text_key", "doc_id")).alias("at"), F.min("need0").alias("need0"), F.min("need1").alias("need1"))
    mask = (1 << NODE_BITS) - 1
    asked = sets.select("at", F.explode(F.array(*(F.struct((F.shiftleft("key", 1).bitwiseOR(F.lit(r).cast("long"))).bitwiseAND(F.lit(mask)).alias("node"), F.col(f"need{r}").alias("need")) for r in (0, 1)))).alias("x")).select("at", "x.*")
    survivors = asked.join(shared, "node").where("shared >= need").groupBy("at").agg(F.sum("shared").alias("shared")).select(F.col("at.text_key").alias("_key"), F.col("at.doc_id").alias("_id"), "shared")
    texts = docs.withColumn("text_key", F.xxhash64("text")).join(survivors, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("shared", "text")
    own = checkpointed(texts.mapInArrow(_sets, "shared long, key long, hashes binary").groupBy("key").agg(F.first("hashes").alias("hashes"), F.max("shared").alias("shared")))
    del texts
    release(session)
    size = int(own.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0)
    dealt = max(min(partitions(session), 1 + (size >> 20)), size // PART_BYTES + 1)
    alone = own.withColumn("comp", F.col("key")).select("key", "hashes", "comp", "shared")
    found = alone.mapInArrow(_labelled(dealt), _PACKED).groupBy("part").applyInPandas(_hub_pairs(dealt), _PACKED)
    tried = checkpointed(found.groupBy("part").applyInPandas(_best, "a long, b long").distinct())
    links = checkpointed(_verify(tried, own))
    joined = components(links, "a", "b")
    labels = own.join(joined, own.key == joined.node, "left").select("key", "hashes", F.coalesce("comp", "key").alias("comp"), "shared")
    del found
    release(session)
    sent = labels.mapInArrow(_labelled(dealt), _PACKED).groupBy("part").applyInPandas(_shared_of(dealt), _PACKED)
    cross = sent.groupBy("part").applyInPandas(_prefix(dealt), _PACKED).groupBy("part").applyInPandas(_cross_pairs, "a long, b long").distinct()
    new = checkpointed(cross.join(tried, ["a", "b"], "left_anti"))
    del cross, sent, labels
    release(session)
    joined = components(links.unionByName(_verify(new, own)), "a", "b")
    stands = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    least = rows.where("n_shingles > 0").groupBy("key").agg(stands.alias("first")).join(joined, F.col("key") == F.col("node"), "left").select("key", "first", F.coalesce("comp", "key").alias("comp"))
    whole = least.groupBy("comp").agg(F.min("first").alias("rep"))
    named = least.join(whole, "comp").select(F.col("key").alias("_key"), "rep")
    kept = F.col("rep").isNull() | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & F.col("text_key").eqNullSafe(F.col("rep.text_key")))
    out = rows.join(named, (rows.key == F.col("_key")) & (rows.n_shingles > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("rep.doc_id", "doc_id").alias("component_id"), "text_key", kept.alias("kept"))
