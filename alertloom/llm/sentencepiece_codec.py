"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

Pieces come from a model file (never trained here). A text is normalised as the model asks (spaces become the marker
U+2581, one is put in front), then cut before every marker that follows another character: no piece has a marker after
another character, so no best path crosses such a cut and each run ("word") is solved once however often it occurs.
All distinct words of a block are solved together: the trie is walked for all start positions at once, then one
dynamic-programming step a position serves all words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What one character costs when no piece covers it, below the worst piece (as the public implementation has it).
UNKNOWN_PENALTY = 10.0


class PieceTrie:
    """A double-array trie over the UTF-8 bytes of the pieces: child of s by byte c is base[s] + c if check[base[s] + c] == s."""

    def __init__(self, pieces: list[bytes], ids: list[int], scores: list[float]):
        children: list[dict[int, int]] = [{}]
        leaf: dict[int, int] = {}
        for piece, i in zip(pieces, ids, strict=True):
            at = 0
            for c in piece:
                if c not in children[at]:
                    children.append({})
                    children[at][c] = len(children) - 1
                at = children[at][c]
            leaf[at] = i
        size = 3 * len(children) + 2048
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken = bytearray(size)
        taken[0] = 1
        place, start = {0: 0}, 1
        queue = [0]
        for node in queue:  # grows while it runs: breadth first
            s = place[node]
            if node in leaf:
                value[s] = leaf[node]
            if not children[node]:
                continue
            codes = sorted(children[node])
            at, tries = max(1, start - codes[0]), 0
            while any(taken[at + c] for c in codes):
                at += 1
                tries += 1
                if at + 257 > len(taken):
                    grow = len(taken)
                    base, check, value = (np.concatenate([x, np.full(grow, y, x.dtype)]) for x, y in ((base, 0), (check, -1), (value, -1)))
                    taken += bytearray(grow)
            if len(codes) == 1 and tries or tries > 64:  # the crowded front is searched no more
                start = max(start, at + codes[0] - 32 if tries <= 64 else at + codes[0])
            base[s] = at
            for c in codes:
                check[at + c], taken[at + c] = s, 1
                place[children[node][c]] = at + c
                queue.append(children[node][c])
        self.base, self.check, self.value = base, check, value
        self.score = np.zeros(max(ids, default=0) + 1)
        self.score[ids] = scores
        self.longest = max(map(len, pieces), default=0)


class Codec:
    """Encode and decode by one model file. Pieces, scores and byte pieces are read from it; the search is this module's own."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        scores = [model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece has a marker after another character: words can't be solved apart")
        self.unknown = model.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.fallback = bool((self.byte_ids != self.unknown).all())
        self.is_byte = {i: int(self.pieces[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.trie = PieceTrie([self.pieces[i].encode() for i in plain], plain, [scores[i] for i in plain])
        self.worst = min(scores[i] for i in plain) - UNKNOWN_PENALTY
        self.memory: dict[str, list[int]] = {}
        self.spelled = [b"" if i in self.control else bytes([self.is_byte[i]]) if i in self.is_byte else " ⁇ ".encode() if i == self.unknown else self.pieces[i].encode() for i in range(n)]
        self.byte_piece = np.zeros(n, bool)
        self.byte_piece[list(self.is_byte)] = True

    def words(self, text: str) -> list[str]:
        """The marked text, cut before each marker that follows another character."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return [MARK + part for part in parts]
        out, run = [], ""
        for part in parts:  # an empty part is a marker that another marker follows
            run += MARK
            if part:
                out.append(run + part)
                run = ""
        if run:
            out.append(run)
        return out

    def solve(self, words: list[str]) -> None:
        """Put the ids of each word into the memory, all solved together in passes of bounded size."""
        words = sorted(words, key=len)
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) * 3 < 200_000):
                size += len(words[end]) * 3
                end += 1
            self._solve(words[at:end])
            at = end

    def _solve(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        data = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw])
        starts = np.concatenate([[0], np.cumsum(sizes)])
        stop = np.repeat(starts[1:], sizes)
        lead = (data & 0xC0) != 0x80
        begins = np.flatnonzero(lead)
        trie = self.trie
        # walk the trie from every character at once; what ends on a piece is an arc (from, to, id)
        froms, tos, pids = [], [], []
        pos, state, step = begins, np.zeros(len(begins), np.int32), 0
        while len(pos):
            code = trie.base[state] + data[pos + step]
            ok = (trie.check[code] == state) & (trie.base[state] > 0)
            pos, state = pos[ok], code[ok]
            hit = trie.value[state] >= 0
            froms.append(pos[hit])
            tos.append(pos[hit] + step + 1)
            pids.append(trie.value[state][hit])
            step += 1
            more = pos + step < stop[pos]
            pos, state = pos[more], state[more]
        width = np.diff(np.append(begins, len(data)))
        # a character that is no piece by itself: the unknown arc
        frm, to, pid = np.concatenate(froms), np.concatenate(tos), np.concatenate(pids)
        whole = np.zeros(len(data) + 1, bool)
        char_end = np.zeros(len(data) + 1, np.int64)
        char_end[begins] = begins + width
        whole[frm[to == char_end[frm]]] = True
        lone = begins[~whole[begins]]
        frm, to = np.concatenate([frm, lone]), np.concatenate([to, char_end[lone]])
        gain = np.concatenate([trie.score[pid], np.full(len(lone), self.worst)])
        pid = np.concatenate([pid, np.full(len(lone), -1, pid.dtype)])
        # forward pass by distance from the word's start, all words in step; of equal paths the longest last piece stays
        word_start = np.repeat(starts[:-1], sizes)
        depth = to - word_start[frm]
        order = np.lexsort((frm, to, depth))
        frm, to, pid, gain, depth = frm[order], to[order], pid[order], gain[order], depth[order]
        # positions are per word: slot of (word, offset) = byte position, offset 0 is the word's start with score 0
        value_at = np.full(len(data) + len(words) + 1, -np.inf)
        shift = np.repeat(np.arange(len(words)), sizes)  # one slot more for each earlier word, so an end never is the next word's start
        slot_from, slot_to = frm + shift[frm], to + shift[frm]
        value_at[starts[:-1] + np.arange(len(words))] = 0.0
        back = np.full(len(value_at), -1, np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            total = value_at[slot_from[a:b]] + gain[a:b]
            target = slot_to[a:b]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(target)) + 1])
            top = np.maximum.reduceat(total, cuts)
            group = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, b - a)))
            winner = np.flatnonzero(total == top[group])
            firsts = winner[np.unique(group[winner], return_index=True)[1]]
            value_at[target[cuts]] = top
            back[target[cuts]] = a + firsts
        # all paths back at once: one arc of each unfinished word a step
        ends, floors = starts[1:] + np.arange(len(words)), starts[:-1] + np.arange(len(words))
        alive, slot = np.arange(len(words)), ends.copy()
        who, arcs = [], []
        while len(alive):
            arc = back[slot]
            who.append(alive)
            arcs.append(arc)
            slot = slot_from[arc]
            more = slot > floors[alive]
            alive, slot = alive[more], slot[more]
        who, arcs = np.concatenate(who)[::-1], np.concatenate(arcs)[::-1]
        order = np.argsort(who, kind="stable")
        who, arcs = who[order], arcs[order]
        edge = np.searchsorted(who, np.arange(len(words) + 1)).tolist()
        ids = pid[arcs].tolist()
        unknown = set(np.flatnonzero(np.diff(np.searchsorted(np.flatnonzero(pid[arcs] < 0), edge))).tolist())
        for i, word in enumerate(words):
            if i not in unknown:
                self.memory[word] = ids[edge[i] : edge[i + 1]]
                continue
            own: list[int] = []
            for k in range(edge[i], edge[i + 1]):
                own += [ids[k]] if ids[k] >= 0 else self.byte_ids[data[frm[arcs[k]] : to[arcs[k]]]].tolist() if self.fallback else [self.unknown]
            self.memory[word] = own

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; an empty text has none."""
        cut = [self.words(t) if t else [] for t in texts]
        if len(self.memory) > 400_000:  # bounded; words are solved anew when they come again
            self.memory.clear()
        new = {w for ws in cut for w in ws if w not in self.memory}
        if new:
            self.solve(list(new))
        memory = self.memory
        return [list(chain.from_iterable(map(memory.__getitem__, ws))) for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, runs of byte pieces read as UTF-8 (a broken run gives U+FFFD), markers back to spaces, the first one dropped."""
        out = b"".join(map(self.spelled.__getitem__, ids))
        text = out.decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@cache
def codec(path: str) -> Codec:
    """The codec of a model file, once a process."""
    return Codec(path)


def _blocks(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield first, i
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for a, b in _blocks(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own.encode([t or "" for t in texts[a:b]]), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and ids (array<int>, empty for a null or empty text) of every row of ``docs`` (doc_id, text, any others)."""
    return docs.select("doc_id", "text").mapInArrow(_encode(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of every row of (doc_id, ids); null ids give an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            for a, b in _blocks(texts):
                part = [t or "" for t in texts[a:b]]
                ids = own.encode(part)
                arrays = [np.array(i, "<i4") for i in ids]
                back = [own.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([int(own.byte_piece[x].sum()) for x in arrays], pa.int64()),
                        pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in arrays]),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]),
                        pa.array([x == y for x, y in zip(part, back, strict=True)]),
                    ],
                    ["doc_id", "n_pieces", "n_bytes", "ids_sha256", "decoded_sha256", "round_trip"],
                )

    return run


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row: doc_id, n_pieces, n_bytes (byte-fallback ids), ids_sha256 (little-endian int32), decoded_sha256, round_trip.

    One pass encodes and decodes, so ids never leave the worker. Texts with the marker character itself decode to spaces there, as the format has it.
    """
    return docs.select("doc_id", "text").mapInArrow(_digest(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pieces long, n_bytes long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
