"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alertloom.llm import attention_lm, embedding_neighbours, exact_dedup, jaccard_join, packing, quality, secrets, sentencepiece_codec, suffix_dedup, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Column names that operators use inside; a table may have them too.
CLASH = "key string, chunk string, node long, text_key string, part int, score double, row long, comp long, block long, source string, lang string"
EMPTY = "doc_id long, text string, " + CLASH


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Schön", "über", "data", "x", "niño", "report", "alpha", "beta", "||", "naïve", "日本", "model", "graph"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(160)
    out = [None, "", " ", "a", "A", "one two three", "\t\n", text(3000), "z" * 1500, "ab" * 700]
    for _ in range(n - len(out)):
        base = text(rng.randrange(1, 120))
        out += [base] if rng.random() < 0.5 else [base, base, base.replace("data", "Data", 1), base + " tail"]
        if rng.random() < 0.2:
            out.append(text(20) + " " + passage + " " + text(20))
    return list(enumerate(out)), rng


@pytest.fixture(scope="module")
def table(spark):
    data, rng = rows()
    full = [(i, t, "k", "c", 1, "t", 2, 0.5, 3, 4, 5, f"src{0 if rng.random() < 0.4 else rng.randrange(9)}" if i % 11 else None, "en") for i, t in data]
    full, data = full + full[12:14], data + data[12:14]  # rows that repeat
    return spark.createDataFrame(full, EMPTY).repartition(3), data


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


def test_exact_duplicates(table):
    df, data = table
    last, size = {}, collections.Counter()
    for i, t in data:
        last[t or ""] = max(last.get(t or "", -1), i)
        size[t or ""] += 1
    for width in (16, 1):  # with one byte chunks clash, so identifiers must grow
        got = sorted(map(tuple, exact_dedup.exact_duplicates(df, width).collect()))
        assert got == sorted((i, last[t or ""], size[t or ""], i == last[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in data)


def test_chunks_are_bounded_and_follow_content():
    data = np.frombuffer(random.Random(1).randbytes(60_000) + b"a" * 40_000, np.uint8)
    cuts, counts = exact_dedup.cut_points(data, np.array([0, len(data)]))
    sizes = np.diff(cuts)
    assert cuts[-1] == len(data) and counts[0] == len(sizes) and sizes.max() <= exact_dedup.MOST and sizes[:-1].min() >= exact_dedup.LEAST
    shifted = np.concatenate([np.frombuffer(b"prefix", np.uint8), data])
    moved = exact_dedup.cut_points(shifted, np.array([0, len(shifted)]))[0] - 6
    assert len(set(moved.tolist()) & set(cuts.tolist())) > len(cuts) // 2


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rng = random.Random(seed)
    data, base = [], [[rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randrange(1, 90))] for _ in range(12)]
    for i in range(110):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(3)}"
        data.append((i, " ".join(w)))
    data += [(200, None), (201, ""), (202, " \n"), (3, data[3][1])]
    sets = {i: shingles(t) for i, t in data}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = sorted(map(tuple, jaccard_join.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == sorted((i, len(sets[i]), want[i]) for i, _ in data)


def test_suffix_ranges(table):
    df, data = table
    for length, hot in ((400, 1 << 19), (400, 1), (90, 1 << 19)):
        seen = collections.Counter()
        raw = [(i, (t or "").encode()) for i, t in data]
        for _, b in raw:
            for p in range(len(b) - length + 1):
                seen[b[p : p + length]] += 1
        want = []
        for i, b in raw:
            gone = bytearray(len(b))
            for p in range(len(b) - length + 1):
                if seen[b[p : p + length]] > 1:
                    gone[p : p + length] = b"\1" * length
            runs = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
            rest = bytes(c for p, c in enumerate(b) if not gone[p])
            want.append((i, len(b), len(b) - len(rest), runs, hashlib.sha256(rest).hexdigest()))
        assert sorted(map(tuple, suffix_dedup.remove_repeats(df, length, hot).collect())) == sorted(want)


def test_repeated_starts():
    rng = random.Random(1)
    for _ in range(40):
        length = rng.choice([3, 5, 8])
        base = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 60))) for _ in range(4)]
        pieces = [b"".join(rng.choice(base)[rng.randint(0, 9) :] for _ in range(3)) + bytes([rng.choice(b"xyz")]) for _ in range(6)]
        seen = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if seen[p[i : i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in suffix_dedup.repeated_starts(pieces, length)] == want


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((15, 16))
    vectors = [centres[rng.integers(15)] + 0.25 * rng.standard_normal(16) for _ in range(150)] + [rng.standard_normal(16) for _ in range(100)]
    data = [(i, [float(np.float32(x)) for x in v], "other") for i, v in enumerate(vectors)]
    data += [(300 + k, data[7][1], "copy") for k in range(5)] + [(400, None, ""), (401, [], ""), (402, [0.0] * 16, ""), (403, [1.0, None], ""), (404, [float("nan")] * 16, ""), (405, [2.0 * x for x in data[7][1]], "")]
    good = {i: np.array(v, np.float64) for i, v, _ in data if v and None not in v and np.isfinite(v).all() and any(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    degree = collections.Counter(x for pair in links for x in pair)
    want = components([d[0] for d in data], links)
    got = embedding_neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, degree[i], want[i], want[i] == i) for i, _, _ in data)


def test_blocks_keep_spanning_links_and_no_more_than_lists():
    rng = np.random.default_rng(8)
    steps = np.linspace(0, 3, 120)  # a chain, and a group of which all link
    chain = np.stack([np.cos(steps), np.sin(steps), 0 * steps, 0 * steps], axis=1)
    vectors = np.concatenate([chain, np.array([0, 0, 1, 0]) + 0.05 * rng.standard_normal((200, 4)), np.array([[0, 0, 0, 1.0]])])[rng.permutation(321)]
    unit = embedding_neighbours.unit_rows(vectors)
    got = embedding_neighbours._block_edges(0.95)(pd.DataFrame({"node": np.arange(321), "v": list(vectors)}))
    links = [(a, b) for a in range(321) for b in range(a) if unit[a] @ unit[b] >= 0.95]
    kept = got[got["cosine"] >= 0.95]
    assert components(range(321), list(zip(kept["a"], kept["b"], strict=True))) == components(range(321), links)
    assert len(links) > 20_000 and len(got) <= 321 * (2 * embedding_neighbours.LIST + 1)
    assert (got["a"] < got["b"]).all() and not got.duplicated(["a", "b"]).any()


def test_vectors_of_doubles_stay_doubles(spark):
    data = [(1, [1e300, 0.0]), (2, [1e300, 1e290]), (3, [1.0, 1e-12]), (4, [0.0, 1e-300])]
    got = embedding_neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_low_thresholds_keep_their_edges(spark):
    rng = np.random.default_rng(5)
    first = np.linalg.qr(rng.standard_normal((64, 24)))[0].T
    data = [(i, [float(x) for x in first[i]]) for i in range(12)] + [(12 + i, [float(x) for x in 0.55 * first[i] + (1 - 0.55**2) ** 0.5 * first[12 + i]]) for i in range(12)]
    got = embedding_neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"), threshold=0.5).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 1, i % 12) for i in range(24)}


def test_saturated_lists_are_enlarged(spark):
    axis, rng = np.eye(32), np.random.default_rng(6)
    angle = np.arccos(0.91) / 2
    turned = lambda t: np.cos(t) * axis[0] + np.sin(t) * axis[1]
    groups = [[turned(t)] + [turned(t) + 0.02 * rng.standard_normal(32) for _ in range(14)] for t in (angle, -angle)]
    vectors = [*groups[0], *groups[1], 0.8 * axis[0] + 0.6 * axis[2]]
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    nodes = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(unit)], "node long, v array<float>")
    known = [(a, b) for g in (range(15), range(15, 30)) for a in g for b in g if a < b] + [(0, 30), (15, 30)]
    edges = spark.createDataFrame([(a, b, float(unit[a] @ unit[b])) for a, b in known], "a long, b long, cosine double")
    got = embedding_neighbours.neighbour_graph(nodes, 0.9, range(0), edges, 31).where("cosine >= 0.9 and a < 15 and b between 15 and 29")
    assert got.count()


def test_low_recall_ends_in_an_exact_comparison(spark, monkeypatch):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((20, 16))
    vectors = [centres[0] + 0.02 * rng.standard_normal(16) for _ in range(60)] + [c + 0.02 * rng.standard_normal(16) for c in centres[1:] for _ in range(2)]
    data = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    # only the large group's links are found: nearly all pairs, but one component of 20
    found = spark.createDataFrame([(a, a + 1, 1.0) for a in range(59)], "a long, b long, cosine double")

    def graph(nodes, *_):
        at = {tuple(r["v"]): r["node"] for r in nodes.collect()}
        ids = [at[tuple(v)] for _, v in data]
        return spark.createDataFrame([(*sorted((ids[r["a"]], ids[r["b"]])), 1.0) for r in found.collect()], "a long, b long, cosine double")

    monkeypatch.setattr(embedding_neighbours, "neighbour_graph", graph)
    got = embedding_neighbours.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} == {(i, 59, 0) if i < 60 else (i, 1, i - i % 2) for i in range(98)}


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_secrets(spark):
    live, example = "q8Zr2LmX0vTn4KcB7dHy", "EXAMPLEexample1234567"
    texts = [f'é password = "{live}" end', *(f"token: {example}" for _ in range(6)), "AKIA" + "B7Q2" * 4 + " AKIA1", "deadbeef00112233445566 dead", "API_KEY='short' secret=" + "ab" * 20, None, "", "ſecret=aaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame([(i, t, f"src{i}", "en", 1) for i, t in enumerate(texts)], "doc_id long, text string, source string, lang string, owner int")
    got = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("live")] == [x for x in base.split(",") if x]
    assert got[0]["n_live"] == 1 and all(got[i]["n_live"] == 0 and got[i]["n_example"] == 1 for i in range(1, 7))
    masked = {r["doc_id"]: r["text"] for r in secrets.mask_secrets(df).collect()}
    assert masked[0] == 'é password = "[secret]" end' and masked[1] == texts[1] and len(masked) == len(texts) and masked[10] is None


def test_packing(table):
    df, data = table
    got = packing.pack_documents(df, capacity=600, group_rows=40).collect()
    covered = collections.Counter()
    bins = collections.defaultdict(list)
    source = {r["doc_id"]: r["source"] for r in df.collect()}
    for r in got:
        covered[r["doc_id"]] += r["size"]
        if r["size"]:
            bins[r["bin_group"], r["bin"]].append(r)
        else:
            assert r["bin"] is None
    times = collections.Counter(i for i, _ in data)
    assert covered == {i: len((t or "").encode()) * times[i] for i, t in data}
    text = dict(data)
    for items in bins.values():
        assert sum(r["size"] for r in items) <= 600
        items.sort(key=lambda r: r["bin_offset"])
        assert all(a["bin_offset"] + a["size"] <= b["bin_offset"] for a, b in zip(items, items[1:], strict=False))
        names = [source[r["doc_id"]] for r in items if source[r["doc_id"]] is not None]
        assert len(names) == len(set(names)) and len({text[r["doc_id"]] for r in items}) == len(items)


def test_tightest_compatible_bin():
    rng = random.Random(2)
    sizes = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    sources, clusters = [rng.choice([None, *"abcdefgh"]) for _ in sizes], [rng.randrange(150) for _ in sizes]
    bins, want = [], []
    for s, a, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], i) for i, b in enumerate(bins) if b["room"] >= s and (a is None or a not in b["a"]) and c not in b["c"]]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"room": 100, "a": set(), "c": set()})
        bins[i]["room"] -= s
        bins[i]["a"].add(a)
        bins[i]["c"].add(c)
        want.append(i)
    assert packing.pack(sizes, sources, clusters, 100)[0] == want


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\u3000", "\r\n", "\x1c"])
def test_token_counts_of_long_white_space(space):
    encoding = token_counts.encoder(token_counts.VOCABULARY)
    for n in (1, 2, 4095, 4096, 4097, 20_000, 100_000):
        for text in (space * n, space * n + "x", "x" + space * n, "a " + space * n + " b" + space * n, "." + space * n + "'s" + space * (n + 1) + "1"):
            assert token_counts.count_tokens(encoding, text) == len(encoding.encode_ordinary(text)), (n, text[:3])


def test_token_counts_do_not_crash(spark):
    texts = [f"{a}{space * n}{b}" for n in (1_000_000, 5_000_000) for space in " \t\n" for a, b in (("", ""), ("x", "x"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_lengths(df).collect()}
    piece = token_counts.encoder(token_counts.VOCABULARY)._encode_single_piece
    for i, t in enumerate(texts):
        bare = len(piece(t)) if t[0] != "x" else 1 + len(piece(t[1:-2])) + (1 if t[-2] == " " else 2)
        assert got[i] == bare


def test_token_histogram(table):
    df, data = table
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    n = sorted(len(encode(t or "")) for _, t in data)
    histogram = token_counts.length_histogram(token_counts.token_lengths(df))
    for r in histogram.collect():
        k = r["n_tokens"]
        assert (r["n_docs"], r["docs_from"], r["tokens_from"], r["docs_upto"], r["truncated_total"]) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(x <= k for x in n), sum(min(x, k) for x in n))
    assert {r["context"]: (r["truncated_total"], r["docs_cut"]) for r in token_counts.truncated_totals(histogram, [0, 7, 999999]).collect()} == {c: (sum(min(x, c) for x in n), sum(x > c for x in n)) for c in (0, 7, 999999)}
    assert token_counts.length_quantiles(histogram, [0.5]).first()[0] == n[math.ceil(len(n) / 2) - 1]


def test_pieces(table):
    df, data = table
    own = sentencepiece_codec.codec(sentencepiece_codec.MODEL)
    score = {own.pieces[i]: own.trie.score[i] for i in range(len(own.pieces)) if not (i in own.is_byte or i in own.control or i == own.unknown)}

    def best(text):
        s = "▁" + text.replace(" ", "▁")
        top = [0.0] + [-math.inf] * len(s)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 40), j):
                g = score.get(s[i:j], own.worst if i == j - 1 else None)
                if g is not None:
                    top[j] = max(top[j], top[i] + g)
        return top[-1]

    for t in {t[:400] for _, t in data if t} | {"  a  b ", "日本語 🎉 tëst", "\n\n x"}:
        ids = own.encode([t])[0]
        characters = bytes(own.is_byte[i] for i in ids if i in own.is_byte).decode()
        assert sum(own.trie.score[i] for i in ids if i not in own.is_byte) + own.worst * len(characters) == pytest.approx(best(t))
    back = sentencepiece_codec.decode_pieces(sentencepiece_codec.encode_pieces(df)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == sorted((i, t or "") for i, t in data)
    assert all(r["round_trip"] for r in sentencepiece_codec.piece_digests(df).collect())


def test_language_model(table):
    df, data = table
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in data}
    times = collections.Counter(i for i, _ in data)
    learned = collections.Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for x in w:
                learned[x] += times[i]
    total, distinct = sum(learned.values()), len(learned)
    got = attention_lm.score_texts(df, rounds=1).collect()
    assert len(got) == len(data)
    for r in got:
        w = tokens[r["doc_id"]]
        base = sum(math.log10((learned[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2, len(w), sum(x in learned for x in w), total)
        assert r["base_score"] == pytest.approx(base) and r["score"] < 0 and r["mixed_score"] < 0


@pytest.mark.parametrize("rounds", [1, 2])
def test_every_id_is_learned_from(table, rounds):
    df, data = table
    encode = attention_lm._subwords(attention_lm.VOCABULARY)
    want = sum(1 + sum(len(encode(" " + w)) for w in WORD.findall(lower(t))) for _, t in data)
    assert attention_lm.fit(df, attention_lm.VOCABULARY, rounds)[1] == want


def test_scored_ids_see_half_a_window():
    _, _, _, scored, pos = attention_lm.windows(np.zeros(300, np.int64), np.array([0, 200, 300]), attention_lm.STRIDE)
    at = np.nonzero(scored)[1]
    begins = np.where(pos[scored] < 200, 0, 200)
    assert (at >= np.minimum(attention_lm.WINDOW // 2, pos[scored] - begins)).all()


def test_gradient_and_single_scoring():
    rng = np.random.default_rng(0)
    ids, starts = rng.integers(0, attention_lm.SUBWORDS, 150), np.array([0, 5, 5, 100, 150])
    x, before, y, scored, pos = attention_lm.windows(ids, starts, attention_lm.STRIDE)
    assert sorted(pos[scored].tolist()) == list(range(150)) and (y[scored] == ids[pos[scored]]).all()
    p = {k: v.astype(np.float64) for k, v in attention_lm.initial().items()}
    _, g = attention_lm.gradient(p, x, before, y, scored)
    for name in attention_lm.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(g[name])), p[name].shape)
        kept, ends = p[name][at], []
        for step in (1e-4, -1e-4):
            p[name][at] = kept + step
            ends.append(attention_lm.gradient(p, x, before, y, scored)[0])
        p[name][at] = kept
        assert (ends[0] - ends[1]) / 2e-4 == pytest.approx(g[name][at], rel=0.05, abs=1e-5)
    plain = {k: v.astype(np.float32) for k, v in p.items()}
    h = attention_lm.hidden(plain, x, before, None)[0]
    want = attention_lm.log_probs(plain, np.maximum(h[scored], 0), y[scored])[0]
    assert np.allclose(attention_lm.sequence_scores(plain, ids, starts)[pos[scored]], want, atol=1e-3)


def test_words_of_a_block_are_encoded_at_once(monkeypatch):
    plain, calls = attention_lm._subwords(attention_lm.VOCABULARY), []
    monkeypatch.setattr(attention_lm, "_subwords", lambda path: lambda text: calls.append(text) or plain(text))
    texts = ["the house\tx\n \u00e9t\u00e9 \u00a0odd\x1c\u2028 the", "", "\U0001f600 don't 12,345 qzqzqz"]
    got = list(attention_lm._encode(attention_lm.VOCABULARY, 1)(iter([pa.record_batch({"text": texts})])))
    assert len(calls) == 1
    ids = np.concatenate([attention_lm._held_windows(b.as_py())[2][attention_lm._held_windows(b.as_py())[3]] for r in got for b in r.column(1)])
    assert ids.tolist() == [int(i) for t in texts for w in [*WORD.findall(lower(t)), None] for i in ([attention_lm.END] if w is None else plain(" " + w))]


def test_steps_are_adams():
    rng = np.random.default_rng(4)
    learner = attention_lm.Learner(rng.standard_normal(attention_lm.SIZE).astype(np.float32), 0.03)
    want, first, second = learner.weights.astype(np.float64), 0.0, 0.0
    for t in range(1, 31):
        g = rng.standard_normal(attention_lm.SIZE) * (rng.random(attention_lm.SIZE) < 0.3)
        first, second = first + 0.1 * (g - first), second + 0.01 * (g**2 - second)
        want -= 0.03 * min(1.0, t / 20) * (0.3 + 0.7 / (1 + t / 1000)) * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        learner.slope[:] = g
        learner.step()
    assert np.allclose(learner.weights, want, atol=1e-4) and all(np.shares_memory(v, learner.weights) for v in learner.p.values())


def test_scores_equal_whole_windows():
    """Each id's state is made once, from its run and the one before it, with what a whole window gives."""
    rng = np.random.default_rng(7)
    p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention_lm.initial().items()}
    starts = np.array([0, 0, 1, 16, 33, 33, 64, 97, 400])
    ids, opens = rng.integers(0, attention_lm.SUBWORDS, 400), np.zeros(400, np.float32)
    x, before, y, scored, pos = attention_lm.windows(ids, starts, attention_lm.STRIDE)
    lp, classes = attention_lm.log_probs(p, np.maximum(attention_lm.hidden(p, x, before, None)[0][scored], 0), y[scored])
    assert np.allclose(attention_lm.sequence_scores(p, ids, starts, batch=3, opens=opens)[pos[scored]], lp, atol=1e-4)
    assert np.allclose(opens[pos[scored]], np.log(classes[:, : attention_lm.OPENING].sum(axis=1)), atol=1e-4)
    runs = attention_lm._chunks(ids, starts)
    assert sorted(runs[4][runs[3]].tolist()) == list(range(400))


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["house", "river", "walks", "green", "over", "the"]) for _ in range(60)) + "."
    junk = lambda: " ".join(rng.choice(["WIN", "$$$", "!!", "free###"]) for _ in range(60))
    data = [(i, good() if i % 3 else junk()) for i in range(300)] + [(900, None), (901, "")]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    held = [i for i in range(300) if got[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert np.mean([got[i]["predicted"] == int(i % 3 != 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"]
    none = quality.score_quality(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("run", [exact_dedup.exact_duplicates, jaccard_join.near_duplicates, suffix_dedup.remove_repeats, secrets.scan_secrets, secrets.mask_secrets, packing.pack_documents, sentencepiece_codec.piece_digests, attention_lm.score_texts, lambda d: token_counts.length_histogram(token_counts.token_lengths(d))], ids=lambda f: f.__name__)
def test_empty_table(nothing, run):
    assert run(nothing).collect() == []


def test_no_vectors(spark):
    assert embedding_neighbours.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, None), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()) == [(-1, -1, True), (-1, 4, False), (4, 4, True)]
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in jaccard_join.near_duplicates(docs).collect()) == [(-1, -1), (-1, 4), (4, 4)]
    assert docs.count() == suffix_dedup.remove_repeats(docs).count() == attention_lm.score_texts(docs, rounds=0).count() == packing.pack_documents(docs.withColumn("source", F.lit(None).cast("string"))).count()


def test_near_copies_of_one_base_and_rows_without_ids(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(70)]
    data = []
    for i in range(160):  # a loose group: most pairs do not link, but nearly all are in one component
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(70)] = f"e{rng.randrange(10_000)}"
        data.append((i, " ".join(w)))
    data += [(None, data[3][1]), (5, "other words altogether here now and then"), (5, data[4][1]), (200 + 1, " ".join(base[:35] + [f"x{k}" for k in range(35)]))]
    sets = [shingles(t) for _, t in data]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    comp = components(range(len(sets)), links)
    least = {}
    for k, (i, _) in enumerate(data):
        if i is not None:
            least[comp[k]] = min(least.get(comp[k], i), i)
    docs = spark.createDataFrame([(i, t, 1, 2.0, "x") for i, t in data], "doc_id long, text string, key int, comp double, hashes string")
    got = jaccard_join.near_duplicates(docs).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=order) == sorted(((i, len(sets[k]), least.get(comp[k], i)) for k, (i, _) in enumerate(data)), key=order)
    assert sum(r["kept"] for r in got) == len(set(comp.values()))


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 900))) for _ in range(40)]
    bits = jaccard_join.bitmaps(sets)
    for a in range(40):
        for b in range(a):
            assert np.bitwise_count(bits[a] ^ bits[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_masking_rows_that_share_ids(spark):
    one, two = 'password = "q8Zr2LmX0vTn4KcB7dHy"', 'long text before: secret="Zx81LmQ0vTn4KcB7dHyW" after'
    data = [(1, one), (1, two), (1, "plain"), (None, one), (None, two), (2, None)]
    names = "doc_id long, text string, source string, lang string, live int, _id int, key int, sha int, own string, n_chars long"
    df = spark.createDataFrame([(i, t, "s", "en", 1, 2, 3, 4, "o", len(t or "")) for i, t in data], names)
    got = secrets.mask_secrets(df)
    mask = lambda t: t and t.replace("q8Zr2LmX0vTn4KcB7dHy", "[secret]").replace("Zx81LmQ0vTn4KcB7dHyW", "[secret]")
    assert got.columns == df.columns
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in got.collect()), key=order) == sorted(((i, mask(t), len(mask(t) or "")) for i, t in data), key=order)


def test_ownership_by_repositories(spark):
    value = "q8Zr2LmX0vTn4KcB7dHy"
    rows = [(i, f"token={value}", f"src{i % 2}", f"l{i}") for i in range(8)] + [(20 + i, "token=Zx81LmQ0vTn4KcB7dHyW", "src0", f"l{i}") for i in range(8)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()}
    assert all(got[i]["n_example"] == 1 and got[i]["n_live"] == 0 and got[20 + i]["n_live"] == 1 for i in range(8))


def test_quality_votes(spark):
    rng = random.Random(8)
    words = ["house", "river", "WIN", "$$$", "green", "!!", "over", "the", "free###"]
    data = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 50)))) for i in range(120)]
    data += [(3, data[3][1]), (3, data[3][1]), (None, "river river"), (None, None)]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t in data], "doc_id long, text string, score double, kept int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    voters = quality.fit(docs, labels, neighbours=7)
    assert len(voters.labels) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(120))
    got = quality.score_quality(docs, labels, carry=True, neighbours=7)
    assert got.columns == ["doc_id", "text", "kept", "held_out", "score", "predicted"]

    def vote(text):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        v = (quality.features(raw, np.array([0, len(raw)]))[0] * voters.weight) @ voters.projection
        size = math.sqrt(float(v @ v))
        if not size:
            return voters.prior
        near = sorted(((float(v @ x) / size, y) for x, y in zip(voters.vectors, voters.labels, strict=True)), reverse=True)[:7]
        weights = [max(c, 0.0) ** voters.sharpness for c, _ in near]
        return sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else voters.prior

    for r in got.collect():
        assert r["score"] == pytest.approx(vote(r["text"]), abs=1e-4) and r["predicted"] == int(r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 0)
    assert quality.score_quality(docs.limit(0), labels).collect() == []


def test_quality_is_fitted_by_a_task(spark, monkeypatch):
    """The driver gets the model alone: the matrices of the fit stay in a task's worker."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and word{i % 5}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    want = quality.fit(docs, labels)

    def here(*_):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(np.linalg, "eigh", here)
    got = quality.fit(docs.repartition(3), labels.repartition(2))
    assert len(got.labels) and (got.labels == want.labels).all() and (got.projection == want.projection).all() and (got.vectors == want.vectors).all()


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 7, 1, 2.0), (2, [2.0, 0.1], 7, 1, 2.0), (3, [0.0, 1.0], 7, 1, 2.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int, comp int, cosine double")
    assert sorted(map(tuple, embedding_neighbours.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_closed_words_share_one():
    rng = np.random.default_rng(2)
    p = {k: (v + 0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in attention_lm.initial().items()}
    encode = attention_lm._subwords(attention_lm.VOCABULARY)
    ids = np.array([*encode(" house"), *encode(" x"), attention_lm.END])
    assert all((i < attention_lm.OPENING * attention_lm.MEMBERS) == (k in (0, len(encode(" house")), len(ids) - 1)) for k, i in enumerate(ids))
    opens = np.zeros(len(ids), np.float32)
    attention_lm.sequence_scores(p, ids, np.array([0, len(ids)]), opens=opens)
    for at in range(len(ids)):  # all ids that may stand at a place, scored one by one
        u = np.maximum(attention_lm.hidden(p, np.array([[attention_lm.START, *ids[:at], *[0] * (attention_lm.WINDOW - at - 1)]]), np.array([[attention_lm.START, attention_lm.START, *ids][k] if k <= at else 0 for k in range(attention_lm.WINDOW)])[None], None)[0][0, at], 0)
        every = np.exp(attention_lm.log_probs(p, np.repeat(u[None], attention_lm.IDS, axis=0), np.arange(attention_lm.IDS))[0])
        assert every.sum() == pytest.approx(1, abs=1e-4) and np.log(every[: attention_lm.OPENING * attention_lm.MEMBERS].sum()) == pytest.approx(opens[at], abs=1e-3)


@pytest.mark.parametrize("parts", [1, 40])
def test_cross_pairs_are_made_once(parts):
    """Sets that share much and hardly link meet in most parts; a pair is made in few of them, and none that links is lost."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 1 << 64, (3, 700), np.uint64)
    sets = [np.unique(np.concatenate([pool[f][: 400 + 40 * f], rng.choice(pool[f][400 + 40 * f :], rng.integers(40, 200), replace=False), rng.integers(0, 1 << 64, rng.integers(0, 120), np.uint64)])) for f in (0, 1, 2) for _ in range(14)]
    keys = jaccard_join.set_keys(sets)
    frame = lambda batch: batch.to_pandas().astype({"part": "int32"})

    def grouped(run, rows):
        return pd.concat([run(g) for _, g in rows.groupby("part")], ignore_index=True)

    rows = pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(keys.view(np.int64)), pa.array(np.ones(len(sets), np.int64))], ["key", "hashes", "comp", "shared"])
    sent = pd.concat([frame(b) for b in jaccard_join._labelled(parts)(iter([rows]))], ignore_index=True)
    made = grouped(jaccard_join._cross_pairs, grouped(jaccard_join._prefix(parts), grouped(jaccard_join._shared_of(parts), sent)))
    pairs = set(map(tuple, made[["a", "b"]].to_numpy().tolist()))
    name = keys.view(np.int64).tolist()
    links = [(name[a], name[b]) for a in range(len(sets)) for b in range(a) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b]))]
    assert links and all((a, b) in pairs or (b, a) in pairs for a, b in links)
    assert len(made) <= 4 * len(pairs)
