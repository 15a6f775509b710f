"""Winnowing, fill-in-middle and collocations against brute-force versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from alertloom.llm import collocations, fill_in_middle, winnowing
from test_operators import EMPTY, lower, rows


@pytest.fixture(scope="module")
def table(spark):
    data, _ = rows(3)
    data = [(i if i % 17 else None, t) for i, t in data]
    data += data[12:14] + [(5, "another text of five " * 30), (None, "ab" * 300), (900, "x <P> y"), (901, "<S>"), (902, "a < b <M>"), (903, "日本" * 700 + "😀é" * 90), (904, "<" * 40)]
    full = [(i, t, "k", "c", 1, "t", 2, 0.5, 3, 4, 5, f"s{n % 4}", ("en", None, "fr")[n % 3]) for n, (i, t) in enumerate(data)]
    return spark.createDataFrame(full, EMPTY).repartition(3), [(r[0], r[1], r[12]) for r in full]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


def run_hashes(spark, texts, k):
    """The hash of every run of k code points, by Spark's own function on each run."""
    runs = sorted({t[i : i + k] for t in texts if t for i in range(max(len(t) - k, 0) + 1)})
    made = spark.createDataFrame([(x,) for x in runs], "t string").select("t", F.xxhash64(F.encode("t", "UTF-32")).bitwiseOR(F.lit(4095)).alias("h"))
    return {r["t"]: r["h"] for r in made.collect()}


def winnow(text, known, k, width):
    h = [known[text[i : i + k]] for i in range(max(len(text) - k, 0) + 1)] if text else []
    picked = set()
    for s in range(max(len(h) - width, 0) + 1 if h else 0):
        window = h[s : s + width]
        least = min(window)
        picked.add(s + max(i for i, x in enumerate(window) if x == least))
    return [i << 31 | (h[i] & (1 << 64) - 1) >> 33 for i in sorted(picked)]


@pytest.mark.parametrize(("k", "width", "chunk"), [(16, 64, 256), (5, 8, 16), (3, 4, 20)])
def test_winnowing(spark, table, k, width, chunk):
    df, data = table
    text = {}
    for i, t, _ in data:
        text.setdefault(i, []).append(t or "")
    ids = sorted((i for i in text if i is not None), reverse=True) + [None]
    h = {r["t"]: r["h"] for r in spark.createDataFrame([(x,) for ts in text.values() for x in ts], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    after = {i: max(text[ids[(n + 1) % len(ids)]], key=lambda t: (len(t), h[t])) for n, i in enumerate(ids)}
    edited = {(i, t): t[: len(t) - len(t) // 3] + after[i][: len(t) // 3] for i, ts in text.items() for t in ts}
    known = run_hashes(spark, [*(t for ts in text.values() for t in ts), *edited.values()], k)
    got = winnowing.edited_fingerprints(df, k=k, width=width, chunk=chunk).collect()
    assert len(got) == len(data)
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    short = lambda marks: {e & (1 << 31) - 1 for e in marks}
    want = []
    for i, t, _ in data:
        t = t or ""
        a, b, c = (winnow(x, known, k, width) for x in (t, edited[i, t], after[i]))
        want.append((i, len(t), a, edited[i, t], b, like(short(a), short(b)), like(short(a), short(c))))
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[2])
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_winnowing_keeps_its_guarantee(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    shared = word(16 + 64 - 1)
    pairs = [(word(rng.randrange(400)) + shared + word(rng.randrange(400)), word(rng.randrange(400)) + shared + word(rng.randrange(400))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string").select(*(winnowing.hashes(winnowing.fingerprint(F.col(c))).alias(c) for c in "ab"))
    assert df.where("size(array_intersect(a, b)) = 0").count() == 0


def test_winnowing_of_equal_hashes_selects_the_rightmost(spark):
    n = 700
    (marks,) = spark.createDataFrame([("z" * n,)], "t string").select(winnowing.fingerprint(F.col("t"))).first()
    assert [e >> 31 for e in marks] == list(range(63, n - 15))


def test_fill_in_middle(table):
    df, data = table
    draw = lambda i: [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[8 * j : 8 * j + 8], 16) for j in range(4)]
    for unit, run, pattern in (("(?s:.)", 256, "(?s:.)"), ("(?s:.)", 3, "(?s:.)"), (r"\w+\W*|\W+", 4, r"\w+\W*|\W+")):
        want = []
        for i, t, _ in data:
            t = t or ""
            units = re.findall(pattern, t, re.ASCII)
            n, (h1, h2, h3, h4) = len(units), draw(i)
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
            if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
                want.append((i, n, "plain", None, None, None, t, t))
            elif h4 % 100 < 20:
                want.append((i, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", t))
            else:
                want.append((i, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", t))
        got = fill_in_middle.fill_in_middle(df, unit=unit, run=run).withColumn("again", fill_in_middle.restored(F.col("output"), F.col("form")))
        order = lambda r: (r[0] is None, r[0] or 0, r[6])
        assert sorted((tuple(r) for r in got.collect()), key=order) == sorted(want, key=order)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    with pytest.raises(Exception, match="units do not cover"):
        fill_in_middle.fill_in_middle(df, unit="[a-z]+").collect()


def brute_collocations(data, least, top, longest=4):
    pieces, counts, n = [], collections.Counter(), collections.Counter()
    for _, t, lang in data:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            pieces.append((lang or "und", re.findall(r"[^\x20\x09]+", piece)))
    for lang, w in pieces:
        n[lang] += len(w)
        for k in range(1, longest + 1):
            counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: a for x, a in counts.items() if len(x[1]) > 1 and a >= least}
    covered = {(lang, w[i:j]) for (lang, w), a in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w) and 100 * a >= 80 * counts[lang, w[i:j]]}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            score, k = min((2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), a, counts[lang, w[:k]], counts[lang, w[k:]], score))
    return sorted((lang, rank, x[2].decode(), *x[3:6], n[lang], x[6]) for lang, found in out.items() for rank, x in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize(("least", "top", "most", "counters"), [(30, 2000, 1 << 22, 1 << 24), (3, 25, 1 << 22, 1 << 24), (2, 2000, 60, 1 << 16)])
def test_collocations(table, least, top, most, counters):
    df, data = table
    got = collocations.collocations(df, least=least, top=top, most=most, counters=counters)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(data, least, top)


def test_candidates_leave_one_mapper(spark, monkeypatch):
    """A phrase that every mapper meets is handed on by its counter's owner only."""
    rows, plain = spark.sparkContext.accumulator(0), collocations._candidates

    def counted(*args):
        run = plain(*args)

        def wrapped(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return wrapped

    monkeypatch.setattr(collocations, "_candidates", counted)
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, text, "en") for k in range(8)], "doc_id long, text string, lang string").repartition(8, "doc_id")
    found = collocations.phrases(df, least=8, longest=2)[1]
    assert found.count() == 59
    assert rows.value <= 1.2 * 59


def test_owners_take_few_bytes(spark, monkeypatch):
    """With more mappers than one group sums, a byte names the owner of a counter that was met, and counters that were not have none."""
    rows, size, sums, handed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0), collocations._sum_owned, collocations._candidates

    def measured(*args):
        run = sums(*args)

        def wrapped(table):
            out = run(table)
            size.add(sum(len(x.as_py()) for c in out.columns if c.type == "binary" for x in c))
            return out

        return wrapped

    def counted(*args):
        run = handed(*args)

        def wrapped(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b

        return wrapped

    monkeypatch.setattr(collocations, "_sum_owned", measured)
    monkeypatch.setattr(collocations, "_candidates", counted)
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(k, text, "en") for k in range(48)], "doc_id long, text string, lang string").repartition(48, "doc_id")
    monkeypatch.setattr(collocations, "written", lambda x: collocations.checkpointed(x))  # keeps the mappers apart
    found = collocations.phrases(df, least=30, longest=2, counters=1 << 16)[1]
    assert sorted(r["a"] for r in found.collect()) == [48] * 59
    assert rows.value <= 1.2 * 59
    chunks = 3 + 1  # groups of both levels
    assert size.value <= 0.1 * chunks * (1 << 16)


def test_more_words_than_counters(spark, monkeypatch):
    """Where rare phrases fill every shared counter, the hashes still hold frequent ones only."""
    rng, sizes, plain = random.Random(5), [], collocations.PerfectHash.__init__
    monkeypatch.setattr(collocations.PerfectHash, "__init__", lambda self, keys: sizes.append(len(keys)) or plain(self, keys))
    data = [(k, " ".join(rng.choice(("often said here", f"w{rng.randrange(200)}", f"w{rng.randrange(200)}")) for _ in range(1000)), "en") for k in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(6, "doc_id")
    want = brute_collocations(data, 30, 2000)
    got = collocations.collocations(df, least=30, counters=1 << 12)
    assert sorted(tuple(r) for r in got.collect()) == want
    frequent = collocations.phrases(df, least=30, counters=1 << 12)[1].count()
    assert max(sizes) <= frequent < 5000


def test_dealt_counts_meet_in_parts():
    rng = np.random.default_rng(8)
    ids = np.concatenate([[0], rng.integers(1, 40, 20_000)]).astype("<i4")
    for least in (10, 300):
        halves = [pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["ids"]) for x in (ids[:9000], ids[9000:])]
        rows = pa.Table.from_batches(list(collocations._dealt_counts([], least, 3, 5000)(iter(halves))))
        parts = [collocations._often(least)(rows.filter(pc.equal(rows.column("part"), part))).column("key").to_numpy() for part in range(3)]
        keys, n = np.unique(np.concatenate([(x[:-1].astype(np.int64) << 32 | x[1:])[(x[:-1] > 0) & (x[1:] > 0)] for x in (ids[:9000], ids[9000:])]), return_counts=True)
        assert sorted(np.concatenate(parts)) == sorted(keys[n >= least])
        assert all(len(x) for x in parts) or least > 10


def test_squeezed_arrays():
    rng = np.random.default_rng(3)
    for values, share in ((np.minimum(rng.poisson(0.09, 1 << 16), 30).astype("u1"), 0.2), (rng.poisson(0.8, 5000).astype("<i8"), 0.2), (np.zeros(0, "u1"), 1), (rng.integers(-(1 << 62), 1 << 62, 100), 2)):
        squeezed = collocations._squeezed(values)
        assert (collocations._spread(squeezed, values.dtype) == values).all() and len(squeezed) <= 4 + max(16, share * values.nbytes)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64))
    hashed = collocations.PerfectHash(keys)
    assert sorted(hashed.find(keys)) == list(range(len(keys)))
    assert (hashed.keys[hashed.find(keys)] == keys).all()
    assert (hashed.find(np.setdiff1d(rng.integers(0, 2**63, 50_000, dtype=np.uint64), keys)) == -1).all()
    assert len(collocations.PerfectHash(keys[:0]).find(keys[:3])) == 3


def test_ratio_is_exact_past_64_bits():
    rng = random.Random(2)
    a = [rng.randrange(1, 2**43) for _ in range(2000)] + [2**43]
    over = [2 * x + rng.choice((0, 1, rng.randrange(2**40))) for x in a]
    assert collocations.floor_ratio(np.array(a), np.array(over)).tolist() == [2_000_000 * x // y for x, y in zip(a, over, strict=True)]


@pytest.mark.parametrize("run", [winnowing.fingerprint_digests, fill_in_middle.fill_in_middle_digests, collocations.collocations], ids=lambda f: f.__name__)
def test_empty_table(nothing, run):
    assert run(nothing).collect() == []


def test_one_document_is_its_own_next(spark):
    (r,) = winnowing.edited_fingerprints(spark.createDataFrame([(4, "abcdefghi")], "doc_id long, text string")).collect()
    assert (r["edited"], r["near_next"]) == ("abcdefabc", 1.0)


def test_native_plans(table):
    for run in (winnowing.fingerprint_digests, fill_in_middle.fill_in_middle_digests):
        plan = run(table[0])._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
