"""The corpus pipeline against a brute-force version of its stages."""

import random
import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["house", "river", "walks", "green", "over", "the", "small", "bright"]) + rng.choice(["s", "ed", ""]) for _ in range(60))
    junk = lambda: " ".join(rng.choice(["WIN$$$", "!!FREE", "###", "@@@@"]) for _ in range(60))
    texts = [good() if i % 4 else junk() for i in range(160)]
    clean = [i for i in range(160) if i % 4]
    data = list(enumerate(texts))
    data += [(200 + k, texts[clean[k]]) for k in range(10)]  # exact copies, with the larger doc_id
    data += [(300 + k, texts[clean[20 + k]].replace(texts[clean[20 + k]].split()[3], "changed", 1)) for k in range(10)]  # near copies
    secret = 'api_key = "Zq81LmX0vTn4KcB7dHy2"'
    data += [(400, good() + " " + secret)]
    rows = [(i, t, "en", f"src{i % 7}", len(t)) for i, t in data]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        kept.append(docs)
    want = [r for r in data if r[0] >= 160 or r[0] % 4]
    assert sorted(r["doc_id"] for r in kept[0].collect()) == sorted(i for i, _ in want)
    assert kept[0].columns == kept[3].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    last = {}
    for i, t in want:
        last[t] = max(last.get(t, -1), i)
    want = [(i, t) for i, t in want if last[t] == i]
    assert sorted(r["doc_id"] for r in kept[1].collect()) == sorted(i for i, _ in want)
    sets = {i: shingles(t) for i, t in want}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = [(i, t) for i, t in want if find(i) == i]
    assert sorted(r["doc_id"] for r in kept[2].collect()) == sorted(i for i, _ in want)
    masked = {r["doc_id"]: r for r in kept[3].collect()}
    assert set(masked) == {i for i, _ in want} and masked[400]["text"].endswith('api_key = "[secret]"') and masked[400]["n_chars"] == len(masked[400]["text"])
    assert all(masked[i]["text"] == t for i, t in want if i != 400)
    sizes = {}
    for r in kept[4].collect():
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["size"]
    assert sizes == {i: len(r["text"].encode()) for i, r in masked.items()}


def test_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.choice(["house", "river", "walks", "green", "over", "bright"]) for _ in range(40))
    near = text().split()
    rows = [(i, text()) for i in range(40)] + [(None, text()), (None, None), (None, ""), (7, text()), (50, " ".join(near)), (None, " ".join(near[:-1] + ["other"])), (None, None)]
    full = [(i, t, "en", None if k % 3 else "s", len(t or ""), 1.0, "x") for k, (i, t) in enumerate(rows)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, live string"
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    for name, data in (("some", full), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, names).write.parquet(folder + "/documents.parquet")
        labels.write.parquet(folder + "/labels.parquet")
        docs = spark.read.parquet(folder + "/documents.parquet")
        texts = []
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            texts.append(sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect()) if k < 4 else docs.count())
        if not data:
            assert texts == [[], [], [], [], 0]
            continue
        all_rows = sorted((i or -1, t or "") for i, t in rows)
        assert texts[0] == all_rows
        assert texts[1] == sorted(set(all_rows))
        gone = set(texts[1]) - set(texts[2])
        assert gone == {(-1, " ".join(near[:-1] + ["other"]))} and texts[3] == texts[2]
        assert corpus_pipeline.run(spark, folder).count() == texts[4] > 0
