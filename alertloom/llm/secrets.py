"""Secret scans with corpus-wide ownership frequency.

Candidates of three kinds are found in every text. Their values are hashed, and the hashes are counted over the whole
corpus by distinct owner and repository: a value that many owners hold, or many repositories of more than one owner, is a widely
copied example; one that is its owner's own and looks random is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh

KINDS = ("assign", "access", "hex")
#: The three patterns and the least length of what counts.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
_KEYWORD = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def entropy(value: str) -> float:
    """Bits per character of a value's own characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end), sorted by start, then kind."""
    found = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                found.append((m.start(), 0, m.end(), m.start(1), m.end(1)))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]  # a maximal run of 16 or more is a run that is 16 or longer
    return sorted(found)


_CANDIDATES = "array<struct<kind:int,start:int,end:int,value_start:int,value_end:int,bits:float,hash:string>>"
_CAND_TYPE = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("bits", pa.float32()), ("hash", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        shas, counts, cands, own = [], ([], [], []), [], []
        for scalar in texts:
            text = scalar.as_py() or ""
            spans = base_spans(text)
            own.append(hashlib.sha256(text.encode()).hexdigest())
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _, _ in spans).encode()).hexdigest())
            for k in range(3):
                counts[k].append(sum(s[1] == k for s in spans))
            cands.append([{"kind": k, "start": a, "end": b, "value_start": c, "value_end": d, "bits": entropy(text[c:d]), "hash": hashlib.sha256(text[c:d].encode()).hexdigest()} for a, k, b, c, d in spans])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "owner", "repository")), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(own, pa.string()), pa.array(cands, _CAND_TYPE)],
            ["doc_id", "owner", "repository", "n_assign", "n_access", "n_hex", "base_sha256", "text_sha256", "found"],
        )


def scan_secrets(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), example_owners: int = 4, example_repositories: int = 8, live_bits: float = 2.5) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, text_sha256 and ``live`` (spans of live-looking values) for every row.

    A value held by ``example_owners`` or more distinct owners, or by several owners in ``example_repositories`` or more
    distinct repositories, is an example; any other whose own characters have ``live_bits`` or more bits each is
    live-looking, and adds a span live:value start:value end. Offsets are in code points. Counts of owners and repositories
    cover all rows; a null owner or repository counts as one of that name. Null and empty texts have no spans. Repeated rows
    and doc_ids are scanned row by row. Empty tables give no rows; other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository)).alias("repository"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = checkpointed(rows.mapInArrow(_scan, f"doc_id {kind}, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, text_sha256 string, found {_CANDIDATES}"))
    scanned = scanned.withColumn("row", F.monotonically_increasing_id())  # stable: the rows are written
    each = scanned.where("size(found) > 0").select("row", "owner", "repository", F.explode("found").alias("c"))
    held = each.select(F.col("c.hash").alias("hash"), "owner", "repository").distinct()  # map-side combined, so a value in a third of all rows is one row a task
    held = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n")).groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))
    judged = each.select("row", "c.*").join(held, "hash").select("row", "kind", "start", "end", "value_start", "value_end", ((F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repositories") >= example_repositories))).alias("example"), (F.col("bits") >= live_bits).alias("random"), "owners", "repositories")
    names = F.array(*(F.lit(k) for k in KINDS))
    span = lambda kind, name, a, b, live: F.struct(F.col(a).alias("start"), F.lit(kind).alias("kind") if isinstance(kind, int) else kind.alias("kind"), F.concat_ws(":", name, F.col(a), F.col(b)).alias("text"), live.alias("live"), F.col(b).alias("end"))
    base = span(F.col("kind"), F.element_at(names, F.col("kind") + 1), "start", "end", F.lit(False))
    extra = span(3, F.lit("live"), "value_start", "value_end", F.lit(True))
    live = F.col("random") & ~F.col("example")
    by_row = judged.groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(F.when(live, F.array(base, extra)).otherwise(F.array(base))))).alias("s"), F.count_if(live).alias("n_live"), F.count_if("example").alias("n_example"), F.max("owners").alias("most_owners"), F.max("repositories").alias("most_repositories"))
    out = scanned.drop("found", "owner", "repository").join(by_row, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("s", lambda x: x.text), ","), F.lit("")).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repositories")),
        F.coalesce(F.transform(F.filter("s", lambda x: x.live), lambda x: F.struct(x.start, x.end)), none).alias("live"),
        "text_sha256",
    )


def mask_secrets(docs: DataFrame, mask: str = "[secret]", **options) -> DataFrame:
    """``docs`` with the live-looking values of every text replaced by ``mask``; all rows and columns stay, n_chars follows.

    Widely copied examples stay as they are. Rows are matched by doc_id (a null one too) and their text's SHA-256, so rows that repeat a
    doc_id with another text are masked by their own spans, and a repeated row is masked alike. Null and empty texts and empty
    tables stay as they are; helper columns take names that ``docs`` doesn't have.
    """
    own, sha, live, key = fresh(docs.columns, "own", "sha", "live", "key")
    found = scan_secrets(docs, **options).where("n_live > 0").select(F.col("doc_id").alias(own), F.col("text_sha256").alias(sha), F.col("live").alias(live)).dropDuplicates([own, sha])
    keyed = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(sha)), "left")
    return joined.select(*(_masked(c, live, mask) for c in docs.columns))


def _masked(column: str, live: str, mask: str) -> Column:
    """A column of a row after masking the spans in ``live``: text and n_chars change, others stay. A span inside an earlier one is left out."""
    spans, text = F.col(live), F.col("text")
    if column == "text":
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        step = lambda acc, s: F.when(s.start < acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, F.substring(text, acc.at + 1, s.start - acc.at), F.lit(mask)).alias("out")))
        return F.when(spans.isNotNull(), F.aggregate(spans, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))).otherwise(text).alias("text")
    if column == "n_chars":  # what the spans take and the masks give
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("gone"))
        gone = F.aggregate(spans, start, lambda acc, s: F.when(s.start < acc.at, acc).otherwise(F.struct(s.end.alias("at"), (acc.gone + s.end - s.start - len(mask)).alias("gone"))), lambda acc: acc.gone)
        return F.when(spans.isNotNull(), (F.length(text) - gone).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return F.col(f"`{column}`")
