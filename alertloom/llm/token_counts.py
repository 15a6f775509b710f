"""Exact token counts from a length histogram and its suffix sums."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET = 512
#: Long runs of the pattern's white space (the Unicode property), which its engine cannot match by backtracking.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@cache
def encoder(path: str):
    """The byte-pair encoder of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str | None) -> int:
    """Tokens of a text of any content: a long run of white space is one piece by the pattern, less its last character where a word follows, and is encoded as that piece."""
    n = at = 0
    for run in LONG_SPACE.finditer(text or ""):
        end = run.end() - (run.end() < len(text))
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:])) if text else 0


def _lengths(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(vocabulary)
        for batch in batches:
            counts = [count_tokens(encoding, x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens (0 for a null or empty text) of every row; special tokens' strings count as ordinary text, white space in runs of any length too."""
    return docs.select("doc_id", "text").mapInArrow(_lengths(vocabulary), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """For each encoded length n_tokens: n_docs, tokens, docs_from and tokens_from (of this length or more), docs_upto, truncated_total.

    truncated_total is the corpus total if every text were cut to n_tokens: the tokens of shorter texts plus n_tokens for
    each other. Suffix sums run within buckets of BUCKET lengths, which spread over tasks; only one row a bucket meets
    in the window over buckets. An empty table gives no rows.
    """
    sized = checkpointed(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))  # texts are encoded once
    sized = sized.withColumn("bucket", F.floor(F.col("n_tokens") / BUCKET)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    buckets = sized.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    later = buckets.select("bucket", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"), F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("bucket").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = sized.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum("tokens").over(inside)).join(later, "bucket")
    docs_from, tokens_from = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return summed.select(
        "n_tokens", "n_docs", "tokens", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"),
        (F.col("all_docs") - docs_from + F.col("n_docs")).alias("docs_upto"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_total"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """context, truncated_total and docs_cut for each context limit, whether it occurs as a length or not; 0 for an empty table.

    The suffix sums of the least length over a limit answer for it: one aggregation for all limits.
    """
    over = [F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("n_tokens") > x, F.col("n_tokens"))).alias(f"over{i}") for i, x in enumerate(limits)]
    row = histogram.agg(F.coalesce(F.max("tokens_from"), F.lit(0)).alias("all_tokens"), *over)
    docs, tokens = (lambda i: F.coalesce(F.col(f"over{i}.docs_from"), F.lit(0))), (lambda i: F.coalesce(F.col(f"over{i}.tokens_from"), F.lit(0)))
    answers = [F.struct(F.lit(x).cast("long").alias("context"), (F.col("all_tokens") - tokens(i) + x * docs(i)).alias("truncated_total"), docs(i).alias("docs_cut")) for i, x in enumerate(limits)]
    return row.select(F.explode(F.array(*answers)).alias("a")).select("a.*")


def length_quantiles(histogram: DataFrame, quantiles: list[float]) -> DataFrame:
    """The least length that at least a share q of the documents do not pass, for each q."""
    total = F.col("docs_upto") + F.col("docs_from") - F.col("n_docs")
    return histogram.agg(*(F.min(F.when(F.col("docs_upto") >= F.lit(q) * total, F.col("n_tokens"))).alias(f"q{q:g}".replace(".", "_")) for q in quantiles))
