"""Document fingerprints by winnowing (Schleimer, Wilkerson and Aiken 2003), in DataFrame functions only.

Hashes of all runs of K code points roll over a text; of every WIDTH consecutive hashes the smallest is selected, of equal ones
the rightmost, and a selected hash is kept with its position. So two texts that share K + WIDTH - 1 code points share a
selected hash, and no match shorter than K is ever reported.

A text is read in overlapping chunks, each of which holds whole windows, so the work is linear in its length and nothing is as
long as a text but the text and its fingerprint. Within a chunk, hashes are packed with their positions, so that one
comparison of longs decides by hash and then by position. A window's minimum is at most the minimum of the one half-window
block that the window surely holds, so hashes above the minima of their own block and of both neighbours can't be selected: the
few others are compared with each other. A candidate is selected if the nearest smaller ones before and after it leave room for
a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinal import ranked

K, WIDTH = 16, 64
CHUNK = 512
#: A packed hash has its low bits, in place of its own, count down from the chunk's start in steps of 4.
PLACES = 1 << 12
#: Bits of a hash that a fingerprint keeps.
HASH = 31


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _packed(chunk: Column, k: int, half: int) -> Column:
    """Blocks of ``half`` packed hashes, one for every run of ``k`` code points; a shorter chunk is one run."""
    wide = F.encode(chunk, "UTF-32")  # four bytes a code point, so that a run is found without a walk from the start
    last = F.greatest(F.char_length(chunk) - F.lit(k), F.lit(0)) * 4 + 1
    one = lambda b: lambda x: F.xxhash64(F.substring(b, x, F.lit(4 * k))).bitwiseOR(F.lit(PLACES - 1)) - x  # noqa: E731  the low bits are PLACES - 1 - x
    return _let(wide, lambda b: F.transform(F.sequence(F.lit(1), last, F.lit(4 * half)), lambda x: F.transform(F.sequence(x, F.least(x + 4 * (half - 1), last), F.lit(4)), one(b))))


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(PLACES - 1))


def _selected(blocks: Column, runs: Column, width: int) -> Column:
    """The window minima among ``runs`` packed hashes: those with room for a window between their nearest smaller neighbours."""
    lows = F.transform(blocks, F.array_min)
    few = _let(lows, lambda m: F.flatten(F.transform(blocks, lambda x, r: _let(F.greatest(F.get(m, r), F.get(m, r - 1), F.get(m, r + 1)), lambda bound: F.filter(x, lambda p: p <= bound)))))
    before, after = F.lit(PLACES + 2), F.lit(PLACES - 2) - runs * 4  # places beside the first and the last run

    def room(places: Column) -> Callable[[Column, Column], Column]:
        # places are in order of hashes, so the first j + 1 are those of run j and of all smaller ones
        def fits(x: Column, j: Column) -> Column:
            return _let(F.sort_array(F.slice(places, F.lit(1), j + 1)), lambda s: _let(F.array_position(s, _place(x)).cast("int"), lambda i: F.coalesce(F.get(s, i), before) - F.coalesce(F.get(s, i - 2), after) > 4 * width))

        return fits

    found = _let(F.sort_array(few), lambda c: _let(F.transform(c, _place), lambda q: F.filter(c, room(q))))
    return F.when(runs <= width, F.array(F.array_min(lows))).otherwise(found)


def fingerprint(text: Column, k: int = K, width: int = WIDTH, chunk: int = CHUNK, start: Column | None = None) -> Column:
    """The selected hashes of a text (never null), longs of position << 31 | 31 bits of hash, in order of position; of an empty text none.

    A text with no more than ``width`` runs is one window, one shorter than ``k`` one run. ``start`` (0 or more): only the
    windows from this position on, of which there may be none unless it is 0.
    """
    if width < 4 or width % 2 or 4 * (chunk + width) >= PLACES:
        raise ValueError("width must be even and 4 or more, and chunk + width under 1024")
    rest = text if start is None else F.substring(text, start + 1, F.lit(2**31 - 1))
    at = F.lit(0) if start is None else start
    chunks = F.regexp_extract_all(rest, F.lit(f"(?s)(?=(.{{1,{chunk + width + k - 2}}})).{{1,{chunk}}}"), F.lit(1))

    def of(c: Column, j: Column) -> Column:  # of a chunk after the first only whole windows count
        first = at + j * chunk
        own = _let(_packed(c, k, width // 2), lambda p: _selected(p, F.greatest(F.char_length(c) - F.lit(k - 1), F.lit(1)), width))
        found = F.transform(own, lambda p: F.shiftleft(first + F.shiftright(F.lit(PLACES - 2) - _place(p), 2), HASH).bitwiseOR(F.shiftrightunsigned(p, 64 - HASH)))
        return F.when((first == 0) | (F.char_length(c) >= width + k - 1), found).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(F.flatten(F.transform(chunks, of))))


def text_of(fingerprints: Column) -> Column:
    """position:hash of each selected hash, comma-joined; empty for none."""
    return F.array_join(F.transform(fingerprints, lambda e: F.concat(F.shiftright(e, HASH).cast("string"), F.lit(":"), F.lower(F.hex(e.bitwiseAND(F.lit((1 << HASH) - 1)))))), ",")


def hashes(fingerprints: Column) -> Column:
    """The different hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprints, lambda e: e.bitwiseAND(F.lit((1 << HASH) - 1)).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Shared of all different hashes; 1 for two texts without any, which are both empty."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared / every)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text (a null one is empty), n_chars and the fingerprint ``marks`` of every row; equal texts have equal ones."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.char_length("text").alias("n_chars"), fingerprint(F.col("text"), k, width, chunk).alias("marks"))


def _keys(docs: DataFrame, own: str, prefix: str = "") -> list[Column]:
    """An id without nulls and whether it was one: keys that a join and an aggregation can share a shuffle by."""
    return [F.coalesce(F.col(own), F.lit("0").cast(docs.schema["doc_id"].dataType)).alias(f"{prefix}id"), F.col(own).isNull().alias(f"{prefix}none")]


def followers(docs: DataFrame) -> DataFrame:
    """for_id, next_id, rep and take: for each different doc_id the next smaller one, after the last the largest, and of how many code points its third is.

    Nulls are one id, the smallest. ``rep`` tells the longest of the texts that an id has (of equally long ones that of the larger hash):
    it is the text of the next document. Only ids and numbers move here.
    """
    text = F.coalesce("text", F.lit(""))
    ids = docs.groupBy("doc_id").agg(F.max(F.struct(F.char_length(text).alias("n"), F.xxhash64(text).alias("h"))).alias("rep"))
    order = ranked(ids, [F.desc_nulls_last("doc_id")], "_rank")
    n = F.broadcast(ids.agg(F.count(F.lit(1)).alias("_all")))  # one row
    these = order.select(F.col("doc_id").alias("for_id"), F.floor(F.col("rep.n") / 3).cast("int").alias("take"), F.col("_rank")).join(n).withColumn("_rank", F.col("_rank") % F.col("_all") + 1).drop("_all")
    return these.join(order.withColumnRenamed("doc_id", "next_id"), "_rank").drop("_rank")


def edited_fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_chars, marks, edited (the text whose last third gives way to the start of the next document's), edited_marks, near_edited, near_next of every row.

    Windows before the edit select what they select in the text itself, so only those that reach the new third are computed.
    Rows that share a doc_id share the next document (see ``followers``); with one id in all, the next document is the longest
    text of it. An empty table gives no rows; further columns are not read.
    """
    own = fingerprints(docs, k, width, chunk).select(*_keys(docs, "doc_id"), "text", "n_chars", "marks")
    after = followers(docs).select(*_keys(docs, "for_id", "for_"), *_keys(docs, "next_id"), "rep", "take")
    # the two joins of ``own`` share a shuffle by doc_id alone, so fingerprints are made once; so these are no keys of a join
    is_rep = (F.col("n_chars") - F.col("rep.n") == 0) & (F.xxhash64("text").bitwiseXOR(F.col("rep.h")) == 0)
    taken = own.join(after, ["id", "none"]).where(is_rep).select("for_id", "for_none", F.struct(F.substring("text", F.lit(1), F.col("take")).alias("head"), hashes(F.col("marks")).alias("next_hashes")).alias("next"))
    taken = taken.groupBy(F.col("for_id").alias("id"), F.col("for_none").alias("none")).agg(F.max("next").alias("next"))  # one text, though it may be in several rows
    third = F.floor(F.col("n_chars") / 3).cast("int")
    stays = F.col("n_chars") - third
    limit = stays - (k + width - 1)  # the last window that the text and the edited text share, if it is 0 or more
    rows = own.join(taken, ["id", "none"])
    rows = rows.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", "marks", limit.alias("limit"), F.col("next.next_hashes").alias("next_hashes"), F.concat(F.substring("text", F.lit(1), stays), F.substring("next.head", F.lit(1), third)).alias("edited"))
    start = F.greatest(F.col("limit") - (width - 2), F.lit(0))
    kept = F.filter("marks", lambda e: F.shiftright(e, HASH) <= F.col("limit"))  # windows that hold these positions start at or before them
    late = fingerprint(F.col("edited"), k, width, chunk, start)
    rows = rows.withColumn("edited_marks", F.sort_array(F.array_union(kept, late)))
    mine = rows.select("doc_id", "n_chars", "marks", "edited", "edited_marks", hashes(F.col("marks")).alias("a"), hashes(F.col("edited_marks")).alias("b"), "next_hashes")
    return mine.select("doc_id", "n_chars", "marks", "edited", "edited_marks", likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("next_hashes")).alias("near_next"))


def fingerprint_digests(docs: DataFrame, **options) -> DataFrame:
    """As ``edited_fingerprints``, with fingerprints as strings and the digest of the edited text."""
    rows = edited_fingerprints(docs, **options)
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), text_of(F.col("marks")).alias("fingerprint"),
        text_of(F.col("edited_marks")).alias("edited_fingerprint"), "near_edited", "near_next",
    )
