"""Fill-in-middle transformation over relational units.

A text is cut into units: the matches, from left to right, of a pattern (by default single code points). Two tables of
units of different grain tell where unit i starts. ``posexplode`` of the matches of RUN units gives runs with their lengths, whose
running sum in a window is a run's start; cut requests join the run that holds their unit's ordinal. Only such runs are
exploded into their single units, and the same window and join by ordinal give a cut's offset in its run. Offsets are
aggregated for each text and join the texts, which are then cut by ``substring``. So a text costs rows in proportion to its
length / RUN, and a window never holds more than one text's runs.

Texts are told apart by two hashes of doc_id and text, so that rows which repeat share their units, and no row needs an id.
Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = "(?s:.)"
RUN = 128
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1
KEY = ["k1", "k2"]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (never null) with the two hashes that tell texts apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("k1"), F.xxhash64(text, F.lit(7), "doc_id").alias("k2"))


def _starts(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``start``: the running sum of the lengths before a row."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed:doc_id (a null doc_id counts as an empty one)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_offsets(texts: DataFrame, unit: str = UNIT, run: int = RUN, seed: int = SEED) -> DataFrame:
    """For each different (k1, k2) of ``texts`` (doc_id, text, k1, k2) that has a text: n units, and the code points before the first and the second cut.

    Cuts come before unit min and max of two draws modulo n + 1; a cut at n is the text's end. The pattern's matches must
    cover the text, or the query fails.
    """
    h1, h2, _, _ = draws(F.col("doc_id"), seed)
    uncovered = F.raise_error(F.lit("units do not cover the text"))
    runs = F.regexp_extract_all("text", F.lit(f"(?:{unit}){{1,{run}}}"), F.lit(0))
    found = texts.select(*KEY, h1.alias("h1"), h2.alias("h2"), F.char_length("text").alias("size"), runs.alias("runs")).where("size > 0")
    n = (F.size("runs") - 1).cast("long") * run + F.regexp_count(F.try_element_at("runs", F.lit(-1)), F.lit(unit))
    n = F.when(F.size("runs") > 0, n).otherwise(uncovered.cast("long"))
    counted = found.withColumn("n", n).withColumn("a", F.expr("h1 % (n + 1)")).withColumn("b", F.expr("h2 % (n + 1)"))
    cuts = F.array(F.least("a", "b"), F.greatest("a", "b"))
    pieces = F.transform("cuts", lambda c: F.get("runs", F.floor(c / run).cast("int")))  # the runs that are cut, with their text
    one = counted.withColumn("cuts", cuts).select(*KEY, F.struct("n", "size", "cuts", F.transform("runs", F.char_length).alias("lengths"), pieces.alias("pieces")).alias("x"))
    # rows that repeat agree in everything; they combine before they are shuffled, and all that follows stays where its key is
    once = one.groupBy(*KEY).agg(F.max("x").alias("x")).select(*KEY, "x.*")
    requests = once.select(*KEY, "n", "size", F.posexplode("cuts").alias("cut", "ordinal"))
    cut_in = lambda i: F.floor(F.col("cuts")[i] / run) == F.col("r")
    rows = once.select(*KEY, "size", "cuts", "pieces", F.posexplode("lengths").alias("r", "length"))
    rows = rows.select(*KEY, "size", "r", "length", F.when(cut_in(0), F.col("pieces")[0]).when(cut_in(1), F.col("pieces")[1]).alias("piece"), "cuts")
    covered = F.when(F.sum("length").over(Window.partitionBy(*KEY)) == F.col("size"), F.col("r")).otherwise(uncovered.cast("int"))
    starts = _starts(rows, KEY, "r").withColumn("r", covered)
    held = starts.where("piece is not null or r = 0")  # a text's first run stays for the check of its cover
    units = held.select(*KEY, "r", "start", "cuts", F.posexplode(F.regexp_extract_all(F.coalesce("piece", F.lit("")), F.lit(unit), F.lit(0))).alias("i", "u"))
    units = units.select(*KEY, "r", "start", "cuts", "i", F.char_length("u").alias("length")).withColumnRenamed("start", "before")
    places = _starts(units, [*KEY, "r"], "i").withColumn("unit", F.col("r").cast("long") * run + F.col("i")).where("array_contains(cuts, unit)")
    places = places.select(*KEY, "unit", (F.col("before") + F.col("start")).alias("offset"))
    # joined where they are, by key and then by ordinal; a cut at n has no unit and ends the text
    asked = requests.join(places, [*(requests[k] == places[k] for k in KEY), requests.ordinal - places.unit == 0], "left").select(*(requests[k] for k in KEY), "n", "size", "cut", "offset")
    offset = lambda c: F.coalesce(F.max(F.when(F.col("cut") == c, F.col("offset"))), F.max("size")).cast("int")
    return asked.groupBy(*KEY).agg(F.max("n").alias("n"), offset(0).alias("first_cut"), offset(1).alias("second_cut"))


def fill_in_middle(docs: DataFrame, unit: str = UNIT, run: int = RUN, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n units, form, prefix, middle and suffix (null if plain) and the output of every row.

    A null text counts as empty; empty texts and those that hold a sentinel are plain, as is a share of the others; rows that
    repeat give equal rows, a null doc_id draws as an empty one; an empty table gives no rows, further columns are not read.
    """
    texts = _keyed(docs.select("doc_id", "text"))
    offsets = cut_offsets(texts, unit, run, seed)
    _, _, h3, h4 = draws(F.col("doc_id"), seed)
    sentinel = F.contains("text", F.lit(SENTINELS[0])) | F.contains("text", F.lit(SENTINELS[1])) | F.contains("text", F.lit(SENTINELS[2]))
    form = F.when((F.col("text") == "") | sentinel | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    rows = texts.join(offsets, KEY, "left").select("doc_id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"), form.alias("form"), F.coalesce("first_cut", F.lit(0)).cast("int").alias("a"), F.coalesce("second_cut", F.lit(0)).cast("int").alias("b"))
    cut = F.col("form") != "plain"
    parts = rows.select(
        "doc_id", "n", "form", F.when(~cut, F.col("text")).alias("text"), F.when(cut, F.substring("text", F.lit(1), F.col("a"))).alias("prefix"),
        F.when(cut, F.substring("text", F.col("a") + 1, F.col("b") - F.col("a"))).alias("middle"), F.when(cut, F.substring("text", F.col("b") + 1, F.lit(2**31 - 1))).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in SENTINELS)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return parts.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: no part holds a sentinel, and no sentinel can begin in a part and end in the next, as each begins with its only ``<``."""
    p, s, m = SENTINELS
    rest = F.substring(output, F.lit(1 + len(p)), F.lit(2**31 - 1))
    first, head = (lambda x: F.substring_index(rest, x, 1)), (lambda x: F.substring_index(rest, x, -1))
    psm = F.concat(first(s), F.substring_index(rest, m, -1), F.substring_index(head(s), m, 1))
    spm = F.concat(F.substring_index(head(p), m, 1), F.substring_index(rest, m, -1), first(p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle_digests(docs: DataFrame, **options) -> DataFrame:
    """As ``fill_in_middle``, with lengths and digests in place of texts."""
    rows = fill_in_middle(docs, **options)
    return rows.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"), F.char_length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
