"""Benchmark decontamination: a hash set of normalised benchmark windows, looked up at every window of every document.

A-Z are lower-cased; words are runs of letters, digits and everything beyond ASCII. A window is ten
consecutive words of an item; an item of fewer words, but not none, is one window. Only DataFrame
functions are used. The set is broadcast while it holds at most ``BROADCAST_WINDOWS`` windows (counted
first); a larger one is joined by a shuffle on the key. The key
hashes a window's first, middle and last word; equal keys are verified word by word.

Defined cases: null and empty texts have no words and are clean; null items are no items' windows; items
of equal text are all reported; rows equal in id and text are reported as often as they occur; an empty
benchmark leaves all clean; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import keyed, text_hash

WINDOW = 10
#: Windows (of about 200 bytes each) up to which the benchmark's set is broadcast.
BROADCAST_WINDOWS = 500_000
#: What separates words, in ASCII; one look-up table also lower-cases.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    line = F.trim(F.translate(F.coalesce(text, F.lit("")), BREAKS + UPPER, " " * len(BREAKS) + LOWER))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, " +"))


def starts(size: Column, length: int) -> Column:
    """The one-based starts of the windows of ``length`` words among ``size`` words."""
    return F.when(size >= length, F.sequence(F.lit(1), size - (length - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``gram`` (its words), ``gram_hash`` (of its anchors) and the ``items`` that hold it."""
    items = benchmark.filter(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("w"))
    size = F.size("w")
    grams = F.when(size >= window, F.transform(starts(size, window), lambda i: F.slice("w", i, window))).when(size > 0, F.array("w"))
    rows = items.select("item_id", F.explode_outer(grams).alias("gram")).filter(F.col("gram").isNotNull())
    return rows.groupBy("gram").agg(F.collect_set("item_id").alias("items")).withColumn("gram_hash", anchors(F.col("gram"), F.lit(0), F.size("gram")))


def anchors(words: Column, at: Column, n: Column) -> Column:
    """The hash of a window's first, middle and last word (zero-based ``at``): the key of the set."""
    return F.xxhash64(F.get(words, at), F.get(words, at + F.shiftright(n, 1)), F.get(words, at + n - 1))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document row key: ``n_words``, ``copies`` (rows equal in id and text), the covered word places
    ``hit`` (one-based, ascending) and the ``items`` found (sorted as strings)."""
    grams = benchmark_windows(benchmark, window)
    facts = grams.select(F.size("gram").alias("n")).groupBy("n").count().collect()  # at most WINDOW rows
    lengths = sorted(r["n"] for r in facts) or [window]
    small = sum(r["count"] for r in facts) <= BROADCAST_WINDOWS
    parsed = keyed(docs).select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    # Every word place is a probe; place 0 (or none, without words) also stands for the document, so that one pass
    # gives counts and hits. Generate, probe and join run as one compiled stage, in which ``w`` isn't copied.
    rows = parsed.select("doc_id", "text_hash", "w", F.posexplode_outer("w").alias("at", "word"))
    rows = rows.withColumn("n", F.lit(lengths[0]) if len(lengths) == 1 else F.explode(F.array(*map(F.lit, lengths))))
    whole = (F.coalesce("at", F.lit(0)) == 0) & (F.col("n") == lengths[0])
    key, seen = anchors(F.col("w"), F.col("at"), F.col("n")), F.slice("w", F.coalesce("at", F.lit(0)) + 1, F.col("n"))
    if small:
        grams = F.broadcast(grams)
        # Two inequalities, as an equality would become part of the join key and cut a window at every word.
        match = (key == F.col("gram_hash")) & (seen >= F.col("gram")) & (seen <= F.col("gram"))
    else:  # the window travels, not the document
        rows = rows.select("doc_id", "text_hash", F.size("w").alias("size"), "at", "n", key.alias("key"), seen.alias("seen"))
        match = (F.col("key") == F.col("gram_hash")) & (F.col("seen") == F.col("gram"))
    found = rows.join(grams, match, "left").filter(whole | F.col("items").isNotNull())
    places = F.when(F.col("items").isNotNull(), F.struct((F.col("at") + 1).alias("at"), "n"))
    size = F.size("w") if small else F.col("size")
    merged = found.select("doc_id", "text_hash", F.when(whole, size).alias("size"), places.alias("place"), "items").groupBy("doc_id", "text_hash").agg(
        F.max("size").cast("bigint").alias("n_words"),
        F.count("size").cast("int").alias("copies"),
        F.collect_set("place").alias("places"),
        F.collect_set("items").alias("items"),
    )
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["at"], p["at"] + p["n"] - 1)))))
    names = F.array_sort(F.array_distinct(F.transform(F.flatten("items"), lambda i: i.cast("string"))))
    return merged.select("doc_id", "text_hash", "n_words", "copies", covered.alias("hit"), names.alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    n_hit = F.size("hit").cast("bigint")
    return hits(docs, benchmark, window).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that hold no benchmark window, with their own columns, whatever their names."""
    bad = hits(docs, benchmark, window).filter(F.size("hit") > 0).select("doc_id", "text_hash")
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_hash("text").alias("hash"))
    return whole.join(bad, whole["id"].eqNullSafe(bad["doc_id"]) & (whole["hash"] == bad["text_hash"]), "left_anti").select("row.*")
