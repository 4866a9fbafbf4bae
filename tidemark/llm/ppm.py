"""Language-model scores by prediction by partial matching over bytes, beside word unigrams.

A text's bytes, A-Z lower-cased and white space folded, are predicted one by one from the ``ORDER`` bytes
before them. The trie of all contexts is a Spark table: the counts of byte strings of ``ORDER + 1`` bytes
over every training text, from which those of shorter ones are sums. A byte seen after its context gets
``n / (N + D)`` (its count, all, distinct); one not seen costs the escape ``D / (N + D)`` and is predicted
from the next shorter context, with what the longer one had seen left out of ``n``, ``N`` and ``D``; below
the empty context the remaining bytes are alike. As a string's cost never changes, joins work out the cost
of each distinct string of the corpus once, and a text's score is the sum over its places.

The costs of the most frequent strings and words, ``BROADCAST_ROWS`` of each at most, are broadcast. A text's other
strings and words, few as they are rare, are joined to the rest of the tables by a shuffle and added to its sums, at
any size of the corpus; where a whole table is broadcast, no such join is left to do. The vocabulary is keyed by
64-bit word hashes.

Defined cases: null and empty texts are the end alone; without training texts all bytes are alike and no
token is known; null ids count as the empty string's fold; rows equal in id and text get equal rows, each
counted in training; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.stage import keyed, staged

ORDER = 4
#: Rows (of 16 bytes) of either cost table that are broadcast at most.
BROADCAST_ROWS = 500_000
#: Distinct strings or words that a task sums up before it passes them on.
FLUSH = 1_000_000
END = b"\n"


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def strings(words: list[list[bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every place of every text its byte with the ``order`` before it, as one number, and the text's index."""
    streams = [b"".join([b" " + w for w in each]) + END for each in words]
    data = np.frombuffer(b"".join([END * order + s for s in streams]), np.uint8).astype(np.int64)
    size = np.array([len(s) for s in streams], np.int64)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) + (row + 1) * order
    found = np.zeros(len(row), np.int64)
    for back in range(order, -1, -1):
        found = (found << 8) | data[at - back]
    return found, row


def split(part: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or "").encode().lower().split() for t in part.column("text").to_pylist()]


def hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    return tokens.word_hashes(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends[:-1]]) if len(ends) else ends, ends).view(np.int64)


def counted(docs: DataFrame, order: int) -> DataFrame:
    """Partial sums of training counts: ``gram, word, n``, one of the first two null. Held-out strings count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary: Counter[bytes] = Counter()
        grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(g=(), w=(), n=()) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(g if len(g) else [None] * len(w), pa.int64()), pa.array(w if len(w) else [None] * len(g), pa.binary()), pa.array(n, pa.int64())], names=["gram", "word", "n"])

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                words, learn = split(part), ~part.column("held_out").to_numpy(zero_copy_only=False)
                found, row = strings(words, order)
                found, place = np.unique(np.concatenate([grams, found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, learn[row]]), len(found)).astype(np.int64)
                grams = found
                for each, use in zip(words, learn, strict=True):
                    if use:
                        vocabulary.update(each)
                        vocabulary[END] += 1
                if len(grams) > FLUSH:
                    yield rows(g=grams, n=counts)
                    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(vocabulary) > FLUSH:
                    yield rows(w=list(vocabulary), n=list(vocabulary.values()))
                    vocabulary.clear()
        yield rows(g=grams, n=counts)
        yield rows(w=list(vocabulary), n=list(vocabulary.values()))

    return docs.select("text", "held_out").mapInArrow(run, "gram bigint, word binary, n bigint")


def low(column: str, length: int) -> Column:
    """The last ``length`` bytes of a string."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * length) - 1))


def string_costs(grams: DataFrame, order: int) -> DataFrame:
    """``key, cost, n`` (log10 of the probability) for every ``gram`` with its training count ``n`` (0: not seen)."""
    seen = staged(grams.filter("n > 0"), "lm-seen")
    contexts = lambda t: t.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("all"), F.count("*").alias("distinct"))
    above = contexts(seen)
    rest = grams.filter("n = 0").select("gram", F.shiftright("gram", 8).alias("context")).join(above.hint("merge"), "context", "left")
    whole, sorts = F.coalesce("all", F.lit(0)), F.coalesce("distinct", F.lit(0))
    rest = staged(rest.select("gram", F.when(sorts > 0, F.log10(sorts / (whole + sorts))).otherwise(0.0).alias("cost"), sorts.alias("gone")), "lm-rest")
    known = seen.withColumn("context", F.shiftright("gram", 8)).join(above.hint("merge"), "context")
    costs = known.select(F.col("gram").alias("key"), F.log10(F.col("n") / (F.col("all") + F.col("distinct"))).alias("cost"), "n")
    for length in range(order, 0, -1):  # bytes of the string that are left, its last one included
        shorter = staged(seen.groupBy(low("gram", length).alias("gram")).agg(F.sum("n").alias("n")), "lm-shorter")
        # What the longer context had seen, by its counts here.
        longer = rest.select(low("gram", length + 1).alias("gram")).select(F.shiftright("gram", 8).alias("context")).distinct()
        left = seen.withColumn("context", F.shiftright("gram", 8)).join(longer.hint("merge"), "context").select("context", low("gram", length).alias("gram"))
        left = left.join(shorter.hint("merge"), "gram").groupBy("context").agg(F.sum("n").alias("left_out"))
        here = rest.withColumns({"long": F.shiftright(low("gram", length + 1), 8), "short": low("gram", length), "context": F.shiftright(low("gram", length), 8)})
        here = here.join(left.withColumnRenamed("context", "long").hint("merge"), "long", "left").join(contexts(shorter).hint("merge"), "context", "left").join(shorter.withColumnRenamed("gram", "short").hint("merge"), "short", "left")
        d = F.coalesce("distinct", F.lit(0)) - F.col("gone")
        total = F.coalesce("all", F.lit(0)) - F.coalesce("left_out", F.lit(0)) + d
        step = F.when(d <= 0, 0.0).otherwise(F.log10(F.try_divide(F.coalesce("n", d), total)))
        here = staged(here.select("gram", (F.col("cost") + step).alias("cost"), F.coalesce("distinct", F.lit(0)).alias("gone"), F.col("n").isNotNull().alias("hit")), "lm-here")
        costs = costs.union(here.filter("hit").select("gram", "cost", F.lit(0).cast("bigint")))
        rest, seen = here.filter("not hit"), shorter
    return costs.union(rest.select("gram", F.col("cost") - F.log10((256 - F.col("gone")).cast("double")), F.lit(0).cast("bigint")))


def word_costs(words: DataFrame, total: int, sorts: int) -> DataFrame:
    """``key, cost, n`` of every word of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(hashes(batch.column("word").to_pylist())), pa.array(np.log10((n + 0.5) / (total + 0.5 * (sorts + 1)))), batch.column("n")], names=["key", "cost", "n"])

    return words.mapInArrow(run, "key bigint, cost double, n bigint")


def look_up(keys: np.ndarray, costs: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted)), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return costs[at], keys[at] == wanted


def per_text(part: pa.RecordBatch, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of a slice's strings, then of its words: keys, the index of their text, and their kind."""
    words = split(part)
    yield *strings(words, order), 0
    every = [w for each in words for w in each]
    yield hashes(every), np.repeat(np.arange(len(words)), [len(w) for w in words]), 1


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document row ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    rows = keyed(docs).withColumn("held_out", held_out(F.col("doc_id")))
    counts = staged(counted(rows, order), "lm-counts")
    words = staged(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("sorts"), F.coalesce(F.max(F.when(F.col("word") == F.lit(END), F.col("n"))), F.lit(0)).alias("ends")).first()
    total, sorts, ends = facts["total"], facts["sorts"], facts["ends"]
    grams = staged(counts.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams")
    tables = [staged(string_costs(grams, order), "lm-costs"), staged(word_costs(words, total, sorts), "lm-vocabulary")]
    other = float(np.log10(0.5 / (total + 0.5 * (sorts + 1))))
    end = float(np.log10((ends + 0.5) / (total + 0.5 * (sorts + 1))))
    out = _summed(rows, tables, order, other)
    n = F.col("n_words") + 1
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), n.cast("bigint").alias("n_tokens"), (F.col("n_known") + int(ends > 0)).cast("bigint").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), (F.col("base") + end).alias("base_score"), "score")


def _frequent(table: DataFrame) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Sorted keys and costs of the most frequent rows, at most ``BROADCAST_ROWS``, and the least count that all such
    rows have (null: the whole table). Counts are taken by powers of two: at most 64 rows."""
    level = F.floor(F.log2(F.col("n") + 1)).cast("int")
    sizes = {r["level"]: r["rows"] for r in table.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).collect()}
    held, least = 0, 1 << 62
    for found in sorted(sizes, reverse=True):
        held += sizes[found]
        if held > BROADCAST_ROWS:
            break
        least = (1 << found) - 1
    whole = held <= BROADCAST_ROWS
    found = (table if whole else table.filter(F.col("n") >= least)).select("key", "cost").sort("key").toArrow()
    return found.column("key").to_numpy(), found.column("cost").to_numpy(), None if whole else least


def _summed(rows: DataFrame, tables: list[DataFrame], order: int, other: float) -> DataFrame:
    """Per row ``doc_id, n_words, n_known, base, score`` from the tables of strings and of words."""
    frequent = [_frequent(t) for t in tables]
    shared = rows.sparkSession.sparkContext.broadcast([f[:2] for f in frequent])
    partial = [f[2] is not None for f in frequent]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text"):
                sums, rare = [], []
                for wanted, row, kind in per_text(part, order):
                    each, place = np.unique(wanted, return_inverse=True)
                    cost, known = look_up(*shared.value[kind], each)
                    left = ~known & partial[kind]
                    cost = np.where(left, 0.0, np.where(known, cost, other) if kind else cost)
                    sums += [np.bincount(row, cost[place], part.num_rows), np.bincount(row, known[place], part.num_rows).astype(np.int64), np.bincount(row, minlength=part.num_rows)]
                    if left.any():
                        cell, n = np.unique((row * len(each) + place)[left[place]], return_counts=True)
                        rare.append((cell // len(each), np.full(len(n), kind, np.int32), each[cell % len(each)], n))
                of, kinds, keys, n = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
                # A list in each row: what of the text is left to the join.
                cuts = np.argsort(of, kind="stable")
                fields = [pa.array(x[cuts]) for x in (kinds, keys, n)]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of[cuts], np.arange(part.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays(fields, names=["kind", "key", "n"]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(sums[5]), pa.array(sums[4]), pa.array(sums[3]), pa.array(sums[0]), lists], names=["doc_id", "row", "n_words", "n_known", "base", "score", "rare"])

    kind = dict(rows.dtypes)["doc_id"]
    numbered = rows.select("doc_id", F.xxhash64("doc_id", "text_hash").alias("row"), "text")
    found = numbered.mapInArrow(run, f"doc_id {kind}, row bigint, n_words bigint, n_known bigint, base double, score double, rare array<struct<kind:int,key:bigint,n:bigint>>")
    names = ["doc_id", "n_words", "n_known", "base", "score"]
    if not any(partial):
        return found.select(names)
    found = staged(found, "lm-sums")
    rest = None
    for k, (table, (_, _, least)) in enumerate(zip(tables, frequent, strict=True)):
        some = table.filter(F.col("n") < least) if least is not None else table.limit(0)
        some = some.select(F.lit(k).alias("kind"), "key", "cost")
        rest = some if rest is None else rest.union(some)
    # Rows equal in id and text have equal lists: one of them is joined.
    lists = found.filter(F.size("rare") > 0).groupBy("row").agg(F.first("rare").alias("rare")).select("row", F.inline("rare"))
    word, n = F.col("kind") == 1, F.col("n")
    more = lists.join(rest.hint("merge"), ["kind", "key"], "left").groupBy("row").agg(
        F.coalesce(F.sum(F.when(word & F.col("cost").isNotNull(), n)), F.lit(0)).alias("more_known"),
        F.coalesce(F.sum(F.when(word, n * F.coalesce("cost", F.lit(other)))), F.lit(0.0)).alias("more_base"),
        F.coalesce(F.sum(F.when(~word, n * F.col("cost"))), F.lit(0.0)).alias("more_score"),
    )
    both = found.join(more, "row", "left")
    added = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_known", "more_known"), ("base", "more_base"), ("score", "more_score"))]
    return both.select("doc_id", "n_words", *added)
