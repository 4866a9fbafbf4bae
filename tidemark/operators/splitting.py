"""A sentence splitter that learns from the corpus which full stops end no sentence.

The method is that of Kiss and Strunk (2006): a word that nearly always has a full stop, is short and seldom stands
without one is an abbreviation, by a scaled log-likelihood ratio; pairs of words around a full stop that occur together
too often to have met by chance are collocations; words that follow sentence ends too often are sentence starters; and
whether a word is ever written small tells if its capital means anything. All of it follows from one table of counts,
``pairs``: of each word with its form and, where the word before had a full stop, that word. What is learnt is the
table of the pairs whose full stop ends no sentence; it is joined with the distinct tokens around the full stops of the
texts. Up to ``SENT`` pairs of tokens, counted first, are sent to the tasks, which cut each text where it lies; more are
joined by a shuffle with each full stop.

Defined cases: null and empty texts have no sentences; rows with equal or null ids are worked on by id and text, and
repeated rows all get their sentences; other columns pass through by name, but ``sentences`` must not be one."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tidemark.functions import text as T
from tidemark.operators.scans import matched
from tidemark.sources.stages import staged

#: The thresholds of the paper.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
SPACE = r"[ \t\n\r\f\x0B]+"
OPENING, CLOSING = "\"'([{“‘«", "\"')]}”’»"
OPENERS, CLOSERS = (f"[{re.escape(x)}]" for x in (OPENING, CLOSING))
#: A place where a sentence may end: before white space, after a terminator and what closes with it.
POINT = rf"(?=[ \t\n\r\f\x0B])(?<=[.!?]{CLOSERS}{{0,3}})"
NUMBER, ELLIPSIS = "##number##", "##ellipsis##"
#: Pairs of tokens around full stops that end no sentence, up to which they are sent to all tasks.
SENT = 200_000
#: Rows that a task holds before it hands them on.
HELD = 200_000
#: ``POINT`` in UTF-8, from its terminator on. White space of bytes is that of ``SPACE``.
_POINT = re.compile(rb"[.!?](?:%b){0,3}(?=[ \t\n\r\f\x0b])" % b"|".join(re.escape(c.encode()) for c in CLOSING))
#: Bytes that tokens which end like a sentence end with (some others do too, whose names don't matter either).
_ENDS = frozenset(c.encode()[-1] for c in ".!?" + CLOSING)
#: White space as column functions strip it.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def core(token: Column) -> Column:
    """The token without what opens before and closes behind it."""
    return F.rtrim(F.ltrim(token, F.lit(OPENING)), F.lit(CLOSING))


def analysed(token: Column) -> Column:
    """``word`` (in small letters, without its full stop), ``dot`` and ``form`` (upper, lower, other) of a token. A
    token of nothing but quotes has an empty word."""
    bare = core(token)
    dot = bare.endswith(".")
    word = F.lower(F.when(dot, F.left(bare, F.length(bare) - 1)).otherwise(F.rtrim(bare, F.lit(",;:!?"))))
    first = F.substring(bare, 1, 1)
    kind = F.when(bare.endswith(".."), ELLIPSIS).when(first.isin(*"-0123456789") & word.rlike(r"^-?[0-9]+([.,][0-9]+)*$"), NUMBER).otherwise(word)
    form = F.when(first != F.lower(first), "upper").when(first != F.upper(first), "lower").otherwise("other")
    return F.struct(kind.alias("word"), dot.alias("dot"), form.alias("form"))


def texts_of(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in UTF-8 (null: empty), some at a time, each time with the place of the first."""
    for at in range(0, batch.num_rows, 256):
        yield at, batch.column(text).slice(at, 256).cast(pa.binary()).fill_null(b"").to_pylist()


def strings(found: list[bytes | None]) -> pa.Array:
    return pa.array(found, pa.binary()).cast(pa.string(), safe=False)


def tallied(docs: DataFrame, text: str) -> DataFrame:
    """``this, last, n``: partial counts of each token, and of the token before it where that ends like a sentence, is
    empty (at a start), or else null."""

    def rows(every: Counter, after: Counter) -> pa.RecordBatch:
        found = [(*k, n) for k, n in after.items()]
        for (this, _), n in after.items():
            every[this] -= n
        found += [(k, None, n) for k, n in every.items() if n]
        this, last, n = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([strings(this), strings(last), pa.array(n, pa.int64())], names=["this", "last", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, after = Counter(), Counter()
        for batch in batches:
            for _, texts in texts_of(batch, text):
                for tokens in map(bytes.split, texts):
                    if tokens:
                        every.update(tokens)
                        after[tokens[0], b""] += 1
                        after.update([(this, last) for last, this in zip(tokens, tokens[1:]) if last[-1] in _ENDS])  # noqa: B905
                    if len(every) + len(after) > HELD:
                        yield rows(every, after)
                        every, after = Counter(), Counter()
        if every:
            yield rows(every, after)

    return docs.select(text).mapInArrow(run, "this string, last string, n bigint")


def pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``before, ended, word, dot, form, n``: how often each word occurs in each form, with and without a full stop,
    after which word with a full stop (else null), and after a terminator (``ended``) or not. Counted before shuffled."""
    # Few tokens end like a sentence; the others' names don't matter. What tokens are is worked out once for each pair.
    raw = tallied(docs, text).groupBy("this", "last").agg(F.sum("n").alias("n"))
    raw = raw.withColumns({"a": analysed(F.col("this")), "b": analysed(F.col("last")), "_end": F.right(core(F.col("last")), F.lit(1))})
    ended = F.coalesce((F.col("last") == "") | F.col("_end").isin(*".!?"), F.lit(False))
    each = raw.select(F.when(F.col("b.dot"), F.col("b.word")).alias("before"), ended.alias("ended"), "a.word", "a.dot", "a.form", "n")
    return each.groupBy("before", "ended", "word", "dot", "form").agg(F.sum("n").alias("n"))


def likelihood(k: Column, n: Column, p: Column) -> Column:
    """Log-likelihood of ``k`` successes of ``n`` at ``p``; nothing times the logarithm of nothing is nothing."""
    part = lambda x, q: F.when(x > 0, x * F.log(F.greatest(q, F.lit(1e-300)))).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def ratio(first: Column, second: Column, both: Column, n: Column) -> Column:
    """Dunning's ratio of two events' meeting ``both`` times among ``n``; 0 where they meet no more than by chance."""
    rest = F.greatest(n - first, F.lit(1))
    together = likelihood(both, first, both / first) + likelihood(second - both, rest, (second - both) / rest)
    apart = likelihood(both, first, second / n) + likelihood(second - both, rest, second / n)
    return F.when(both / first > second / n, 2 * (together - apart)).otherwise(0.0)


def sum_if(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def words(counts: DataFrame) -> DataFrame:
    """One row for each word: ``n_dot`` and ``n_plain``, with a full stop and without; ``n_ended``, after a terminator;
    and how it is written: small anywhere, with a capital anywhere, with one inside a sentence, small at a start."""
    upper, lower, dot, ended = F.col("form") == "upper", F.col("form") == "lower", F.col("dot"), F.col("ended")
    found = {"n_dot": dot, "n_plain": ~dot, "n_ended": ended, "small": lower, "capital": upper, "capital_inside": upper & ~ended, "small_first": lower & ended}
    return counts.groupBy("word").agg(*[sum_if(c).alias(k) for k, c in found.items()])


def scored(every: DataFrame) -> DataFrame:
    """The abbreviations' table from that of ``words``, which is read twice."""
    whole = every.agg(F.sum(F.col("n_dot") + F.col("n_plain")).alias("n_all"), F.sum("n_dot").alias("n_dots"))
    found = every.filter((F.col("n_dot") > 0) & F.col("word").rlike(r"\p{L}") & ~F.col("word").isin(NUMBER, ELLIPSIS)).join(F.broadcast(whole))  # one row
    k, n, p = F.col("n_dot"), F.col("n_dot") + F.col("n_plain"), F.col("n_dots") / F.col("n_all")
    likely = 2 * (likelihood(k, n, F.lit(0.99)) - likelihood(k, n, p))
    length = F.length(F.regexp_replace("word", r"\.", ""))
    inner = F.length("word") - length + 1
    return found.select("word", "n_dot", "n_plain", (likely * F.exp(-length) * inner * F.exp(-F.col("n_plain") * F.log(length))).alias("score"))


def abbreviations(counts: DataFrame) -> DataFrame:
    """``word, n_dot, n_plain, score`` of the words that ever have a full stop and hold a letter; from ``ABBREVIATION``
    on they count as abbreviations."""
    return scored(words(counts))


def inner_stops(counts: DataFrame) -> DataFrame:
    """``before, word, form``: the pairs whose full stop ends no sentence. ``counts`` is read twice: stage it."""
    every = staged(words(counts), "word-forms")
    short = scored(every).filter(F.col("score") >= ABBREVIATION).select(F.col("word").alias("before"), F.lit("abbreviation").alias("kind"))
    kinds = counts.filter(F.col("before").isNotNull()).join(short, "before", "left")
    kind = F.when(F.col("before") == NUMBER, "number").when(F.col("before") == ELLIPSIS, "abbreviation").when(F.col("before").rlike(r"^\p{L}$"), "initial").otherwise(F.coalesce("kind", F.lit("word")))
    # What follows an abbreviation, a number or an initial: only these words are judged.
    some = kinds.withColumn("kind", kind).filter(F.col("kind") != "word")
    some = staged(some.groupBy("before", "word", "form", "kind").agg(F.sum("n").alias("n"), sum_if(F.col("ended")).alias("n_not")), "word-stops")
    # What follows an ordinary word's terminator is what follows any, without what follows these.
    n_all = every.agg(F.sum(F.col("n_dot") + F.col("n_plain")).alias("n_all"), F.sum("n_ended").alias("_ended")).join(some.agg(F.coalesce(F.sum("n_not"), F.lit(0)).alias("_not")))
    n_all = F.broadcast(n_all.select("n_all", (F.col("_ended") - F.col("_not")).alias("n_ends")))  # one row
    judged = some.groupBy("word").agg(F.sum("n_not").alias("n_not")).join(every, "word").withColumns({"n_word": F.col("n_dot") + F.col("n_plain"), "n_after": F.col("n_ended") - F.col("n_not")})
    starter = F.col("word").rlike(r"^\p{L}") & (ratio(F.col("n_ends"), F.col("n_word"), F.col("n_after"), F.col("n_all")) >= STARTER)
    judged = staged(judged.join(n_all).withColumn("starter", F.when((F.col("n_after") > 0) & (F.col("n_ends") > 0), starter).otherwise(False)), "words-judged")
    stops = some.select("before").distinct().join(every.select(F.col("word").alias("before"), F.col("n_dot").alias("n_before")), "before")
    two = some.groupBy("before", "word").agg(F.sum("n").alias("n_both")).filter("n_both > 1").join(stops, "before").join(judged.select("word", "n_word", "n_all"), "word")
    bound = two.filter(ratio(F.col("n_before"), F.col("n_word"), F.col("n_both"), F.col("n_all")) >= COLLOCATION).select("before", "word", F.lit(True).alias("bound"))
    told = some.select("before", "word", "form", "kind").join(judged.select("word", "small", "capital", "capital_inside", "small_first", "starter"), "word").join(bound, ["before", "word"], "left")
    upper, lower = F.col("form") == "upper", F.col("form") == "lower"
    starts = upper & (F.col("small") > 0) & (F.col("capital_inside") == 0)
    inside = lower & ((F.col("capital") > 0) | (F.col("small_first") == 0))
    ends_here = (
        F.when(F.col("bound"), False)
        .when(F.col("kind") == "abbreviation", starts | (upper & F.col("starter")))
        .otherwise(~inside & ~((F.col("kind") == "initial") & upper & (F.col("small") == 0)))
    )
    return told.filter(~ends_here).select("before", "word", "form")


def parts_of(text: bytes) -> list[bytes]:
    """The text, stripped, cut at each place where a sentence may end."""
    text = text.decode("utf-8", "replace").strip(_WHITE).encode()
    cuts = [m.end() for m in _POINT.finditer(text)]
    return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def tokens_around(parts: list[bytes]) -> list[bytes]:
    """The tokens before and after each of these places but the last, with a space between."""
    return [b"%b %b" % (x.rsplit(None, 1)[-1], y.split(None, 1)[0]) for x, y in zip(parts, parts[1:])]  # noqa: B905


def around_stops(docs: DataFrame, text: str) -> DataFrame:
    """``around, b, a``: the distinct tokens around the full stops of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[bytes] = set()
        for batch in batches:
            for _, texts in texts_of(batch, text):
                for each in texts:
                    found.update(tokens_around(parts_of(each)))
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([strings([*found])], names=["around"])
                    found = set()
        if found:
            yield pa.RecordBatch.from_arrays([strings([*found])], names=["around"])

    each = docs.select(text).mapInArrow(run, "around string").distinct()
    each = each.select("around", F.substring_index("around", " ", 1).alias("b"), F.substring_index("around", " ", -1).alias("a"))
    return each.filter(core(F.col("b")).endswith("."))


def cut(docs: DataFrame, inner: list[bytes], least: int, text: str) -> DataFrame:
    """``docs`` with ``sentences``; ``inner`` holds the tokens around the full stops that end none."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(inner))  # at most SENT

    def sentences(text: bytes, inner: frozenset[bytes]) -> list[str]:
        parts, whole = parts_of(text), []
        ends = [x not in inner for x in tokens_around(parts)]
        first = 0
        for i, end in enumerate([*ends, True], 1):
            if end:
                whole.append(b"".join(parts[first:i]))
                first = i
        lines = (line.strip(_WHITE) for s in whole for line in s.decode().split("\n"))
        return [line for line in lines if len(line) >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in texts_of(batch, text):
                part = batch.slice(at, len(texts))
                found = pa.array([sentences(x, shared.value) for x in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, "sentences"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("sentences", ArrayType(StringType()))]))


def split(docs: DataFrame, stops: DataFrame, least: int = T.LEAST_SENTENCE, key: str = "doc_id", text: str = "text", sent: int = SENT) -> DataFrame:
    """``docs`` with ``sentences``, an array. ``stops`` is what ``inner_stops`` gives. Up to ``sent`` pairs of tokens
    around stops that end no sentence are sent to the tasks, and no text is shuffled."""
    around = around_stops(docs, text)
    around = around.select("around", analysed(F.col("b")).alias("b"), analysed(F.col("a")).alias("a"))
    around = around.select("around", F.col("b.word").alias("before"), F.col("a.word").alias("word"), F.col("a.form").alias("form"))
    inner = staged(matched(around, stops, ["before", "word", "form"]).select("around"), "stops-around")
    if inner.count() > sent:
        return split_by_join(docs, stops, least, key, text)
    return cut(docs, [r["around"].encode() for r in inner.collect()], least, text)


def split_by_join(docs: DataFrame, stops: DataFrame, least: int, key: str, text: str) -> DataFrame:
    """``split`` for any number of stops. The stops are joined by what stands around them, and by document only those
    that end no sentence come back."""
    rows = docs.withColumns({"_parts": F.split(T.stripped(F.coalesce(F.col(text), F.lit(""))), POINT), "_hash": F.xxhash64(key, text)})
    following = F.slice("_parts", F.lit(2), F.size("_parts"))
    each = rows.select(F.col(key).alias("_key"), "_hash", F.posexplode(F.arrays_zip(F.col("_parts").alias("part"), following.alias("after"))).alias("_at", "_z"))
    plain = lambda x: F.ltrim(F.translate(x, "\t\n\r\f\x0b", "     "))
    last, next_ = F.substring_index(plain(F.col("_z.part")), " ", -1), F.substring_index(plain(F.col("_z.after")), " ", 1)
    around = each.filter(F.col("_z.after").isNotNull()).select("_key", "_hash", "_at", last.alias("b"), next_.alias("a")).filter(core(F.col("b")).endswith("."))
    around = around.select("_key", "_hash", "_at", analysed(F.col("b")).alias("b"), analysed(F.col("a")).alias("a"))
    around = around.select("_key", "_hash", "_at", F.col("b.word").alias("before"), F.col("a.word").alias("word"), F.col("a.form").alias("form"))
    # Joined so that nulls would match: else each key is worked out once more to see that it is none.
    inner = matched(around, stops, ["before", "word", "form"]).groupBy("_key", "_hash").agg(F.collect_set("_at").alias("_inner"))
    both = rows.join(inner.withColumnRenamed("_hash", "_of"), rows[key].eqNullSafe(F.col("_key")) & (F.col("_hash") == F.col("_of")), "left")
    ends = F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.coalesce("_inner", F.array().cast("array<int>")))
    both = both.withColumn("_ends", ends)
    before = lambda i: F.when(i > 0, F.get("_ends", i - 1)).otherwise(-1)
    # Taking a slice reads the whole array: only sentences of several parts pay for it, and only texts that have some.
    several = lambda end, i: F.array_join(F.slice("_parts", before(i) + 2, end - before(i)), "")
    whole = F.transform("_ends", lambda end, i: F.when(end - before(i) == 1, F.get("_parts", end)).otherwise(several(end, i)))
    whole = F.when(F.col("_inner").isNull(), F.col("_parts")).otherwise(whole)
    return both.withColumn("sentences", T.lines_of(whole, least)).select(*docs.columns, "sentences")

