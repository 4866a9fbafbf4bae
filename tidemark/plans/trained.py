"""Queries of the sentence splitter that learns from the corpus, each with its SQL oracle.

The documents hold invented words and no abbreviations, so every second one is given a lead with some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import splitting as S
from tidemark.sources.stages import staged


def documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    i = F.col("doc_id")
    city = F.element_at(F.array(*map(F.lit, ("Oslo", "Bern", "Rome"))), (i % 3 + 1).cast("int"))
    lead = F.concat(F.lit("The U.S. Federal board met in "), city, F.lit(" at "), i % 12, F.lit(" p.m. on Jan. "), i % 28 + 1, F.lit(" for talks. The vote of J. Smith (no. "), i % 7, F.lit(') was "no." So the board met. '))
    return docs.withColumn("text", F.when(i % 2 == 0, F.concat(lead, F.coalesce("text", F.lit("")))).otherwise(F.col("text")))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return staged(S.pairs(documents(spark, sf)), "word-pairs")


def abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """The words that count as abbreviations, with their scores."""
    found = S.abbreviations(counts(spark, sf)).filter(F.col("score") >= S.ABBREVIATION)
    return found.withColumn("score", F.round("score", 4))


def inner_stops(spark: SparkSession, sf: str) -> DataFrame:
    return S.inner_stops(counts(spark, sf))


def sentences_trained(spark: SparkSession, sf: str) -> DataFrame:
    found = S.split(documents(spark, sf), staged(S.inner_stops(counts(spark, sf)), "inner-stops"))
    return found.select("doc_id", F.posexplode("sentences").alias("idx", "sentence"))


QUERIES = {f.__name__: f for f in (abbreviations, inner_stops, sentences_trained)}


def _log(k: str, n: str, p: str) -> str:
    part = lambda x, q: f"CASE WHEN {x} > 0 THEN ({x}) * ln(greatest({q}, 1e-300)) ELSE 0 END"
    return f"({part(k, p)} + {part(f'({n} - {k})', f'(1 - {p})')})"


def _ratio(a: str, b: str, both: str, n: str) -> str:
    rest = f"greatest({n} - {a}, 1)"
    together = f"{_log(both, a, f'{both} / {a}')} + {_log(f'({b} - {both})', rest, f'({b} - {both}) / {rest}')}"
    apart = f"{_log(both, a, f'{b} / {n}')} + {_log(f'({b} - {both})', rest, f'{b} / {n}')}"
    return f"CASE WHEN {both} / {a} > {b} / {n} THEN 2 * ({together} - ({apart})) ELSE 0 END"


_TRIM, _SPACE = r"E' \t\n\r\f\x0b'", r"[ \t\n\r\f\x0B]"
_OPEN, _CLOSE = S.OPENERS.replace("'", "''"), S.CLOSERS.replace("'", "''")
_SMALL = r"regexp_matches({0}, '^\p{{L}}$')"
DOCS = r"""d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'The U.S. Federal board met in ' || ['Oslo', 'Bern', 'Rome'][doc_id % 3 + 1] || ' at ' || doc_id % 12 || ' p.m. on Jan. ' || (doc_id % 28 + 1)
  || ' for talks. The vote of J. Smith (no. ' || doc_id % 7 || ') was "no." So the board met. ' || coalesce(text, '') ELSE text END AS text FROM documents)"""
PAIRS = f"""{DOCS}, l AS (SELECT list_filter(regexp_split_to_array(trim(coalesce(text, ''), {_TRIM}), '{_SPACE}+'), lambda x: x <> '') AS l FROM d),
z AS (SELECT unnest(l) AS this, unnest(list_concat([''], list_slice(l, 1, len(l) - 1))) AS last FROM l WHERE len(l) > 0),
n1 AS (SELECT t, regexp_replace(regexp_replace(t, '^{_OPEN}+', ''), '{_CLOSE}+$', '') AS bare FROM (SELECT DISTINCT this AS t FROM z UNION SELECT '')),
n2 AS (SELECT *, ends_with(bare, '.') AS dot, lower(CASE WHEN ends_with(bare, '.') THEN regexp_replace(bare, '\\.$', '') ELSE regexp_replace(bare, '[,;:!?]+$', '') END) AS w, substr(bare, 1, 1) AS c FROM n1),
an AS (SELECT t, dot, CASE WHEN ends_with(bare, '..') THEN '{S.ELLIPSIS}' WHEN regexp_matches(w, '^-?[0-9]+([.,][0-9]+)*$') THEN '{S.NUMBER}' ELSE w END AS word, CASE WHEN c <> lower(c) THEN 'upper' WHEN c <> upper(c) THEN 'lower' ELSE 'other' END AS form,
  t = '' OR dot OR ends_with(bare, '!') OR ends_with(bare, '?') AS ends FROM n2),
g AS (SELECT CASE WHEN b.dot THEN b.word END AS before, b.ends AS ended, a.word, a.dot, a.form, count(*) AS n FROM z JOIN an a ON this = a.t JOIN an b ON last = b.t GROUP BY ALL),
na AS (SELECT sum(n) AS n_all, sum(n) FILTER (dot) AS n_dots FROM g),
ab0 AS (SELECT word, coalesce(sum(n) FILTER (dot), 0) AS k, coalesce(sum(n) FILTER (NOT dot), 0) AS m FROM g GROUP BY 1),
ab AS (SELECT word, k, m, 2 * ({_log("k", "(k + m)", "0.99")} - {_log("k", "(k + m)", "(n_dots / n_all)")}) * exp(-length(replace(word, '.', ''))) * (length(word) - length(replace(word, '.', '')) + 1) * exp(-m * ln(length(replace(word, '.', '')))) AS score
  FROM ab0, na WHERE k > 0 AND regexp_matches(word, '\\p{{L}}') AND word NOT IN ('{S.NUMBER}', '{S.ELLIPSIS}'))""".replace("\\\\", "\\")
STOPS = f"""{PAIRS}, kn AS (SELECT before, word, form, n, ended, CASE WHEN before = '{S.NUMBER}' THEN 'number' WHEN before = '{S.ELLIPSIS}' THEN 'abbreviation' WHEN {_SMALL.format("before")} THEN 'initial'
  WHEN before IN (SELECT word FROM ab WHERE score >= {S.ABBREVIATION}) THEN 'abbreviation' WHEN before IS NOT NULL THEN 'word' END AS kind FROM g),
wo AS (SELECT word, sum(n) AS n_word, coalesce(sum(n) FILTER (form = 'lower'), 0) AS small, coalesce(sum(n) FILTER (form = 'upper'), 0) AS capital, coalesce(sum(n) FILTER (form = 'upper' AND NOT ended), 0) AS capital_inside, coalesce(sum(n) FILTER (form = 'lower' AND ended), 0) AS small_first FROM g GROUP BY 1),
af AS (SELECT word, sum(n) AS n_after FROM kn WHERE ended AND coalesce(kind, 'word') = 'word' GROUP BY 1), ne AS (SELECT sum(n_after) AS n_ends FROM af),
st AS (SELECT word FROM af JOIN wo USING (word), na, ne WHERE regexp_matches(word, '^\\p{{L}}') AND {_ratio("n_ends", "n_word", "n_after", "n_all")} >= {S.STARTER}),
me AS (SELECT before, word, form, kind FROM kn WHERE kind <> 'word' GROUP BY ALL), bo AS (SELECT before, word, sum(n) AS n_both FROM kn WHERE kind <> 'word' GROUP BY ALL HAVING sum(n) > 1),
sp AS (SELECT word AS before, sum(n) AS n_before FROM g WHERE dot GROUP BY 1),
co AS (SELECT before, word FROM bo JOIN sp USING (before) JOIN wo USING (word), na WHERE {_ratio("n_before", "n_word", "n_both", "n_all")} >= {S.COLLOCATION}),
stops AS (SELECT before, word, form FROM me JOIN wo USING (word) WHERE CASE WHEN (before, word) IN (SELECT (before, word) FROM co) THEN TRUE
  WHEN kind = 'abbreviation' THEN NOT (form = 'upper' AND (small > 0 AND capital_inside = 0 OR word IN (SELECT word FROM st)))
  ELSE form = 'lower' AND (capital > 0 OR small_first = 0) OR kind = 'initial' AND form = 'upper' AND small = 0 END)""".replace("\\\\", "\\")

ORACLES = {
    "abbreviations": f"WITH {PAIRS} SELECT word, CAST(k AS BIGINT) AS n_dot, CAST(m AS BIGINT) AS n_plain, round(score, 4) AS score FROM ab WHERE score >= {S.ABBREVIATION}",
    "inner_stops": f"WITH {STOPS} SELECT before, word, form FROM stops",
    "sentences_trained": f"""WITH {STOPS}, ps AS (SELECT doc_id, string_split(regexp_replace(trim(coalesce(text, ''), {_TRIM}), '([.!?]{_CLOSE}{{0,3}})({_SPACE})', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS p FROM d),
pt AS (SELECT doc_id, unnest(p) AS part, unnest(list_slice(p, 2, len(p)) || [NULL]) AS after, unnest(range(1, len(p) + 1)) AS i FROM ps),
tk AS (SELECT *, regexp_split_to_array(part, '{_SPACE}+')[-1] AS t1, regexp_extract(after, '^{_SPACE}*([^ \\t\\n\\r\\f\\x0B]+)', 1) AS t2 FROM pt),
ed AS (SELECT tk.*, after IS NULL OR stops.before IS NULL AS ends FROM tk LEFT JOIN an b ON t1 = b.t LEFT JOIN an a ON t2 = a.t LEFT JOIN stops ON b.dot AND b.word = stops.before AND a.word = stops.word AND a.form = stops.form),
gr AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ed),
wh AS (SELECT doc_id, k, string_agg(part, '' ORDER BY i) AS s FROM gr GROUP BY 1, 2),
ln AS (SELECT doc_id, list_filter(list_transform(flatten(list(string_split(s, chr(10)) ORDER BY k)), lambda x: trim(x, {_TRIM})), lambda x: length(x) >= 15) AS l FROM wh GROUP BY 1)
SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS idx, unnest(l) AS sentence FROM ln""",
}
