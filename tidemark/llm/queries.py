"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, bpe, decontaminate, hamming, negatives, periods, ppm, repeats, secrets, toxicity, urltrees, warc, wrappers
from tidemark.llm.stage import table

#: Where the public tokenizer files lie; pass another path to the operator for another vocabulary.
TOKENIZER = "byte_bpe_50k.json"
#: The rules of op11, by host and start of the path.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


OP1_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
o AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p LEFT JOIN o ON p.d = o.d AND n >= 1000"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP3_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d), k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM p),
r AS (SELECT k FROM k GROUP BY 1 HAVING count(*) > 1), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM k JOIN r USING (k)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
t AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept FROM x ANTI JOIN c USING (doc_id, j) GROUP BY 1), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""
OP4_SQL = """WITH q AS (SELECT vec_id, embedding AS a FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id, e.vec_id AS neighbour_id,
  CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (a[i] > 0) <> (e.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM q JOIN embeddings e ON q.vec_id <> e.vec_id)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS INTEGER) AS place, neighbour_id, distance FROM p QUALIFY place <= 10"""
_ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents), b AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark),
g AS (SELECT item_id, least(len(w), 10) AS n, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' ')) ELSE [array_to_string(w, ' ')] END) AS gram FROM b WHERE len(w) > 0),
l AS (SELECT DISTINCT n FROM g), p AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l), k AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p),
h AS (SELECT DISTINCT doc_id, i, n, item_id FROM k JOIN g USING (n, gram)), c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, c.n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""
OP8_SQL = f"""WITH RECURSIVE d AS (SELECT coalesce(text, '') AS t, min(doc_id) AS id, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT id, {_WORDS.replace("text", "t")} AS w FROM d),
g AS (SELECT id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS s FROM w WHERE len(w) > 0),
c AS (SELECT id, s, count(*) AS n FROM g GROUP BY 1, 2), z AS (SELECT id, sum(n) AS z FROM c GROUP BY 1),
o AS (SELECT a.id AS x, b.id AS y, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON a.s = b.s AND a.id <> b.id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN z a ON a.id = x JOIN z b ON b.id = y WHERE o >= 0.8 * (a.z + b.z - o)),
r AS (SELECT id AS x, id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x AS id, min(y) AS class_id FROM r GROUP BY 1), f AS (SELECT doc_id, class_id FROM documents JOIN d ON coalesce(text, '') = t JOIN m USING (id))
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_members FROM f"""

_FITS = lambda r: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*r.split("/", 1))
_LONGEST = sorted(RULES, key=len, reverse=True)
_NODES = """SELECT host, {0}, n, a, b, d, list_slice(g, 1, d - 1) AS parent, list_slice(g, 1, d) AS key, g[d] AS segment FROM (SELECT *, unnest(range(1, len(g) + 1)) AS d FROM (SELECT *, string_split({0}, '/') AS g FROM {1}))"""
OP11_SQL = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_FITS(r)} THEN '{r}'" for r in _LONGEST)} END AS rule, CASE {" ".join(f"WHEN {_FITS(r)} THEN '{RULES[r]}'" for r in _LONGEST)} END AS ruling,
  array_to_string(list_transform(string_split(path, '/'), lambda s: CASE {" ".join(f"WHEN regexp_matches(s, '{p}') THEN '{c}' || regexp_extract(s, '{urltrees.EXTENSION}', 1)" for p, c in urltrees.FORMS)} ELSE s END), '/') AS shape FROM u),
sh AS (SELECT host, shape, count(*) AS n, count(*) FILTER (ruling = 'allow') AS a, count(*) FILTER (ruling = 'block') AS b FROM r GROUP BY 1, 2),
e AS ({_NODES.format("shape", "sh")}), ch AS (SELECT host, parent, segment, sum(n) AS n FROM e GROUP BY ALL), tot AS (SELECT host, parent, sum(n) AS t FROM ch GROUP BY ALL),
lit AS (SELECT host, parent, segment FROM ch JOIN tot USING (host, parent) WHERE segment = '' OR n >= {urltrees.LEAST} AND n >= {urltrees.SHARE} * t),
ge AS (SELECT e.host, e.shape, string_agg(CASE WHEN lit.host IS NULL THEN '*' ELSE e.segment END, '/' ORDER BY d) AS general FROM e LEFT JOIN lit USING (host, parent, segment) GROUP BY 1, 2),
gs AS (SELECT host, general, sum(n) AS n, sum(a) AS a, sum(b) AS b FROM sh JOIN ge USING (host, shape) GROUP BY ALL), e2 AS ({_NODES.format("general", "gs")}),
br AS (SELECT host, parent, key, segment, sum(a) AS a, sum(b) AS b FROM e2 GROUP BY ALL), un AS (SELECT host, parent AS key, string_agg(segment, '/' ORDER BY segment) AS under FROM br GROUP BY ALL),
bu AS (SELECT br.*, coalesce(under, '-') AS under, a + b AS known, CASE WHEN a + b > 0 THEN b / (a + b) END AS rate FROM br LEFT JOIN un USING (host, key)),
op AS (SELECT *, CASE WHEN rate IS NULL AND row_number() OVER w > 1 OR coalesce(rate - lag(rate) OVER w <= {urltrees.BOUND!r} * (1 / sqrt(known) + 1 / sqrt(nullif(lag(known) OVER w, 0))), FALSE) THEN 0 ELSE 1 END AS opens FROM bu WINDOW w AS (PARTITION BY host, parent, under ORDER BY rate NULLS FIRST, segment)),
gr AS (SELECT *, sum(opens) OVER (PARTITION BY host, parent, under ORDER BY rate NULLS FIRST, segment) AS g FROM op),
me AS (SELECT host, parent, segment, array_to_string(list_sort(list(segment) OVER (PARTITION BY host, parent, under, g)), '|') AS merged FROM gr),
te AS (SELECT host, general, string_agg(merged, '/' ORDER BY d) AS template FROM e2 JOIN me USING (host, parent, segment) GROUP BY 1, 2),
fo AS (SELECT sh.*, template FROM sh JOIN ge USING (host, shape) JOIN te USING (host, general)), wh AS (SELECT (sum(b) + 1) / (sum(a + b) + 2) AS g FROM sh),
ho AS (SELECT host, (sum(b) + {urltrees.WEIGHT} * any_value(g)) / (sum(a + b) + {urltrees.WEIGHT}) AS h FROM sh, wh GROUP BY 1),
pu AS (SELECT host, template, (sum(b) + {urltrees.WEIGHT} * any_value(h)) / (sum(a + b) + {urltrees.WEIGHT}) AS purity FROM fo JOIN ho USING (host) GROUP BY 1, 2)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN purity >= {urltrees.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity FROM r JOIN fo USING (host, shape) JOIN pu USING (host, template)"""
OP13_SQL = """WITH r AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS y, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
s AS (SELECT a.id AS anchor_id, b.id, a.y = b.y AS same, CAST(list_sum(list_transform(range(1, 65), lambda i: a.x[i] * b.x[i])) AS BIGINT) AS score FROM r a JOIN r b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder).drop("url")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.cut(table(spark, sf_dir, "documents"), with_text=False)


def op4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the rows whose id is divisible by 20; each is searched for among all rows."""
    codes = hamming.codes(table(spark, sf_dir, "embeddings"))
    found = hamming.nearest(codes, codes.filter(F.col("id") % 20 == 0))
    each = found.select(F.col("id").alias("vec_id"), F.posexplode("neighbours").alias("place", "n"))
    return each.select("vec_id", (F.col("place") + 1).alias("place"), F.col("n.id").alias("neighbour_id"), F.col("n.distance").alias("distance"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scored(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


def op9_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extracted(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urltrees.judged(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return found.withColumn("purity", F.round("purity", 6))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchors are the rows whose id is divisible by 100; of every seventh id the label is made wrong by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.quantised(table(spark, sf_dir, "embeddings"), label)
    return negatives.mined(rows, rows.filter(F.col("id") % 100 == 0))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.found(periods.looped(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_warc": op1_warc, "op2_secrets": op2_secrets, "op3_repeats": op3_repeats, "op4_hamming": op4_hamming, "op5_decontamination": op5_decontamination, "op6_ppm": op6_ppm, "op7_bpe": op7_bpe, "op8_bagminhash": op8_bagminhash, "op9_wrappers": op9_wrappers, "op10_toxicity": op10_toxicity, "op11_urls": op11_urls, "op12_periods": op12_periods, "op13_negatives": op13_negatives}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_repeats": OP3_SQL, "op4_hamming": OP4_SQL, "op5_decontamination": OP5_SQL, "op8_bagminhash": OP8_SQL, "op11_urls": OP11_SQL, "op13_negatives": OP13_SQL}
