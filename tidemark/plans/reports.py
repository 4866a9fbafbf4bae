"""Reports on sentences, scores, pages and their files, each with its SQL oracle where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import evaluation as V
from tidemark.operators import scans as S
from tidemark.plans import panel, planted
from tidemark.plans.panel import DOC_STEPS, rounded
from tidemark.sources import html, ledger, stages
from tidemark.sources.stages import staged

K = 5


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return V.scored_sentences(planted.texts(spark, sf))


def staged_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences, split and scored once for what is read twice."""
    return staged(sentences(spark, sf), "sentences")


def all_scores(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    """The scores of all documents, whether the panel takes them or not."""
    return V.document_scores(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id"), sentences(spark, sf) if rows is None else rows)


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return planted.pages(spark, sf)


def net() -> F.Column:
    return F.round(F.col("p_pos") - F.col("p_neg"), 6)


def label_mix(spark: SparkSession, sf: str) -> DataFrame:
    counts = sentences(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all")))).select("label", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("pct"))


def score_correlation(spark: SparkSession, sf: str) -> DataFrame:
    """How far the two ways to sum a document's sentences up agree."""
    rows = all_scores(spark, sf).select(F.lit("all").alias("key"), *[F.round(c, 8).alias(c) for c in ("s_prob", "s_count")])
    return rounded(V.correlations(rows, "key", "s_prob", "s_count").select("n", F.col("ic").alias("spearman"), "pearson"), "spearman", "pearson")


def boilerplate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and mean net score of boilerplate and of other sentences."""
    return rounded(sentences(spark, sf).groupBy("is_boilerplate", "label").agg(F.count("*").alias("n"), F.avg(F.col("p_pos") - F.col("p_neg")).alias("mean_net")), "mean_net")


def without_boilerplate(spark: SparkSession, sf: str) -> DataFrame:
    """Document scores over the sentences that are no boilerplate."""
    kept = all_scores(spark, sf, sentences(spark, sf).filter(~F.col("is_boilerplate")))
    return rounded(kept.select("doc_id", "n_sentences", "s_prob"), "s_prob")


def sentence_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What must hold of any scorer: probabilities sum to one, scores lie in [-1, 1], truncated sentences are counted."""
    found = staged_sentences(spark, sf)
    rows = found.agg(F.round(F.max(F.abs(F.col("p_pos") + F.col("p_neg") + F.col("p_neu") - 1)), 9).alias("off_one"), F.max("n_tokens").alias("longest"), F.count_if(F.col("n_tokens") >= V.MAX_TOKENS).alias("n_truncated"))
    docs = all_scores(spark, sf, found).agg(F.count_if(F.abs("s_prob") > 1).alias("n_out_prob"), F.count_if(F.abs("s_count") > 1).alias("n_out_count"), F.count_if(F.col("n_sentences") == 0).alias("n_without_sentences"))
    return rows.join(docs)


def extreme_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The most positive and the most negative sentences without boilerplate; ties go by document and place."""
    rows = sentences(spark, sf).filter(~F.col("is_boilerplate")).select("doc_id", "idx", net().alias("net"))
    most = rows.orderBy(F.col("net").desc(), "doc_id", "idx").limit(K).withColumn("side", F.lit("positive"))
    return most.unionByName(rows.orderBy("net", "doc_id", "idx").limit(K).withColumn("side", F.lit("negative")))


def score_describe(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles of the document scores."""
    names = ["s_prob", "s_count"]
    long = all_scores(spark, sf).select(*[F.round(c, 8).alias(c) for c in names]).unpivot([], names, "score", "value")
    long = staged(long, "score-values")
    quarters = S.quantiles(long, ["score"], "value", [0.25, 0.5, 0.75]).select("score", "q")
    found = long.groupBy("score").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most")).join(quarters, "score", "left")
    found = found.select("score", "n", "mean", "sd", "least", *[F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("q1", "q2", "q3"))], "most")
    return rounded(found, "mean", "sd", "least", "q1", "q2", "q3", "most")


def sentence_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose number of sentences differs between the sentence and the score table (none)."""
    found = staged_sentences(spark, sf)
    counted = found.groupBy("doc_id").agg(F.count("*").alias("found"))
    both = all_scores(spark, sf, found).select("doc_id", "n_sentences").join(counted, "doc_id", "full_outer")
    return both.agg(F.count("*").alias("n_documents"), F.count_if(F.coalesce("n_sentences", F.lit(-1)) != F.coalesce("found", F.lit(0))).alias("n_different"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Hand labels against the label that most of a document's sentences have."""
    n = [F.col(c) for c in ("n_pos", "n_neg", "n_neu")]
    said = F.when(F.col("n_sentences") == 0, "none").when((n[0] >= n[1]) & (n[0] >= n[2]), "positive").when(n[1] >= n[2], "negative").otherwise("neutral")
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("actual"))
    both = marks.join(all_scores(spark, sf).select("doc_id", said.alias("said")), "doc_id")
    return both.groupBy("actual").pivot("said", ["positive", "negative", "neutral", "none"]).agg(F.count(F.lit(1))).fillna(0)


def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Both axes of three classes: the hand labels (good, toxic, neither) against the label of most sentences."""
    n = [F.col(c) for c in ("n_pos", "n_neg", "n_neu")]
    said = F.when(F.col("n_sentences") == 0, "none").when((n[0] >= n[1]) & (n[0] >= n[2]), "positive").when(n[1] >= n[2], "negative").otherwise("neutral")
    hand = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", hand.alias("actual"))
    found = V.agreement(marks.join(all_scores(spark, sf).select("doc_id", said.alias("said")), "doc_id"), "actual", "said")
    return rounded(found, "of_actual", "of_said", "accuracy", "kappa")


def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    text = T.clean_text(F.col("text"))
    return planted.texts(spark, sf).select("doc_id", text.alias("text")).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def page_addresses(spark: SparkSession, sf: str) -> DataFrame:
    day = F.date_add(F.lit("2000-01-03").cast("date"), (F.col("page_id") % 3000).cast("int"))
    return pages(spark, sf).select("page_id", T.url_host(F.col("url")).alias("host"), T.url_era(F.col("url")).alias("era"), T.url_date(F.col("url")).cast("string").alias("url_date"), T.raw_name(day, F.col("url")).alias("raw_path"))


def page_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return pages(spark, sf).select("page_id", "url", F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("n_bytes"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha256"))


def manifest_check(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest against the files: of the pages some were lost, some changed, and some were never fetched."""
    rows = page_manifest(spark, sf).withColumn("raw_path", F.concat(F.lit("p"), "page_id"))
    manifest = rows.select("url", "raw_path", F.when(F.col("page_id") % 11 == 0, 404).otherwise(200).alias("http_status"), "sha256")
    files = rows.filter("page_id % 7 != 0").select("raw_path", F.when(F.col("page_id") % 5 == 0, F.sha2(F.col("sha256"), 256)).otherwise(F.col("sha256")).alias("sha256"))
    return stages.verified(manifest, files)


def unfetched_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses that the manifest of the even pages lacks, each with its first page."""
    rows = page_manifest(spark, sf)
    return stages.first_of(stages.not_fetched(rows, rows.filter("page_id % 2 = 0")), "url", "page_id").select("page_id", "url")


def page_bodies(spark: SparkSession, sf: str) -> DataFrame:
    found = html.bodies(pages(spark, sf))
    return found.select("page_id", "selector_used", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    return html.links(pages(spark, sf)).select("page_id", "place", "url", "text", "heading")


def bodies_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents made into pages and read back: the text and the selector that found it."""
    found = html.bodies(planted.document_pages(spark, sf), "doc_id")
    return found.select("doc_id", "selector_used", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


def discovered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The statements and minutes that the index pages link to."""
    found = html.discovered(html.links(planted.index_pages(spark, sf)), False)
    return found.withColumn("doc_date", F.col("doc_date").cast("string"))


def ledger_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Index pages put into a ledger in two runs, the second over all of them, and what is discovered in its files."""
    root = stages.fresh_dir(spark, "ledger")
    rows = planted.index_pages(spark, sf).select("url", F.lit(None).cast("date").alias("doc_date"), F.lit(200).alias("http_status"), F.lit("2020-01-01").cast("timestamp").alias("fetched_at_utc"), F.col("html").cast("binary").alias("content"), "page_id")
    ledger.stored(rows.filter("page_id % 3 = 0"), root)
    ledger.stored(rows, root)
    pages_ = ledger.files(spark, root).select(F.col("url").alias("page"), "url", F.col("content").cast("string").alias("html"))
    found = html.discovered(html.links(pages_, "page"), False)
    return stages.first_of(found, "url", "anchor_text", "meeting_heading").withColumn("doc_date", F.col("doc_date").cast("string"))


QUERIES = {f.__name__: f for f in (label_mix, score_correlation, boilerplate_report, without_boilerplate, sentence_invariants, extreme_sentences, score_describe, sentence_reconciliation, confusion_matrix, clean_documents, page_addresses, page_manifest, manifest_check, unfetched_pages, page_bodies, page_links, bodies_of_documents, discovered_documents, ledger_discovery, label_agreement)}

_STARTS = "|".join(T.CHROME_STARTS).replace(".", r"\.")
_LINES = ", ".join(f"'{x}'" for x in T.CHROME_LINES)
_RANKS = "k AS (SELECT *, rank() OVER (ORDER BY s_prob) + (count(*) OVER (PARTITION BY s_prob) - 1) / 2 AS ra, rank() OVER (ORDER BY s_count) + (count(*) OVER (PARTITION BY s_count) - 1) / 2 AS rb FROM (SELECT round(s_prob, 8) AS s_prob, round(s_count, 8) AS s_count FROM ds))"
_ALL = "a AS (SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, s_prob, s_count FROM documents LEFT JOIN ds USING (doc_id))"

SCORED = f"{planted.TEXTS}, {panel.SCORED}"
CLEAN = f"""{planted.TEXTS}, l AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(regexp_replace(x, '[\\s\\x0b\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) AS l FROM pd),
c AS (SELECT doc_id, array_to_string(list_filter(l, lambda x: trim(x, ' |') <> '' AND NOT regexp_matches(x, '^(?:{_STARTS})') AND lower(trim(x, ' |')) NOT IN ({_LINES}) AND NOT regexp_matches(trim(x, ' |'), '(?i)^\\d{{4}}\\s+monetary policy$')), E'\\n') AS t FROM l)"""

_DISCOVERED = """WITH i AS (SELECT page_id, DATE '1994-02-01' + CAST(page_id * 3 % 4000 AS INTEGER) AS a, DATE '1994-02-01' + CAST(page_id * 3 % 4000 + 30 AS INTEGER) AS b, CASE page_id % 3 WHEN 0 THEN 'Conference call' WHEN 1 THEN 'Second meeting' ELSE 'Later' END AS h FROM pages)
SELECT 'statement' AS doc_type, CAST(a AS VARCHAR) AS doc_date, 'http://www.example.org/fomc/' || strftime(a, '%Y%m%d') || 'default.htm' AS url, 'Statement' AS anchor_text, 'Meeting no. ' || page_id || ' of the year' AS meeting_heading, TRUE AS is_scheduled FROM i
UNION ALL SELECT k, CAST(b AS VARCHAR), 'http://www.example.org/' || CASE k WHEN 'minutes' THEN 'monetarypolicy/fomcminutes' || strftime(b, '%Y%m%d') ELSE 'newsevents/press/monetary/' || strftime(b, '%Y%m%d') || 'a' END || '.htm', CASE k WHEN 'minutes' THEN 'Minutes & more' ELSE 'Statement' END, h,
  CASE page_id % 3 WHEN 0 THEN FALSE WHEN 1 THEN TRUE END FROM i, (SELECT unnest(['statement', 'minutes']) AS k)"""

ORACLES = {
    "label_mix": f"WITH {SCORED} SELECT label, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM sc), 4) AS pct FROM sc GROUP BY 1",
    "score_correlation": f"WITH {SCORED}, {_RANKS} SELECT count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(corr(s_prob, s_count), 6) AS pearson FROM k",
    "boilerplate_report": f"WITH {SCORED} SELECT is_boilerplate, label, count(*) AS n, round(avg(p_pos - p_neg), 6) AS mean_net FROM sc GROUP BY 1, 2",
    "without_boilerplate": f"WITH {SCORED}, b AS (SELECT doc_id, count(*) AS n, avg(p_pos - p_neg) AS s FROM sc WHERE NOT is_boilerplate GROUP BY 1) SELECT doc_id, coalesce(n, 0) AS n_sentences, round(s, 6) AS s_prob FROM documents LEFT JOIN b USING (doc_id)",
    "sentence_invariants": f"WITH {SCORED}, {_ALL} SELECT (SELECT round(max(abs(p_pos + p_neg + p_neu - 1)), 9) FROM sc) AS off_one, (SELECT CAST(max(n_tokens) AS INTEGER) FROM sc) AS longest, (SELECT count(*) FILTER (n_tokens >= 512) FROM sc) AS n_truncated, count(*) FILTER (abs(s_prob) > 1) AS n_out_prob, count(*) FILTER (abs(s_count) > 1) AS n_out_count, count(*) FILTER (n_sentences = 0) AS n_without_sentences FROM a",
    "extreme_sentences": f"WITH {SCORED}, r AS (SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(p_pos - p_neg, 6) AS net FROM sc WHERE NOT is_boilerplate) (SELECT *, 'positive' AS side FROM r ORDER BY net DESC, doc_id, idx LIMIT {K}) UNION ALL (SELECT *, 'negative' AS side FROM r ORDER BY net, doc_id, idx LIMIT {K})",
    "score_describe": f"WITH {SCORED} " + " UNION ALL ".join(f"SELECT '{c}' AS score, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(min(v), 6) AS least, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS q2, round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS most FROM (SELECT round({c}, 8) AS v FROM ds)" for c in ("s_prob", "s_count")),
    "sentence_reconciliation": f"""WITH {SCORED}, {_ALL}, f AS (SELECT doc_id, count(*) AS found FROM e GROUP BY 1)
SELECT count(*) AS n_documents, count(*) FILTER (coalesce(n_sentences, -1) <> coalesce(found, 0)) AS n_different FROM a FULL JOIN f USING (doc_id)""",
    "confusion_matrix": f"""WITH {SCORED}, n AS (SELECT doc_id, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'negative') AS n, count(*) FILTER (label = 'neutral') AS u FROM sc GROUP BY 1),
l AS (SELECT quality AS actual, CASE WHEN p IS NULL THEN 'none' WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS said FROM labels JOIN documents USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT actual, {", ".join(f"count(*) FILTER (said = '{c}') AS {c}" for c in ("positive", "negative", "neutral", "none"))} FROM l GROUP BY 1""",
    "label_agreement": f"""WITH {SCORED}, n AS (SELECT doc_id, count(*) FILTER (label = 'positive') AS p, count(*) FILTER (label = 'negative') AS n, count(*) FILTER (label = 'neutral') AS u FROM sc GROUP BY 1),
l AS (SELECT CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS actual, CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS said FROM labels JOIN documents USING (doc_id) JOIN n USING (doc_id)),
k AS (SELECT unnest(['positive', 'negative', 'neutral']) AS c), m AS (SELECT a.c AS actual, b.c AS said, (SELECT count(*) FROM l WHERE l.actual = a.c AND l.said = b.c) AS n FROM k a, k b),
w AS (SELECT sum(n) AS t, sum(n) FILTER (actual = said) AS h FROM m), ch AS (SELECT sum(x * y) AS e FROM (SELECT actual AS c, sum(n) AS x FROM m GROUP BY 1) JOIN (SELECT said AS c, sum(n) AS y FROM m GROUP BY 1) USING (c))
SELECT actual, said, n, round(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 6) AS of_actual, round(n / nullif(sum(n) OVER (PARTITION BY said), 0), 6) AS of_said, round(h / t, 6) AS accuracy, round((h / t - e / (t * t)) / nullif(1 - e / (t * t), 0), 6) AS kappa FROM m, w, ch""",
    "clean_documents": f"WITH {CLEAN} SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM c",
    "bodies_of_documents": f"""WITH {CLEAN}, p AS (SELECT doc_id, doc_id % 5 AS k, t, length(t) >= 400 AS long FROM c),
r AS (SELECT doc_id, CASE WHEN k = 0 AND long THEN 'div#article' WHEN k = 1 AND long THEN 'td.text' WHEN k = 2 AND long THEN 'div.col-xs-12.col-sm-8.col-md-8' WHEN k = 3 AND long THEN 'div#leftText' ELSE 'whole_page_fallback' END AS selector_used,
  CASE WHEN k = 0 AND NOT long THEN trim('Old' || chr(10) || t, chr(10)) WHEN k = 3 AND NOT long THEN trim('Short.' || chr(10) || t, chr(10)) ELSE t END AS t FROM p)
SELECT doc_id, selector_used, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS sha256 FROM r""",
    "discovered_documents": _DISCOVERED,
    "ledger_discovery": f"SELECT * FROM ({_DISCOVERED}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY anchor_text, meeting_heading) = 1",
    "documents_table": f"""WITH {CLEAN}, {DOC_STEPS.replace("FROM pd)", "FROM (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN t END AS text FROM c))")}
SELECT doc_id, doc_type, CASE WHEN text IS NULL THEN 'MISSING_FILE' ELSE 'file' END AS selector_used, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, is_error_page, is_flagged, release_minutes, release_time_source FROM d WHERE doc_id % 17 <> 0""",
    "page_addresses": f"WITH {planted.PAGES} " + r"""SELECT page_id, regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host, CASE WHEN contains(url, '/fomc/') THEN 'fomc' WHEN contains(url, '/boarddocs/') THEN 'boarddocs' WHEN contains(url, '/press/monetary/') THEN 'press' ELSE 'pressreleases' END AS era,
  CAST(CAST(try_strptime(coalesce(nullif(regexp_extract(url, '/fomc/(\d{8})default\.htm', 1), ''), nullif(regexp_extract(url, '/boarddocs/press/[a-z]+/\d{4}/(\d{8})/?(?:default\.htm)?$', 1), ''), nullif(regexp_extract(url, '/newsevents/press/monetary/(\d{8})[a-z]\d*\.htm', 1), ''),
    nullif(regexp_extract(url, '/newsevents/pressreleases/monetary(\d{8})[a-z]\d*\.htm', 1), ''), nullif(regexp_extract(url, '/monetarypolicy/fomcminutes(\d{8})\.htm', 1), '')), '%Y%m%d') AS DATE) AS VARCHAR) AS url_date,
  strftime(DATE '2000-01-03' + CAST(page_id % 3000 AS INTEGER), '%Y%m%d') || '_' || substr(sha256(url), 1, 6) || '.htm' AS raw_path FROM pp""",
    "page_manifest": f"WITH {planted.PAGES} SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n_bytes, sha256(coalesce(html, '')) AS sha256 FROM pp",
    "manifest_check": "SELECT 'p' || page_id AS raw_path, CASE WHEN page_id % 7 = 0 THEN 'file_missing' ELSE 'sha256_mismatch' END AS issue FROM pages WHERE page_id % 11 <> 0 AND (page_id % 7 = 0 OR page_id % 5 = 0)",
    "unfetched_pages": f"WITH {planted.PAGES} SELECT min(page_id) AS page_id, url FROM pp WHERE url NOT IN (SELECT url FROM pp WHERE page_id % 2 = 0) GROUP BY url",
}
