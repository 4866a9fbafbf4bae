"""URL filters by a tree of path templates for each host.

Rules decide the urls that they fit, the longest first, and what they say labels the tree. A path's segments are first
told by their form: numbers, hexadecimal names, words with digits and slugs become classes (an extension stays). Equal
paths of a host are then one row with its counts. A segment stays literal under its parent where it has ``LEAST`` of its
rows and the share ``SHARE`` of them, which bounds a node's children; all others become ``*``. Branches of one parent
whose children are the same are merged where their labels are statistically alike: ordered by the share that is
blocked, neighbours within the Hoeffding bound at ``ALPHA`` of each other fall together; branches without any label
fall together too. A template's purity is the blocked share of its labels, drawn to its host's, and that to the share
of all, by ``WEIGHT`` labels each. Templates of purity ``REJECT`` or more are rejected: their urls, where no rule fits,
are blocked. Hosts and branches without labels thus have the purity of what is above them.

Every step is a grouping or a join of counts, so a host of any share of the urls is spread over tasks; windows span the
children of one node.

Defined cases: a null url, or one without ``://``, has an empty host and path; ids may repeat or be null, each row
gives its row; an empty table gives no rows; other columns are not read; segments may be empty, and any number of
them is a path (a node is known by a digest of its path, worked out along it)."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tidemark.llm.stage import staged

#: Rows and share of its parent's rows that a segment needs to stay literal.
LEAST, SHARE = 5, 0.01
ALPHA, WEIGHT, REJECT = 0.05, 5.0, 0.8
BOUND = math.sqrt(math.log(2 / ALPHA) / 2)
#: Forms of a segment, the first that fits, each with its class.
FORMS = ((r"^[0-9]+(\.[A-Za-z]{1,5})?$", "{n}"), (r"^[0-9A-Fa-f-]{16,}(\.[A-Za-z]{1,5})?$", "{x}"), ("[0-9]", "{w}"), ("-.*-.*-", "{s}"))
EXTENSION = r"(\.[A-Za-z]{1,5})$"


def parsed(pages: DataFrame, row: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.select(F.col(row).alias("page_id"), host.alias("host"), F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))


def ruled(urls: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Adds ``rule`` and ``ruling``: the longest rule that fits, and what it says. ``rules`` is a list that fits a plan."""
    rule, ruling = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name in sorted(rules, key=lambda r: (-len(r), r)):
        host, slash, path = name.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, ruling = rule.when(fits, name), ruling.when(fits, rules[name])
    return urls.withColumns({"rule": rule, "ruling": ruling})


def form(segment: Column) -> Column:
    kind = F.when(F.lit(False), "")
    for pattern, name in FORMS:
        kind = kind.when(segment.rlike(pattern), F.concat(F.lit(name), F.regexp_extract(segment, EXTENSION, 1)))
    return kind.otherwise(segment)


@F.pandas_udf(ArrayType(StringType()))
def chain(paths: pd.Series) -> pd.Series:
    """The key of the root, then that of each segment: a digest of the path so far."""

    def keys(path: list[str]) -> list[str]:
        so_far, out = hashlib.blake2b(digest_size=16), []
        for segment in path:
            out.append(so_far.hexdigest())
            so_far.update(b"/" + segment.encode())
        return [*out, so_far.hexdigest()]

    return paths.map(keys)


def nodes(paths: DataFrame, name: str, *counts: str) -> DataFrame:
    """``host, name, depth, parent, key, segment`` of each segment of the path in ``name``, with its ``counts``."""
    split = paths.withColumn("_segments", F.split(name, "/")).withColumn("_keys", chain("_segments"))
    each = split.select("host", name, *counts, F.posexplode("_segments").alias("depth", "segment"), "_keys")
    return each.select("host", name, *counts, "depth", "segment", F.get("_keys", F.col("depth")).alias("parent"), F.get("_keys", F.col("depth") + 1).alias("key"))


def rejoined(each: DataFrame, name: str, segment: Column, out: str) -> DataFrame:
    """``host, name`` and the path of the given segments."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("depth", segment.alias("s")))), lambda x: x["s"])
    return each.groupBy("host", name).agg(F.array_join(ordered, "/").alias(out))


def sums(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "allowed", "blocked")])


def templates(urls: DataFrame) -> DataFrame:
    """``host, shape, template, purity`` from ``host, path, ruling`` (``allow``, ``block`` or null). ``shape`` is the
    path by its segments' forms (``shaped``)."""
    shapes = staged(urls.groupBy("host", shaped("path").alias("shape")).agg(F.count("*").alias("n"), F.count_if(F.col("ruling") == "allow").alias("allowed"), F.count_if(F.col("ruling") == "block").alias("blocked")), "url-shapes")
    each = nodes(shapes, "shape", "n")
    children = each.groupBy("host", "parent", "segment").agg(F.sum("n").alias("rows"))
    totals = children.groupBy("host", "parent").agg(F.sum("rows").alias("all"))
    literal = children.join(totals, ["host", "parent"]).filter((F.col("segment") == "") | ((F.col("rows") >= LEAST) & (F.col("rows") >= SHARE * F.col("all"))))
    told = each.join(literal.select("host", "parent", "segment", F.lit(True).alias("literal")), ["host", "parent", "segment"], "left")
    general = shapes.join(rejoined(told, "shape", F.when(F.col("literal"), F.col("segment")).otherwise("*"), "general"), ["host", "shape"])
    general = staged(general, "url-general")
    each = nodes(sums(general, "host", "general"), "general", "n", "allowed", "blocked")
    branches = sums(each, "host", "parent", "key", "segment")
    under = branches.groupBy("host", F.col("parent").alias("key")).agg(F.array_join(F.array_sort(F.collect_set("segment")), "/").alias("under"))
    branches = branches.join(under, ["host", "key"], "left").withColumns({"under": F.coalesce("under", F.lit("-")), "known": F.col("allowed") + F.col("blocked")})
    branches = branches.withColumn("rate", F.try_divide("blocked", "known"))
    order = Window.partitionBy("host", "parent", "under").orderBy(F.col("rate").asc_nulls_first(), "segment")
    rate, known = F.lag("rate").over(order), F.lag("known").over(order)
    alike = (F.col("rate").isNull() & (F.row_number().over(order) > 1)) | F.coalesce(F.col("rate") - rate <= BOUND * (1 / F.sqrt(F.col("known")) + 1 / F.sqrt(known)), F.lit(False))
    branches = branches.withColumn("opens", F.when(alike, 0).otherwise(1)).withColumn("group", F.sum("opens").over(order))
    together = Window.partitionBy("host", "parent", "under", "group")
    merged = branches.select("host", "parent", "segment", F.array_join(F.array_sort(F.collect_list("segment").over(together)), "|").alias("merged"))
    found = general.join(rejoined(each.join(merged, ["host", "parent", "segment"]), "general", F.col("merged"), "template"), ["host", "general"])
    share = lambda prior: (F.col("blocked") + WEIGHT * prior) / (F.col("allowed") + F.col("blocked") + WEIGHT)
    whole = shapes.agg(((F.coalesce(F.sum("blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum(F.col("allowed") + F.col("blocked")), F.lit(0)) + 2)).alias("of_all"))
    hosts = sums(shapes, "host").join(F.broadcast(whole)).select("host", share(F.col("of_all")).alias("of_host"))  # one row
    purity = sums(found, "host", "template").join(hosts, "host").select("host", "template", share(F.col("of_host")).alias("purity"))
    return found.select("host", "shape", "template").join(purity, ["host", "template"])


def shaped(path: str) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), form), "/")


def judged(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of each row of ``page_id, url``."""
    urls = ruled(parsed(pages), rules)
    tree = templates(urls)
    both = urls.withColumn("shape", shaped("path")).join(tree, ["host", "shape"])
    verdict = F.coalesce("ruling", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
