"""Document scores, information coefficients, strategy returns and their metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import text as T
from tidemark.operators import scans as S
from tidemark.sources.stages import staged

LABELS = ("positive", "negative", "neutral")
PERIODS_PER_YEAR = 8.0
COUNTS = ["n_sentences", "n_pos", "n_neg", "n_neu", "n_boilerplate"]
#: Tokens of a sentence that a model reads.
MAX_TOKENS = 512


def stand_in_logits(sentence: Column) -> tuple[Column, Column, Column]:
    """A scorer of no meaning in place of a sentence model, so that what follows can be run and checked."""
    return F.length(sentence) % 7 / 7.0, F.length(sentence) % 5 / 5.0, F.lit(0.5)


def scored_sentences(docs: DataFrame, logits=stand_in_logits) -> DataFrame:
    """``doc_id, idx, sentence, p_pos, p_neg, p_neu, label, n_tokens, is_boilerplate`` from ``doc_id, text``. ``logits``
    maps the sentence column to three columns; a model goes in as a pandas UDF over batches (``batched``)."""
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("idx", "sentence"))
    e = [F.exp(x) for x in logits(F.col("sentence"))]
    rows = rows.withColumns({n: x / (e[0] + e[1] + e[2]) for n, x in zip(("p_pos", "p_neg", "p_neu"), e, strict=True)})
    label = F.when((F.col("p_pos") >= F.col("p_neg")) & (F.col("p_pos") >= F.col("p_neu")), LABELS[0]).when(F.col("p_neg") >= F.col("p_neu"), LABELS[1]).otherwise(LABELS[2])
    return rows.withColumns({"label": label, "n_tokens": F.least(F.size(F.split("sentence", r"(?U)\s+")), F.lit(MAX_TOKENS)), "is_boilerplate": T.is_boilerplate(F.col("sentence"))})


def batched(model, batch: int = 64):
    """``logits`` for ``scored_sentences`` from ``model``: a function without arguments that loads, once in each
    Python worker, a function from a list of at most ``batch`` sentences to rows of three logits."""

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = model()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([[float(x) for x in row] for at in range(0, len(texts), batch) for row in score(texts[at : at + batch])], dtype=object)

    def logits(sentence: Column) -> tuple[Column, Column, Column]:
        found = run(sentence)
        return found[0], found[1], found[2]

    return logits


def document_scores(docs: DataFrame, sentences: DataFrame) -> DataFrame:
    """One row for each document; without sentences its counts are 0 and its scores null."""
    n = lambda c: F.count_if(c)
    found = sentences.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), *[n(F.col("label") == y).alias(c) for y, c in zip(LABELS, COUNTS[1:4], strict=True)], n(F.col("is_boilerplate")).alias("n_boilerplate"), F.max("n_tokens").alias("max_tokens"),
        F.avg(F.col("p_pos") - F.col("p_neg")).alias("s_prob"), F.avg(F.greatest("p_pos", "p_neg", "p_neu")).alias("mean_confidence"),
    )
    found = found.withColumn("s_count", (F.col("n_pos") - F.col("n_neg")) / F.col("n_sentences"))
    return docs.select("doc_id").join(found, "doc_id", "left").fillna(0, [*COUNTS, "max_tokens"])


def pearson(x: str, y: str) -> Column:
    """Null where either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(pairs: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Per key ``n``, the rank correlation ``ic`` with average ranks, its ``t``, and ``pearson``; null pairs go first.
    Writes the pairs and their ranks while the plan is built."""
    pairs = staged(pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(key).isNotNull()).select(key, x, y), "pairs")
    ranked = S.average_ranks(pairs, [key], [x, y])
    got = ranked.groupBy(key).agg(F.count("*").alias("n"), pearson(f"rank_{x}", f"rank_{y}").alias("ic"), pearson(x, y).alias("pearson"))
    return got.withColumn("t", F.col("ic") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("ic") * F.col("ic"))))


def tail_probability(t: np.ndarray, freedom: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t by Simpson's rule over the angle atan(t / sqrt(freedom)), in which the density is a
    power of the cosine and needs no special functions."""
    out = np.full(len(t), np.nan)
    for i, (x, v) in enumerate(zip(t, freedom, strict=True)):
        if v > 0 and not np.isnan(x):
            area = lambda end, v=v: (lambda g, w: float((np.cos(g) ** (v - 1) * w).sum() * end / 30000))(np.linspace(0, end, 10001), np.r_[1, np.tile([4, 2], 4999), 4, 1])
            out[i] = 1 - area(float(np.arctan(abs(x) / np.sqrt(v)))) / area(np.pi / 2)
    return np.clip(out, 0, 1)


@F.pandas_udf(DoubleType())
def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series(tail_probability(t.to_numpy(float), n.to_numpy(float) - 2)).replace({np.nan: None})


def power(ic: DataFrame, per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    """Adds the least IC that ``n`` rows can detect, the rows that ``ic`` needs for a power of 80 %, and the
    information ratio that it promises."""
    return ic.withColumns({"mde": 1.96 / F.sqrt("n"), "n_needed": F.try_divide(F.lit((1.96 + 0.84) ** 2), F.col("ic") * F.col("ic")), "ir": F.col("ic") * per_year**0.5})


def resampled(x: np.ndarray, y: np.ndarray, rounds: list[int], seed: int) -> np.ndarray:
    """The rank correlation of each round's sample. How often a pair is drawn gives the ranks of the sample: of the
    values in order, the draws before one's and half of its own. The order is the same for every round."""
    n = len(x)
    counts = np.empty((len(rounds), n), np.int64)
    for row, b in zip(counts, rounds, strict=True):
        head = f"{seed}:{b}:".encode()
        drawn = b"".join([hashlib.md5(head + b"%d" % i).digest()[:4] for i in range(n)])
        row[:] = np.bincount(np.frombuffer(drawn, ">u4").astype(np.int64) % n, minlength=n)

    def ranks(values: np.ndarray) -> np.ndarray:
        order = np.argsort(values, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(values[order]) != 0])
        own = np.add.reduceat(counts[:, order], starts, axis=1)
        middle = np.cumsum(own, axis=1) - own + (own + 1) / 2
        out = np.empty(counts.shape)
        out[:, order] = np.repeat(middle, np.diff(np.r_[starts, n]), axis=1)
        return out - (n + 1) / 2

    a, b = ranks(x), ranks(y)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (counts * a * b).sum(axis=1) / np.sqrt((counts * a * a).sum(axis=1) * (counts * b * b).sum(axis=1))


def bootstrap(pairs: DataFrame, x: str, y: str, order: str, rounds: int, level: float = 0.95, seed: int = 42, groups: int = 64) -> DataFrame:
    """``n, rounds, low, high``: the percentile interval of the rank correlation over samples of the pairs, drawn with
    replacement by a hash of seed, round and place. The pairs are one row per session, so the calendar bounds them; they
    are sent to ``groups`` tasks, which share the rounds. A sample of one value has no correlation and doesn't count."""
    pairs = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(order).alias("_order"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if len(pairs.take(3)) < 3:
        raise ValueError("three pairs are needed at least")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_order", kind="stable")
        own = list(range(key[0], rounds, groups))
        parts = [resampled(rows["x"].to_numpy(), rows["y"].to_numpy(), own[at : at + 32], seed) for at in range(0, len(own), 32)]
        ic = np.concatenate([np.zeros(0), *parts])
        return pd.DataFrame({"n": len(rows), "ic": pd.Series(ic, dtype=object).where(~np.isnan(ic), None)})

    sent = pairs.withColumn("_group", F.explode(F.sequence(F.lit(0), F.lit(min(groups, rounds) - 1))))
    # One range for each group: small groups would be put together in few tasks else.
    ics = sent.repartitionByRange(min(groups, rounds), "_group").groupBy("_group").applyInPandas(run, "n bigint, ic double")
    tail = (1 - level) / 2
    return ics.agg(F.max("n").cast("int").alias("n"), F.count("ic").alias("rounds"), F.percentile("ic", tail).alias("low"), F.percentile("ic", 1 - tail).alias("high"))


def hac_errors(rows: DataFrame, key: str, value: str, order: str, lags: Column) -> DataFrame:
    """Per key ``n, mean`` and the Newey-West standard error of the mean with ``lags`` Bartlett-weighted lags (a column
    of the key's rows). Each row meets those up to ``lags`` places after it by an equi-join on the place."""
    rows = S.numbered(rows.filter(F.col(value).isNotNull()).withColumn("_lags", lags).select(key, order, value, "_lags"), [key], [order], "_at")
    facts = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    off = rows.join(facts, key).select(key, "_at", "_lags", "n", "mean", (F.col(value) - F.col("mean")).alias("_e"))
    sent = off.select(key, F.col("_e").alias("_f"), F.posexplode(F.sequence(F.lit(0), "_lags")).alias("_l", "_x"), "_at").withColumn("_at", F.col("_at") + F.col("_l"))
    pairs = off.join(sent.select(key, "_at", "_f", "_l"), [key, "_at"])
    weight = F.when(F.col("_l") == 0, 1.0).otherwise(2 * (1 - F.col("_l") / (F.col("_lags") + 1)))
    return pairs.groupBy(key).agg(F.max("n").alias("n"), F.max("mean").alias("mean"), F.sqrt(F.sum(weight * F.col("_e") * F.col("_f")) / F.max("n") / F.max("n")).alias("se"))


def agreement(pairs: DataFrame, actual: str, said: str, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """The confusion matrix of both axes, a row for each pair of ``labels``, absent ones included: ``actual, said, n``,
    its shares of the row (``recall`` of the class on the diagonal) and of the column (``precision``), null where there
    is nothing to share, and over the whole matrix ``accuracy`` and Cohen's ``kappa``. Other labels don't count."""
    known = pairs.filter(F.col(actual).isin(*labels) & F.col(said).isin(*labels))
    cells = [F.count_if((F.col(actual) == a) & (F.col(said) == b)).alias(f"{i},{j}") for i, a in enumerate(labels) for j, b in enumerate(labels)]
    k, c = range(len(labels)), lambda i, j: F.col(f"{i},{j}")
    counted = known.agg(*cells)
    row, column = [sum(c(i, j) for j in k) for i in k], [sum(c(i, j) for i in k) for j in k]
    whole = sum(row)
    hit, chance = F.try_divide(sum(c(i, i) for i in k), whole), F.try_divide(sum(row[i] * column[i] for i in k), whole * whole)
    found = [F.struct(F.lit(a).alias("actual"), F.lit(b).alias("said"), c(i, j).alias("n"), F.try_divide(c(i, j), row[i]).alias("of_actual"), F.try_divide(c(i, j), column[j]).alias("of_said"), hit.alias("accuracy"), F.try_divide(hit - chance, 1 - chance).alias("kappa")) for i, a in enumerate(labels) for j, b in enumerate(labels)]
    return counted.select(F.explode(F.array(*found)).alias("cell")).select("cell.*")


def strategy_returns(df: DataFrame, fwd: str, bps: list[float]) -> DataFrame:
    """One row per row and cost: ``bps`` and ``ret``; rows without a forward return go."""
    rows = df.filter(F.col(fwd).isNotNull()).withColumn("bps", F.explode(F.array(*map(F.lit, bps))))
    return rows.withColumn("ret", F.col("position") * F.col(fwd) - F.col("bps") * 1e-4 * F.col("turnover"))


def performance(returns: DataFrame, key: str, order: str, per_year: float = PERIODS_PER_YEAR) -> DataFrame:
    """Per key: ``n, growth, vol, sharpe, max_drawdown, win_rate, avg_win, avg_loss, n_trades``. The equity curve starts
    at 1; a return of -1 or less is a total loss, after which equity stays at 0 (growth and drawdown are -1). Null
    returns don't count. Keys of any length are spread over tasks; ``order`` tells their rows apart."""
    curve = S.equity(returns, [key], [order], "ret")
    lost, safe = F.col("ret") <= -1, F.log1p(F.greatest("ret", F.lit(-1 + 1e-15)))
    sd, ret = F.stddev_samp("ret"), F.col("ret")
    growth = F.when(F.max(lost), -1.0).otherwise(F.exp(F.sum(safe) * per_year / F.count("*")) - 1)
    return curve.groupBy(key).agg(
        F.count("*").alias("n"), growth.alias("growth"), (sd * per_year**0.5).alias("vol"),
        (F.try_divide(F.avg("ret"), sd) * per_year**0.5).alias("sharpe"), F.min("fall").alias("max_drawdown"), (F.count_if(ret > 0) / F.count("*")).alias("win_rate"),
        F.avg(F.when(ret > 0, ret)).alias("avg_win"), F.avg(F.when(ret < 0, ret)).alias("avg_loss"), F.count_if(ret != 0).alias("n_trades"),
    )
