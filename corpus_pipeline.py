"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, then token ids.

Each stage reads what its predecessor kept. The first four return the columns of ``documents``, whatever others
there are beside them. Empty tables pass through; without labels no document is toxic, without a benchmark none
is contaminated. Texts are read whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bagminhash, bpe, decontaminate, secrets, toxicity
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.stage import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the threshold or above go; null and empty texts are scored like others."""
    model = toxicity.train(docs.filter(~toxicity.held_out(F.col("doc_id"))), table(spark, sf_dir, "labels"))
    score = "toxicity" + "_" * sum(len(c) for c in docs.columns)  # no column of documents has this name
    return model.score(docs, score).filter(F.col(score) < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: that of the least id, null first. Repeated rows are one document."""
    return bagminhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; null and empty texts hold none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark, and ``n_chars`` counted anew; every document stays, null texts as they are."""
    return secrets.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document; null texts have no ids."""
    return bpe.encoded(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES: list = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
