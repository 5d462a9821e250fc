"""Corpus pipeline over ``documents``: toxic documents go, of near duplicates one stays, documents with
benchmark passages go, secrets are blotted out, and what is left is encoded as tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``. A stage holds for empty tables, null columns, repeated rows (near-dedup keeps one) and extra columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoverity.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from geoverity.llm.common import landed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), keep=others)
    return scored.where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (5-word shingles, similarity of 0.8 or more)."""
    return near_dedup.dedup(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by ``[secret]``; ``n_chars`` follows the text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = secrets.scan(docs, keep=others).withColumnRenamed("redacted", "text")
    changed = F.size("found") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ends): packed token ids and byte offsets of their ends; the text they decode to is
    the document's."""
    return bpe.encode(docs, bpe.default_vocabulary()).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("bpe", to_tokens),
]

#: The toxicity model, the field of the secret scan and BPE are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = landed(docs)
    return docs
