"""From raw documents to packed training sequences: five stages, each over all that the stage before it kept.

Each stage takes (spark, docs, sf_dir), with docs in the columns of the documents table, and returns a DataFrame with
the same columns (the last one: its pieces). Its result is written as Parquet and read again as the next one's docs.
Nulls, empty texts, ties, repeated rows and empty tables are treated as the operators say. Extra columns of the documents
keep their values through all stages but the last, whatever their names. A null source is a source like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import best_fit_packing, jaccard_join, line_crf, poisson_mix, secret_spans
from loomgraph.llm.common import discard, stored, table, unused

#: A document goes if its lines, weighted by length, are good with less than this probability.
QUALITY = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the random field holds for good, fitted to the labelled ones among these documents."""
    model, score = line_crf.train(docs, table(spark, sf_dir, "labels")), unused("score", docs)
    return line_crf.score_documents(docs, model, score).filter(F.col(score) >= QUALITY).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a Jaccard similarity of 0.75 or more of their five-word shingles, the first."""
    return jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of a secret replaced by a mark."""
    return secret_spans.redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, in a global shuffle."""
    prefix = "mix"
    while any(c.lower().startswith(f"{prefix}_") for c in docs.columns):
        prefix = f"_{prefix}"
    return poisson_mix.poisson_mix(docs, prefix=prefix).drop(*(f"{prefix}_{c}" for c in ("copy", "count", "key")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 2048 tokens."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{k}")
        if k:
            discard(before)
    return docs


#: A random field, a tokenizer and a packing plan are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
