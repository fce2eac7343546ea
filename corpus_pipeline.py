"""A cleaning pipeline over ``documents``: each stage applies one corpus operator to all rows its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import bpe, decontam, jaccard, pii, toxicity
from keelson.llm.common import scratch_table
from keelson.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def safe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score reaches their language's calibrated threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = docs.select(*COLUMNS)
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (n-gram Jaccard join): of each group the document with the smallest id stays."""
    return jaccard.keep_first(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that repeat benchmark windows go, by the operator's rule."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.remove_contaminated(docs.select(*COLUMNS), benchmark)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data: every span becomes its kind's placeholder; ``n_chars`` is counted anew."""
    from pyspark.sql import functions as F
    out = pii.mask_pii(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token count and digests of ids and decoded text per document."""
    return bpe.token_digests(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", safe),
    ("near_duplicates", unique),
    ("decontamination", decontaminated),
    ("pii", mask),
    ("bpe", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written once and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch_table(docs, f"pipeline-{name}")
    return docs
