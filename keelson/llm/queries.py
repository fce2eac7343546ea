"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, collocations, decontam, extraction, fingerprint, jaccard, oracles, pii, quality, repair, suffix_dedup, toxicity, training_order, urls
from keelson.llm.training import held_out

TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    """Place of a public tokenizer file on this machine (installed alike on every executor)."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest_text(fingerprint.neighbour_fingerprints(_table(spark, sf_dir, "documents")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = tokenizer_path()
    ids = bpe.packed_ids(_table(spark, sf_dir, "documents"), tokenizer)
    slots, _ = training_order.materialize(ids, key=ORDER_KEY, tokens_col="ids", vocab_size=bpe.vocab_size(tokenizer))
    return slots


ORDER_KEY = 20_240_501
URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), *quality.FOLD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("longest_match")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), *toxicity.FOLD).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_groups(_table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(repair.damage(_table(spark, sf_dir, "conversations")), live_col="live")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages)).select("page_id", "url", "text", "n_chars")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(*collocations.frequent_phrases(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_training_order": op3_training_order,
    "op4_urls": op4_urls,
    "op5_pii": op5_pii,
    "op6_quality": op6_quality,
    "op7_decontamination": op7_decontamination,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_jaccard": op10_jaccard,
    "op11_repair": op11_repair,
    "op12_html": op12_html,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {
    "op2_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op4_urls": urls.oracle_sql(URL_RULES),
    "op7_decontamination": oracles.DECONTAMINATION,
    "op10_jaccard": oracles.JACCARD,
    "op11_repair": oracles.REPAIR,
    "op12_html": oracles.MAIN_TEXT,
    "op13_collocations": oracles.COLLOCATIONS,
}
