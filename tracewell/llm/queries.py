"""The queries of this subpackage: name to function of (session, folder), and SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives, audit, bpe, decontaminate, lexical, near_dups, packing, private_data, quality, token_files, url_rules, vectors, verbatim
from .common import table
from .oracles import ORACLE_SQL
from .tokens import default_path

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.classes(table(spark, sf_dir, "documents"), threshold=0.8)


#: Given host and path rules (fixed values).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by given rules, then by rules mined from the labels of pages of poor quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    labelled = pages.select(F.col("page_id").alias("doc_id"), "url").join(labels, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
    return url_rules.judge(pages, labelled, RULES)


def op5_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC bundles and read back."""
    index = archives.write(archives.classify(table(spark, sf_dir, "pages"), least=1000))
    return archives.read(index).drop("url", "payload")


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = private_data.spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, private_data.KINDS[:4]),
        F.sha2(private_data.listed("base").cast("binary"), 256).alias("base_sha256"), private_data.listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item whose passage it holds."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    manifest = token_files.write(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"), end_id=2)
    return token_files.read(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked within their label at cosine 0.98."""
    return vectors.link(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes that smaller ones hold in strings of 50."""
    return verbatim.remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), most=50)


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded to token ids and decoded again."""
    return bpe.digests(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, by source."""
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_url_rules": op4_url_rules,
    "op5_warc_bundles": op5_warc_bundles,
    "op6_private_data": op6_private_data,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_token_files": op8_token_files,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_ranked_lexical_search": op11_ranked_lexical_search,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_filter_interaction_audit": op13_filter_interaction_audit,
}
