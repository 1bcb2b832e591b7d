"""The registered queries of the operators, each over its whole table, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import load

from . import check_sql, decontaminate, html_extract, language_id, mixing, ngram_join, prefix_trie, quality_classifier, quality_rules, secret_scan, source_audit, toxicity, url_filter, warc_archive
from .common import crc_remainder, stored


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    net = language_id.train(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), language_id.predict(F.col("text"), net).alias("p")).select("doc_id", "held_out", "p.*")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(load(spark, folder, "pages"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.train(docs, labels, ~held_out)
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(F.col("text"), model).alias("p"))
    return scored.select("doc_id", "held_out", "p.*", (F.col("p.score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(load(spark, folder, "documents"))
    return judged.drop("host").withColumn("shrunk_rate", F.round("shrunk_rate", 6))


def op5_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_documents(load(spark, folder, "documents")).drop("source")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = load(spark, folder, "documents"), load(spark, folder, "labels")
    held_out = F.coalesce(crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    measured = stored(docs.select("doc_id", quality_classifier.statistics(F.col("text")).alias("stats")), "statistics")
    model = quality_classifier.train(measured, labels, ~held_out)
    scored = measured.select("doc_id", held_out.alias("held_out"), quality_classifier.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    found = secret_scan.find(docs.select("doc_id", "text"), secret_scan.trained_on(docs))
    number = lambda kind: F.size(F.filter("base_spans", lambda s: s["order"] == secret_scan.KINDS.index(kind))).cast("long")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(F.encode(secret_scan.spans_text(F.col("base_spans")), "UTF-8"), 256).alias("base_sha256"),
        secret_scan.spans_text(F.array_sort(F.concat("base_spans", "markov_spans"))).alias("spans"),
    )


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(load(spark, folder, "documents")).drop("text_key")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc_archive.write_archive(load(spark, folder, "pages"))
    return warc_archive.read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(load(spark, folder, "documents"), load(spark, folder, "benchmark")).drop("_key")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefix_trie.trie(load(spark, folder, "conversations"))


def op12_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = load(spark, folder, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of each (lang, source) from the other sources of its language, and its most distinctive terms."""
    return source_audit.audit(load(spark, folder, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secret_scan": op7_secret_scan,
    "op8_ngram_join": op8_ngram_join,
    "op9_warc": op9_warc,
    "op10_decontaminate": op10_decontaminate,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_html_extract": op12_html_extract,
    "op13_source_audit": op13_source_audit,
}

ORACLE = {
    "op4_quality_rules": check_sql.QUALITY_RULES,
    "op5_mixing": check_sql.MIXING,
    "op8_ngram_join": check_sql.NGRAM_JOIN,
    "op9_warc": check_sql.WARC,
    "op11_prefix_trie": check_sql.PREFIX_TRIE,
    "op13_source_audit": check_sql.SOURCE_AUDIT,
}
