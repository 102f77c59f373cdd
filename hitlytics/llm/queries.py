"""The registered queries of this subpackage; each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitlytics import session
from hitlytics.llm import (
    decontaminate, language, lm, negatives, perplexity, pieces, pii, prefixes, simhash, texts, topk, toxicity, urls, warc)


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(texts.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.hexadecimal("print").alias("fingerprint"), F.col("component").alias("component_id"))


def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.table(spark, sf_dir, "documents")
    held_out = texts.remainder(F.col("doc_id"), 4) == 2
    model = language.learn(docs.filter(~held_out))
    found = language.identify(docs, model, passed={"held_out": held_out})
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(texts.table(spark, sf_dir, "pages"), [*urls.BASE_RULES, *urls.SITE_RULES])
    return judged.withColumnRenamed("id", "page_id")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(texts.table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), *[pii.count_of(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(pii.BASE_KINDS).cast("binary"), 256).alias("base_sha256"), pii.joined(pii.KINDS).alias("spans"))


def warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = texts.table(spark, sf_dir, "pages")
    found = warc.captures(pages, session.shared_path(spark, "warc"), with_payload=False)
    fields = F.col("metadata.fields")
    revisit = F.col("type") == "revisit"
    return found.select(
        fields["page-id"].cast("long").alias("page_id"),
        F.when(revisit, fields["payload-bytes"].cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("computed")).alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to").cast("long").alias("refers_to"))


def attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.table(spark, sf_dir, "documents")
    return lm.score(docs, texts.remainder(F.col("doc_id"), 7) == 2).withColumnRenamed("id", "doc_id")


def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(texts.table(spark, sf_dir, "documents"))
    return encoded.select(F.col("id").alias("doc_id"), F.posexplode_outer("samples").alias("sample", "s")).select(
        "doc_id", "sample", F.size("s.ids").cast("long").alias("n_pieces"), F.col("s.ids").alias("ids"), "s.log_probability", "s.log_inclusion")


def perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = perplexity.filtered(texts.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, texts.table(spark, sf_dir, "labels"), texts.remainder(F.col("doc_id"), 5) != 0)
    found = toxicity.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (texts.remainder(F.col("id"), 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("sentences").cast("long").alias("n_sentences"))


def benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(texts.table(spark, sf_dir, "documents"), texts.table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"))


def inverted_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.self_mine(texts.table(spark, sf_dir, "embeddings"))


def prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(texts.table(spark, sf_dir, "conversations"))


def threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.self_search(texts.table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_language_mixture": language_mixture,
    "op3_url_rules": url_rules,
    "op4_personal_data": personal_data,
    "op5_warc_transactions": warc_transactions,
    "op6_attention_scores": attention_scores,
    "op7_sampled_pieces": sampled_pieces,
    "op8_perplexity_rules": perplexity_rules,
    "op9_toxic_documents": toxic_documents,
    "op10_benchmark_windows": benchmark_windows,
    "op11_inverted_negatives": inverted_negatives,
    "op12_prefix_trie": prefix_trie,
    "op13_threshold_top_k": threshold_top_k,
}
