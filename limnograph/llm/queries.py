"""The operators of this subpackage as queries over the whole test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnograph.llm import (
    decontaminate,
    embedding_forest,
    filter_audit,
    imatch,
    notices,
    pieces,
    secrets,
    simhash,
    toxicity,
    training_order,
    url_rules,
    vector_codes,
    warc_index,
)
from limnograph.llm.common import table
from limnograph.llm.sql import SQL


def op1_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """Pages have no time of capture; their ids count seconds from 2020."""
    pages = table(spark, folder, "pages").select(
        "page_id", "url", F.col("html").alias("payload"),
        F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod("page_id", F.lit(10**9))).alias("captured"))
    return warc_index.capture_history(pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured", "position")


def op2_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return training_order.training_order(table(spark, folder, "documents"))


def op3_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.compare_with_edits(table(spark, folder, "documents"))


def op4_simhash_trie(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op5_short_notices(spark: SparkSession, folder: str) -> DataFrame:
    found = notices.find_notices(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("notices", lambda m: m["exact"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    closeness = F.transform("notices", lambda m: 1.0 - m["errors"] / F.length(m["phrase"]))
    first = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"), names(base).alias("base_labels"), names("notices").alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).alias("score"),
        F.transform("notices", lambda m: F.struct(m["label"].alias("label"), m["start"].alias("start"),
                                                  m["stop"].alias("stop"), m["errors"].alias("errors"))).alias("spans"))


def op6_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents")).select(
        "doc_id", "nth", "start", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("candidate_sha256"),
        "probability", "is_secret")


def op7_toxicity_pu(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs.select("doc_id", "text"), model, keep=["doc_id"]).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


#: The rules of the query: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.decontaminate(docs, table(spark, folder, "benchmark"), keep=["doc_id"]).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs), keep=["doc_id", "text", "n_tokens", "ids"])
    return back.select(
        "doc_id", "n_tokens", "ids", F.length("decoded").cast("long").alias("n_decoded"),
        F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("same"))


def op11_embedding_forest(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_forest.near_embeddings(table(spark, folder, "embeddings"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_report(table(spark, folder, "embeddings"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    counts = filter_audit.failures(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(counts)


QUERIES = {f.__name__: f for f in (
    op1_warc_index, op2_training_order, op3_imatch, op4_simhash_trie, op5_short_notices, op6_secret_forest,
    op7_toxicity_pu, op8_url_rules, op9_decontaminate, op10_pieces, op11_embedding_forest,
    op12_vector_codes, op13_filter_audit)}
ORACLES = SQL
