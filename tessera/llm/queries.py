"""The corpus operators applied to their whole tables: the queries opN_<name>."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, fingerprints, kd_shards, language_id, license_scan, mixing, simhash_dedup, token_counts, toxicity, url_filter, vantage_trees, whitening
from .common import table, written


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash_dedup.hex_of(F.col("bits")).alias("fingerprint"), "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.match_benchmark(documents, table(spark, sf_dir, "benchmark"), into="found")
    n_words, n_hit = F.col("found.n_words"), F.col("found.n_hit")
    return found.select(
        "doc_id", n_words.alias("n_words"), n_hit.alias("n_hit"), F.size("found.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.item_ids", ","), 256).alias("items_sha256"), decontaminate.contaminated(n_hit, n_words).alias("contaminated"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    documents = table(spark, sf_dir, "documents")
    counted = documents.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), token_counts.token_count(F.col("text"), path("byte_bpe_50k.json")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", size.alias("size"), crc.alias("text_crc32"))
    placed = kd_shards.kd_shards(documents, shards=8)  # the text isn't asked for, so it isn't shuffled
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned, names = mixing.plan_mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", *[F.col(names[c]).alias(c) for c in ("size", "source_size", "target", "taken")])


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id").drop("spans")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents").select("text", "lang"))
    return found.withColumnRenamed("id", "page_id").withColumn("probability", F.round("probability", 6))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = written(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text")), "edited-fingerprints")
    return fingerprints.with_near(made).select(
        F.col("id").alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprints.hex_of(F.col("bits")).alias("fingerprint"), fingerprints.hex_of(F.col("edited_bits")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), fingerprints.likeness(F.col("bits"), F.col("next_bits")).alias("near_next"), "n_near",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = toxicity.score_documents(documents, table(spark, sf_dir, "labels"))
    return documents.select("doc_id", (~toxicity.learns(F.col("doc_id"))).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op11_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vantage_trees.Index(vectors, k=10).search(vectors.where(F.col("vec_id") % 100 == 0), factor=1.0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    each = found.select(F.col("id").alias("vec_id"), "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), "identity_error")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_simhash_dedup, op2_url_filter, op3_decontaminate, op4_kd_shards, op5_token_counts, op6_mixing, op7_license_scan, op8_language_id, op9_fingerprints, op10_toxicity, op11_vantage_trees, op12_whitening, op13_collocations)
}

ORACLES: dict[str, str] = {"op3_decontaminate": decontaminate.ORACLE, "op6_mixing": mixing.ORACLE, "op11_vantage_trees": vantage_trees.ORACLE, "op13_collocations": collocations.ORACLE}
