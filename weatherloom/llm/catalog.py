"""Registered queries of the text operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weatherloom.llm import (
    classes,
    clusters,
    decontamination,
    extraction,
    infilling,
    language,
    mixing,
    near_duplicates,
    oracle,
    personal,
    ranking,
    sharding,
    votes,
    warc,
)
from weatherloom.llm.shared import part_of, stored, table


def held_out(folds: int, part: int):
    """False for a null id."""
    return F.coalesce(part_of("doc_id", folds, "p") == part, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.train(docs, folds=3, held=1))
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "rejected")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_size(table(spark, sf_dir, "documents"))


def op4_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = votes.with_measures(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return votes.judge(stored(measured.drop("text"), "vote-measures")).select("doc_id", *votes.BASE, "base_failed", "kept", "posterior")


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(personal.find(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ranking.train(docs, table(spark, sf_dir, "labels"), cut=0.3, folds=5, held=0)
    return ranking.score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilling.transform(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infilling.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classes.train(docs.filter(part_of("doc_id", 5, "p") != 1))
    scored = classes.score(docs, model)
    return scored.select("doc_id", held_out(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


QUERIES = {
    "op1_language": op1_language,
    "op2_warc": op2_warc,
    "op3_sharding": op3_sharding,
    "op4_quality_votes": op4_quality_votes,
    "op5_extraction": op5_extraction,
    "op6_decontamination": op6_decontamination,
    "op7_personal_data": op7_personal_data,
    "op8_mixing": op8_mixing,
    "op9_quality_ranking": op9_quality_ranking,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_clusters": op11_clusters,
    "op12_infilling": op12_infilling,
    "op13_language_model": op13_language_model,
}
SQL: dict[str, str] = {
    "op2_warc": warc.SQL,
    "op3_sharding": oracle.SHARDING,
    "op6_decontamination": decontamination.SQL,
    "op8_mixing": oracle.MIXING,
    "op10_near_duplicates": oracle.NEAR_DUPLICATES,
    "op11_clusters": clusters.sql(),
    "op12_infilling": infilling.SQL,
}
