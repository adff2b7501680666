"""The queries of this subpackage over the tables in ``sf_dir``, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weft.llm import licenses, matroska, packing, pieces, quality, secrets, simhash, suffix, toxicity, urls
from weft.llm._shared import read


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.duplicated(read(spark, sf_dir, "documents")).drop("th")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.flag(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op4_matroska_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.packet_table(matroska.containers(read(spark, sf_dir, "documents")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ledger(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_pages(read(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(read(spark, sf_dir, "documents")))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op10_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), every=packing.EVERY)


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_secret_scan, op4_matroska_packets, op5_quality_rules, quality_ablation, op6_url_filter, op7_license_scan, op8_sentencepiece, op9_simhash_near_dedup, op10_lexical_packing)}

ORACLES = {"op1_suffix_dedup": suffix.SPANS_SQL, "op4_matroska_packets": matroska.PACKETS_SQL, "op5_quality_rules": quality.LEDGER_SQL, "quality_ablation": quality.ABLATION_SQL, "op6_url_filter": urls.FILTER_SQL, "op7_license_scan": licenses.SCAN_SQL}
