"""The registered queries: thin calls of the operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from boxwright.llm import ann_search, html_extract, mixing, near_dup, oracles, pii_surrogates, quality_model, quality_rules, secret_scan, sentence_pieces, url_filter
from boxwright.llm.shared import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


#: The piece model that encodes the standard tables.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), sentence_pieces.load(spark, PIECE_MODEL))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), key="fixed key of the test tables")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


#: The rules of the page filter: verdict, host, path.
PAGE_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(PAGE_RULES, url_filter.RULES_SCHEMA))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search.search(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_sentence_pieces, op3_near_dup, op4_mixing, op5_pii_surrogates, op6_quality_rules, op7_quality_model, op8_url_filter, op9_html_extract, op10_ann_search)}
ORACLES = {k: v for k, v in vars(oracles).items() if k in QUERIES}
