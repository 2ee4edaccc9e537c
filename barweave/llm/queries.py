"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit
from .decontaminate import contaminated
from .html import extract_main_text
from .pii import find_personal_data
from .quality import quality_verdicts
from .quality_classifier import quality_scores
from .secrets import scan_secrets
from .sentencepiece_codec import sentencepiece_digest
from .simhash import simhash_components
from .spelling import spelling_variants
from .suffix_array import remove_repeated_bytes
from .suffix_tree import remove_repeated_words
from .urls import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digest(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2:3].isdigit()}


#: All rules against all urls, without an index: hosts and paths by string functions, words of hosts between dots.
OP5_SQL = """WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(action, name, rule_host, rule_path) AS (VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'), ('allow', 'net/de/', 'net', '/de/'),
  ('block', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')),
hosts(words) AS (VALUES ('ads.track'), ('adserver'), ('adclick'), ('doubleclick'), ('adult.x'), ('adult'), ('porn'), ('xxx'), ('casino'), ('casino.win'), ('free.bets'), ('bets'), ('betting'),
  ('poker'), ('cheap.pills'), ('pills'), ('viagra'), ('spam.farm'), ('spam'), ('link.farm'), ('warez'), ('malware'), ('phishing')),
paths(words) AS (VALUES ('/ads/'), ('/adserver/'), ('/banners/'), ('/wp/login/')),
b AS (SELECT p.page_id, max(row(length(name), name, action)) AS best FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY p.page_id),
x AS (SELECT DISTINCT page_id FROM p JOIN hosts ON contains('.' || replace(host, '-', '.') || '.', '.' || words || '.') UNION SELECT DISTINCT page_id FROM p JOIN paths ON contains(path, words))
SELECT p.page_id, host, path, best[2] AS rule, coalesce(best[3], CASE WHEN x.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b ON b.page_id = p.page_id LEFT JOIN x ON x.page_id = p.page_id"""


def oracle_sql() -> dict[str, str]:
    """The others cannot be said in SQL at a bearable cost; tests/llm holds each against brute force."""
    return {"op5_url_filter": OP5_SQL, "op11_filter_audit": audit.SQL}
