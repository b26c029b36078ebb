"""The registered corpus queries, each over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moraine.llm import common, decontaminate, html_extract, langid, packing, repeats, secrets, simhash, toxicity, url_rules, vectors


def op1_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.read_table(spark, sf_dir, "pages"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.crc_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return langid.predict(docs, langid.train(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(common.read_table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(common.read_table(spark, sf_dir, "documents")))


def op5_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))


def op6_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, common.read_table(spark, sf_dir, "labels"))
    held_out = F.coalesce(common.crc_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_suffix_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.deduplicate(common.read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.audited_near_duplicates(common.read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tag_paths": op1_tag_paths,
    "op2_ppm": op2_ppm,
    "op3_url_rules": op3_url_rules,
    "op4_secrets": op4_secrets,
    "op5_spaced_seeds": op5_spaced_seeds,
    "op6_length_buckets": op6_length_buckets,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_intervals": op9_suffix_intervals,
    "op10_pruned_graph": op10_pruned_graph,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_rules": """
        WITH parts AS (
          SELECT page_id,
                 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
          FROM pages),
        rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
          ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
          SELECT page_id, max_by(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) AS best
          FROM (SELECT DISTINCT page_id, host, path FROM parts) JOIN rules
            ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
          GROUP BY page_id)
        SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f USING (page_id)""",
}
