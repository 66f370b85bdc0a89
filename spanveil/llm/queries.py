"""The queries of the training-data operators and, where SQL can say it, their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanveil.llm import content_sort, factors, importance, mixing, neighbours, packing, parity_join, tokens, url_rules, warc
from spanveil.llm.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Python workers look for this package where the driver found it, whatever folder they start in
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        env["PYTHONPATH"] = os.pathsep.join([root, *known])
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    records = warc.read_warc(spark, path)
    head = lambda name: warc.header(F.col("headers"), name)
    number = lambda name: F.regexp_extract(head(name), r"page:(-?\d+)>", 1).try_cast("long")
    revisit = head("WARC-Type") == "revisit"
    return records.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(revisit, head("WARC-Payload-Length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(head("WARC-Payload-Digest"), ":", -1)).otherwise(F.sha1("payload")).alias("payload_digest"),
        head("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
    )


def op2_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("id", F.lit(100)) == 0, k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), limit=2048)


def op9_pack_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lz_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    left = factors.remove(docs, factors.parse(docs, window=20), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.join_components(table(spark, sf_dir, "documents"), width=4, percent=85)


#: (host, path, verdict); fixed values of the query.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, URL_RULES)) + " AS rules(host, path, verdict)")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(table(spark, sf_dir, "documents"), retain="largest")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_chain": op1_warc_chain,
    "op2_one_bit_codes": op2_one_bit_codes,
    "op3_token_counts": op3_token_counts,
    "op4_lz_factors": op4_lz_factors,
    "op5_parity_join": op5_parity_join,
    "op6_url_rules": op6_url_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_content_sort": op8_content_sort,
    "op9_pack_tiers": op9_pack_tiers,
    "op10_importance": op10_importance,
}

ORACLE: dict[str, str] = {
    "op1_warc_chain": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, b, CASE WHEN octet_length(b) >= 1000 THEN max(page_id) OVER (PARTITION BY b) ELSE page_id END AS r FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest,
  CASE WHEN r = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to FROM g""",
    "op6_url_rules": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, pre, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (SELECT page_id, max_by(h || pre, length(h || pre)) AS rule, max_by(verdict, length(h || pre)) AS verdict
      FROM p JOIN rules ON (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, pre) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "op7_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('7:' || doc_id::VARCHAR) AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n, sum(source_size) OVER ()::BIGINT AS total FROM s0),
s2 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(n % 3 + 1)::BIGINT] AS weight, source_size * 3.0::DOUBLE AS cap FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER lower_caps, 0) AS below, sum(weight) OVER () - coalesce(sum(weight) OVER lower_caps, 0) AS rest FROM s2
       WINDOW lower_caps AS (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, (total - below) / rest AS lv FROM s3),
s5 AS (SELECT *, (SELECT arg_min(lv, (cap / weight, n)) FROM s4 WHERE lv * weight <= cap) AS level FROM s4),
s6 AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target, 1::BIGINT AS block, total FROM s5),
s7 AS (SELECT *, floor(total::DOUBLE / block + 0.5)::BIGINT AS seats, ceil(source_size::DOUBLE / 524288)::BIGINT AS shards FROM s6),
s8 AS (SELECT source, count(*) AS quota FROM
        (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS FIRST) AS r
         FROM (SELECT *, unnest(range(0, ceil(1.2 * target / block)::BIGINT + 20)) AS k FROM s7)) WHERE r <= seats GROUP BY source),
src AS (SELECT s7.*, coalesce(quota, 0) AS quota FROM s7 LEFT JOIN s8 ON s7.source IS NOT DISTINCT FROM s8.source),
p AS (SELECT d.*, source_size, target, block, quota, ('0x' || substr(h, 1, 8))::BIGINT % greatest(1, shards) AS shard FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
l0 AS (SELECT source, shard, sum(size)::BIGINT AS line, min(quota) AS seats, min(block) AS block FROM p GROUP BY source, shard),
l1 AS (SELECT source, shard, count(*) AS q FROM
        (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY line / (2 * k + 1) DESC, shard) AS r
         FROM (SELECT *, unnest(range(0, ceil(3.6 * line / block)::BIGINT + 20)) AS k FROM l0)) WHERE r <= seats GROUP BY source, shard),
l2 AS (SELECT l0.source, l0.shard, line, least(coalesce(q, 0) * block, line * 3) AS words FROM l0 LEFT JOIN l1 ON l0.source IS NOT DISTINCT FROM l1.source AND l0.shard = l1.shard),
o AS (SELECT p.*, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p)
SELECT doc_id, size, source_size, target,
  (words // greatest(line, 1) * size + greatest(0, least(size, words % greatest(line, 1) - off)))::BIGINT AS taken
FROM o JOIN l2 ON o.source IS NOT DISTINCT FROM l2.source AND o.shard = l2.shard""",
    "op8_content_sort": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)""",
}
