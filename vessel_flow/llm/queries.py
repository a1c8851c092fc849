"""The registered queries of this package and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from . import (arc_warc, common, html_model, jaccard, license_rules, orchard, packing, quality_ftrl, recompression,
               repetition, secrets, sharding, spelling, winnow)

PACKING = packing.Params(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(common.read(spark, sf_dir, "documents"), sharding.Ring(shards=40))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_model.extract(common.read(spark, sf_dir, "pages"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.rules(common.read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.round_trip(common.read(spark, sf_dir, "pages")).drop("url")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan(common.read(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(common.read(spark, sf_dir, "documents")).drop("k", "root")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ftrl.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), PACKING)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.read(spark, sf_dir, "documents")).drop("key", "live_spans")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.dedup(common.read(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.read(spark, sf_dir, "documents"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = orchard.cluster(common.read(spark, sf_dir, "embeddings"))
    digests = {i: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for i, c in enumerate(centroids.tolist())}
    return found.withColumn("centroid_sha256", orchard.by_cluster(digests, "string"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_html": op2_html,
    "op3_repetition": op3_repetition,
    "op4_warc": op4_warc,
    "op5_licenses": op5_licenses,
    "op6_jaccard": op6_jaccard,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_secrets": op9_secrets,
    "op10_decontamination": op10_decontamination,
    "op11_recompression": op11_recompression,
    "op12_spelling": op12_spelling,
    "op13_clustering": op13_clustering,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"



def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """Exhaustive search, a pair of tables for each round."""
    cte = [rf"""
      whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
      grid AS (SELECT vec_id, row_number() OVER () AS r, list_transform(v, lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM whole),
      c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM grid
        ORDER BY c LIMIT {k})"""]
    for i in range(rounds + 1):
        cte.append(f"""
      a{i} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min([d, c]) AS best FROM (
        SELECT r, vec_id, g.v, c, CAST(list_sum(list_transform(list_zip(g.v, c{i}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM grid g, c{i}) GROUP BY r)""")
        if i < rounds:
            cte.append(f"""
      m{i} AS (SELECT c, list(m ORDER BY j) AS v FROM (
        SELECT best[2] AS c, j, CAST((sum(v[j]) - ((sum(v[j]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m
        FROM a{i}, range(1, 65) t(j) GROUP BY ALL) GROUP BY c),
      c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)""")
    return "WITH " + ",".join(cte) + f"""
      SELECT vec_id, CAST(best[2] AS INT) AS cluster, best[1] AS distance,
        CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
      FROM a{rounds} JOIN c{rounds} ON c = best[2]"""


ORACLE: dict[str, str] = {
    "op4_warc": """
      WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
      firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
      bits AS (
        SELECT *, array_to_string(list_transform(string_split(lower(sha1(payload)), ''), lambda c: substr(
          '0000000100100011010001010110011110001001101010111100110111101111',
          4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS b FROM firsts)
      SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
        array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
          + 16 * CAST(substr(b, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INT)
          + 4 * CAST(substr(b, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(b, 5 * i + 4, 1) AS INT)
          + CAST(substr(b, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN page_id <> first THEN first END AS refers_to
      FROM bits""",
    "op6_jaccard": rf"""
      WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
      sets AS (
        SELECT doc_id, CASE WHEN len(w) >= 5
          THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
      flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
      both_in AS (
        SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS n
        FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
      links AS (SELECT a, b FROM both_in WHERE 100 * n >= 80 * (na + nb - n)),
      edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
      least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
      SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id
      FROM sets s JOIN least_of l ON s.doc_id = l.a""",
    "op10_decontamination": rf"""
      WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
      bw AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
        FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0),
      dw AS (
        SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
        FROM d, (SELECT DISTINCT n FROM bw) l, unnest(range(1, len(w) - n + 2)) t(i)),
      hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.x = bw.x AND dw.n = bw.n),
      words AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) t(k) GROUP BY doc_id),
      items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
      SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
        CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated
      FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op11_recompression": r"""
      WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      windows AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS place
        FROM d, unnest(range(1, len(w) - 18)) t(i)),
      gone AS (SELECT DISTINCT doc_id, i + j AS i FROM windows, range(0, 20) t(j) WHERE place > 1),
      kept AS (
        SELECT d.doc_id, count(gone.i) AS n_removed,
          string_agg(d.w[t.i], ' ' ORDER BY t.i) FILTER (WHERE gone.i IS NULL) AS kept
        FROM d CROSS JOIN LATERAL unnest(range(1, len(w) + 1)) t(i) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.i = t.i
        GROUP BY d.doc_id)
      SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
      FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op13_clustering": _clustering_sql(),
}
