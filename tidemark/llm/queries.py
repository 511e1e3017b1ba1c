"""The contract queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(spark, table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", "times", "taken")


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify, in_training, learn
    from .shared import crc_mod

    docs = table(spark, sf_dir, "documents")
    found = identify(spark, docs, learn(spark, docs.where(in_training())))
    return found.withColumnRenamed("id", "doc_id").withColumn("held_out", crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score", "languages")


def op7_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import learn, scan

    docs = table(spark, sf_dir, "documents")
    found = scan(spark, docs, learn(spark, docs))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op6_pack_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_quality_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import learn, scored
    from .shared import crc_mod

    docs = table(spark, sf_dir, "documents")
    model = learn(spark, docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    found = scored(spark, docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import score
    from .shared import crc_mod

    found = score(spark, table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    return nearest(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_substring_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated

    return repeated(spark, table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_quality_network": op2_quality_network,
    "op3_backoff_automaton": op3_backoff_automaton,
    "op4_anisotropic_search": op4_anisotropic_search,
    "op5_substring_chunks": op5_substring_chunks,
    "op6_pack_configurations": op6_pack_configurations,
    "op7_secret_formats": op7_secret_formats,
    "op8_subspace_pigeonhole": op8_subspace_pigeonhole,
    "op9_language_mixture": op9_language_mixture,
    "op10_simhash_tiles": op10_simhash_tiles,
}

#: DuckDB SQL for the queries that it can express on whole tables.
ORACLES: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, '~'), coalesce(source, '~'), coalesce(text, '~'))), 1, 15))::BIGINT AS h
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
        sum(weight) OVER () - sum(weight) OVER o + weight AS w_left,
        coalesce(sum(2 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped
    FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT arg_min((budget - stopped) / w_left, source_size / weight) AS level FROM r WHERE (budget - stopped) / w_left * weight <= 2 * source_size),
t AS (SELECT source, source_size, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l), 'inf'::DOUBLE) * weight) ELSE 0 END AS target FROM r),
e AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT *, target - copies * source_size AS want, row_number() OVER (PARTITION BY source ORDER BY h) AS nth FROM e),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, nth ROWS UNBOUNDED PRECEDING) AS upto FROM o),
k AS (SELECT *, upto <= want AS under, want - coalesce(max(upto) FILTER (WHERE upto <= want) OVER (PARTITION BY source), 0) AS rest FROM c),
p AS (SELECT source, arg_min({'h': h, 'nth': nth}, (abs(size - rest), h, nth)) AS pick FROM k WHERE NOT under AND size > 0 GROUP BY source),
n AS (SELECT k.*, CASE WHEN size = 0 THEN 0 ELSE copies + (under OR (coalesce(h = pick.h AND nth = pick.nth, false) AND abs(size - rest) < rest))::BIGINT END AS times
    FROM k LEFT JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, source, size, source_size, target, times, (size * times)::BIGINT AS taken FROM n""",
    "op8_subspace_pigeonhole": """
WITH RECURSIVE v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0 AND isfinite(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))),
links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
}
