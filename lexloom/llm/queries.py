"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.common import fold, read_table
from lexloom.llm.decontaminate import contamination
from lexloom.llm.exact_dedup import exact_dedup
from lexloom.llm.language import fit_profiles, identify
from lexloom.llm.lm_scoring import score_texts
from lexloom.llm.mixing import mix
from lexloom.llm.pii import digest, find_pii
from lexloom.llm.sharding import shard_hilbert
from lexloom.llm.simhash import near_duplicates
from lexloom.llm.tokens import token_counts
from lexloom.llm.toxicity import fit, score


def op1_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 4, 2))
    profiles = fit_profiles(docs.where("not held_out"))
    return identify(docs, profiles, keep=("held_out",))


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_hilbert(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5, 0))
    labels = read_table(spark, sf_dir, "labels").where(~fold(F.col("doc_id"), 5, 0))
    scored = score(docs, fit(docs.where("not held_out"), labels), keep=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "n_near", "component_id")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    n_hit, ids = F.size("hits").cast("long"), F.array_join("items", ",").cast("binary")
    return marked.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_pii(read_table(spark, sf_dir, "documents")))


def op10_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5, 1))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_profiles": op1_language_profiles,
    "op2_hilbert_sharding": op2_hilbert_sharding,
    "op3_source_mixing": op3_source_mixing,
    "op4_golomb_dedup": op4_golomb_dedup,
    "op5_kneser_ney_toxicity": op5_kneser_ney_toxicity,
    "op6_simhash_variants": op6_simhash_variants,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_contextual_pii": op9_contextual_pii,
    "op10_lm_automaton": op10_lm_automaton,
}

ORACLES: dict[str, str] = {
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
             b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
             g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS txt
                   FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(i) WHERE len(w) > 0),
             n AS (SELECT DISTINCT n FROM g),
             p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS txt
                   FROM d, n, unnest(range(1, len(w) - n + 2)) AS u(i)),
             h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN g ON p.n = g.n AND p.txt = g.txt),
             c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS u(j) GROUP BY doc_id),
             t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, coalesce(array_to_string(list_sort(list(DISTINCT item_id::VARCHAR) FILTER (item_id IS NOT NULL)), ','), '') AS ids FROM h GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op3_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, text,
                          coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          md5('mix' || coalesce(doc_id::VARCHAR, '')) AS k
                   FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size,
                          row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
                   FROM d GROUP BY source),
             w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
             r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM w WHERE source_size > 0),
             c AS (SELECT *,
                          (SELECT sum(source_size) FROM r)::DOUBLE
                          - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                          sum(w) OVER (ORDER BY ratio DESC, i DESC ROWS UNBOUNDED PRECEDING) AS open_w
                   FROM r),
             l AS (SELECT coalesce((SELECT rest / open_w FROM c WHERE rest / open_w <= ratio ORDER BY ratio, i LIMIT 1), 1e300) AS level),
             t AS (SELECT w.source, source_size,
                          CASE WHEN source_size = 0 THEN 0.0::DOUBLE
                               WHEN (SELECT level FROM l) * w > 3.0::DOUBLE * source_size THEN 3.0::DOUBLE * source_size
                               ELSE (SELECT level FROM l) * w END AS target
                   FROM w),
             b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
             p AS (SELECT d.*, b.source_size, b.target, b.epochs,
                          CASE WHEN b.source_size = 0 THEN 0 ELSE floor(target - epochs * source_size + 0.5)::BIGINT END AS rest,
                          sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
                   FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken
        FROM p""",
    "op4_golomb_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents),
             r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(t) DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY bare) AS group_size
                   FROM d)
        SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM r""",
}
