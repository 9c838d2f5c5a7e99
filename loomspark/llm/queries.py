"""Registered queries of the text operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import align_tokens
from .common import table
from .contamination import contaminated
from .html import extract
from .importance import resample
from .language import predict_language
from .licenses import license_scan
from .mixing import mix
from .neighbours import nearest_neighbours
from .quality import quality
from .sharding import shard
from .simhash import link_fingerprints
from .substrings import dedup_substrings
from .tokens import count_tokens


def op1_mixing(spark: SparkSession, d: str) -> DataFrame:
    mixed = mix(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2_token_counts(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    linked = link_fingerprints(table(spark, d, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return dedup_substrings(table(spark, d, "documents")).drop("kept")


def op6_sharding(spark: SparkSession, d: str) -> DataFrame:
    placed = shard(table(spark, d, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html(spark: SparkSession, d: str) -> DataFrame:
    return extract(table(spark, d, "pages"))


def op8_quality(spark: SparkSession, d: str) -> DataFrame:
    digest = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality(table(spark, d, "documents")).select(*digest)


def op9_language(spark: SparkSession, d: str) -> DataFrame:
    return predict_language(table(spark, d, "documents"))


def op10_licenses(spark: SparkSession, d: str) -> DataFrame:
    return license_scan(table(spark, d, "documents")).drop("spans")


def op11_resampling(spark: SparkSession, d: str) -> DataFrame:
    return resample(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("n_words")


def op12_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op13_alignment(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return align_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict:
    listed = (
        op1_mixing, op2_token_counts, op3_simhash, op4_decontamination, op5_substring_dedup,
        op6_sharding, op7_html, op8_quality, op9_language, op10_licenses,
        op11_resampling, op12_neighbours, op13_alignment,
    )
    return {f.__name__: f for f in listed}


_ITEM_WORDS = r"regexp_extract_all(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_GRAMS = "list_distinct(list_transform(range(1, greatest(len(w) - {k} + 2, 1)), lambda i: array_to_string(w[i:i + {k} - 1], ' ')))"

OP4_SQL = f"""
WITH items AS (SELECT item_id, {_ITEM_WORDS.format(t="text")} AS w FROM benchmark),
widths AS (SELECT item_id, w, least(len(w), 5) AS k FROM items WHERE len(w) > 0),
shingled AS (SELECT item_id, k, list_sort({_GRAMS.format(k="k")}) AS s FROM widths),
classes AS (SELECT min(item_id) AS item_id, k, s, len(s) AS n FROM shingled GROUP BY k, s),
own AS (SELECT item_id, k, n, unnest(s) AS gram FROM classes),
docs AS (SELECT doc_id, {_ITEM_WORDS.format(t="text")} AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, k, unnest({_GRAMS.format(k="k")}) AS gram FROM docs, (SELECT DISTINCT k FROM widths)
),
pairs AS (
  SELECT doc_id, item_id, count(*) / any_value(n)::DOUBLE AS share
  FROM grams JOIN own USING (gram, k) GROUP BY doc_id, item_id HAVING count(*) >= ceil(round(any_value(n) * 0.8, 6))
)
SELECT doc_id, arg_min(item_id, struct_pack(a := -share, b := item_id)) AS item_id, round(max(share), 6) AS containment, count(*) AS n_items
FROM pairs GROUP BY doc_id
"""

#: crc32 over the bytes of a feature, through a table of its 256 steps that SQL makes itself.
OP11_SQL = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step
),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS.format(t="text")} AS w FROM documents
  UNION ALL SELECT -item_id - 1, NULL, {_ITEM_WORDS.format(t="text")} FROM benchmark
),
features AS (
  SELECT r, unnest(w) AS f FROM texts
  UNION ALL SELECT r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM texts
),
hashed AS (
  SELECT f, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(f))), 2), lambda i: ('0x' || hex(encode(f))[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, step[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), steps
),
met AS (SELECT r, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY r, bucket),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0) AS s, coalesce(sum(n) FILTER (r < 0), 0) AS t FROM met GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM counts) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM counts) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM counts
),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM met JOIN gains USING (bucket) WHERE r > 0 GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT)::BIGINT AS score
  FROM texts LEFT JOIN weights USING (r) WHERE r > 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN n_words >= 20 AND place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM placed
"""


def oracle_sql() -> dict[str, str]:
    """Only where SQL gives the operator's own rows; the others are tested against brute force in tests/llm."""
    return {"op4_decontamination": OP4_SQL, "op11_resampling": OP11_SQL}
