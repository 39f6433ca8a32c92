"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, egojoin, langid, linededup, minhash, mixing, pieces, quality, sharding, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out. A null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 3


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    text = F.col("text")
    return out.select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.col("_grown").alias("grown_shard")
    )


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(
        table(spark, sf_dir, "documents").select("doc_id", "text", "source"), max_repeats=1.25
    ).select("doc_id", "source", "_mix.*")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(
        table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1
    ).select("doc_id", "_lines.*", "text")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"))


def tokenised(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids, round_trip``: whether decoding gives the text back."""
    model = pieces.load(docs.sparkSession)
    out = docs.select("doc_id", pieces.tokenise(model, F.col("text")).alias("t"))
    return out.select("doc_id", F.coalesce(F.size("t.ids"), F.lit(0)).cast("long").alias("n_tokens"), "t.ids", "t.round_trip")


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "speaker", "n_turns", "rendered", spans.alias("mask"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = toxicity.fit(docs.where(_remainder() != 1).join(labels, "doc_id"))
    out = docs.select("doc_id", (_remainder() == 1).alias("held_out"), model.score(F.col("text")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_vectors(table(spark, sf_dir, "embeddings"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder() != 1))
    return docs.select(
        "doc_id", (_remainder() == 1).alias("held_out"), langid.identify(model, F.col("text")).alias("g")
    ).select("doc_id", "held_out", "g.lang_pred", "g.score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.judge(docs, table(spark, sf_dir, "labels")).select("doc_id", "_quality.*")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_SAFE = "replace(coalesce(text, ''), '<|', '<\\|')"

_OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, {_SAFE} AS body FROM conversations
), s AS (SELECT DISTINCT conv_id AS c, role AS speaker FROM t WHERE role <> 'system'
), p AS (
  SELECT conv_id, speaker, turn, role, body, (role = speaker) AS own,
         '<|im_start|>' || CASE WHEN role = 'system' THEN role WHEN role = speaker THEN 'assistant' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN s ON conv_id IS NOT DISTINCT FROM c
), q AS (
  SELECT *, sum(length(head) + length(body) + 11) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, body
         ROWS UNBOUNDED PRECEDING) - length(body) - 11 AS pos FROM p
)
SELECT conv_id, speaker, count(*) AS n_turns,
  string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, body) AS rendered,
  coalesce(string_agg(CASE WHEN own THEN CAST(CAST(pos AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(body) AS BIGINT) AS VARCHAR) END, ','
    ORDER BY turn NULLS FIRST, role, body), '') AS mask
FROM q GROUP BY conv_id, speaker
"""


_OP2 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), '') AS name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) + 1 AS BIGINT) AS tokens FROM documents
), s AS (SELECT source AS src, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source
), e AS (
  SELECT *, max(total) OVER () AS peak,
         round(greatest(0, CASE WHEN max(total) OVER () > min(total) OVER () THEN 1 - ln(1.25) / ln(max(total) OVER () / min(total) OVER ()) ELSE 0 END), 9) AS t FROM s
), q AS (SELECT *, CAST(floor(total * round(pow(peak / total, 1 - t), 9) + 1e-6) AS BIGINT) AS quota FROM e
), p AS (
  SELECT *, CAST(greatest(1, ceil(sum(quota) OVER () / 500000)) AS HUGEINT) AS blocks,
         CAST(greatest(1, ceil(quota / total)) AS BIGINT) AS epochs FROM q
), w AS (SELECT *, unnest(range(epochs)) AS epoch FROM d JOIN p ON source IS NOT DISTINCT FROM src
), a AS (
  SELECT *, epoch * total - tokens + sum(tokens) OVER (PARTITION BY source, epoch ORDER BY substr(md5('29|' || epoch || '|' || name), 1, 15), name
         ROWS UNBOUNDED PRECEDING) AS place FROM w
), b AS (SELECT *, CAST(least(place * blocks // quota, blocks - 1) AS BIGINT) AS block FROM a WHERE place < quota)
SELECT doc_id, source, tokens, CAST(epoch AS INT) AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY md5('29b|' || epoch || '|' || name), name) - 1 AS slot FROM b
"""

# Components are the least id that walks over links reach: for tables whose groups are small.
_REACHED = """reached AS (SELECT a, b FROM linked UNION SELECT reached.a, linked.b FROM reached JOIN linked ON reached.b = linked.a),
  least_of AS (SELECT a, least(a, min(b)) AS component_id FROM reached GROUP BY a)"""

_OP4 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
), fit AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), linked AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), n AS (SELECT a, count(*) AS n FROM linked GROUP BY a), {_REACHED}
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least_of l ON l.a = vec_id
"""

_OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(5, len(words)) - 1], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM w WHERE len(words) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), held AS (SELECT doc_id, shingle, n FROM sets JOIN sizes USING (doc_id)
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have, min(x.n) AS na, min(y.n) AS nb FROM held x JOIN held y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL
), linked AS (SELECT a, b FROM pairs WHERE 100 * both_have >= 85 * (na + nb - both_have)), {_REACHED}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of l ON l.a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that a second engine can run on whole tables; the others are tested against brute force."""
    return {
        "op2_source_mixing": _OP2, "op4_embedding_near_dedup": _OP4, "op7_perspective_rotation": _OP7,
        "op8_minhash_near_dedup": _OP8
    }
