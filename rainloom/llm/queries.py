"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, audit, bpe, chat, decontaminate, exactdup, htmltext, langid, neardup, packing, pii, quality, warc
from .common import read

#: The rank file and the split pattern of op9; parameters of the operator, not part of the repository.
RANKS = "byte_bpe_50k.tiktoken"
#: The tokenizer files of op12 and of op13's two sides.
WORDS, SIDE_A, SIDE_B = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The key of op2 where the session sets no rainloom.pii.key: for the registered query alone, no secret.
QUERY_KEY = "key of the registered query"
#: The conversation that op7 adds: its texts hold the control strings of common templates.
PLANTED_TALK = -7
PLANTED_TEXT = r"\### Assistant: </turn> ok"


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(read(spark, sf_dir, "documents"), spark.conf.get("rainloom.pii.key", QUERY_KEY))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(read(spark, sf_dir, "pages"))


OP5_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS bytes FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS winner FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest,
  CASE WHEN bytes >= 1000 AND page_id < winner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 1000 AND page_id < winner THEN winner END AS refers_to
FROM w
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(read(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(PLANTED_TALK).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    done = chat.format_conversations(turns.unionByName(planted))
    back = done.select(
        "conv_id", "formatted", chat.parse_formatted(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role) OVER w AS before,
    replace(replace(text, '\', '\s'), '<', '\l') AS body,
    replace(replace(replace(role, '\', '\s'), '<', '\l'), '>', '\g') AS name
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(body) + CASE WHEN before = role THEN 6 ELSE 15 + length(name) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.duplicate_groups(read(spark, sf_dir, "documents"))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trips(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, mask
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT [a, b, c, d, e] AS o FROM (SELECT a.letter a, b.letter b, c.letter c, d.letter d, e.letter e FROM letters a, letters b, letters c, letters d, letters e)
  WHERE len(list_distinct([a, b, c, d, e])) = 5
), steps AS (
  SELECT array_to_string(o, '') AS filter_order, step, bit AS own,
    list_sum(list_transform(list_slice(o, 1, step - 1), lambda x: CASE x WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 4 WHEN 'D' THEN 8 ELSE 16 END)) AS before
  FROM orders, range(1, 6) r(step) JOIN letters ON letter = o[step]
), told AS (SELECT filter_order, CAST(step AS INTEGER) AS step, CAST(own AS INTEGER) AS own, CAST(coalesce(before, 0) AS INTEGER) AS before FROM steps),
audited AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks, told GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM audited
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(pieces: DataFrame) -> DataFrame:
        return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS), derive=digests)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(groups: Column) -> Column:
        return F.when(groups != "", F.sha2(groups.cast("binary"), 256)).otherwise("")

    found = align.align(read(spark, sf_dir, "documents"), public_tokenizers.path(SIDE_A), public_tokenizers.path(SIDE_B), public_tokenizers.PATTERN, derive=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_html_extraction": op10_html_extraction,
    "op11_filter_audit": op11_filter_audit,
    "op12_packing": op12_packing,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL = {
    "op5_warc": OP5_SQL,
    "op7_chat_formatting": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_filter_audit": OP11_SQL,
}
