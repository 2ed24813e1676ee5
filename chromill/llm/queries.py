"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, mixing, near_dedup, pii, quality_model, quality_rules, sharding, token_count, warc
from .common import cut, remove, scratch

#: Where the query of token counts finds its vocabulary, unless it is told another place.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's size, its source's size and target, and the words that the mix takes of it."""
    planned = mixing.plan_copies(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as an archive with revisit records and read back from it; the archive goes afterwards."""
    path = scratch(spark, "warc")
    try:
        warc.write_deduplicated(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
        return cut(warc.resolve(warc.read_archive(spark, path, payloads=False)))
    finally:
        remove(spark, path)


def op3_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or much of it, with other numbers, names or units too."""
    return decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of each document, and whether it stays once boilerplate lines of its source are out."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars", "chars_left")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each kind of personal data, a digest of the base spans, and all spans."""
    found = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = found.withColumn("base", F.filter("spans", lambda x: x.base))
    of = lambda kind: F.size(F.filter("kinds", lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}")
    found = found.withColumn("kinds", F.transform("spans", lambda x: x.kind))
    return found.select("doc_id", *map(of, pii.KINDS), F.size("spans").cast("long").alias("n_spans"), F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is good, and toxic, and whether it stays."""
    return quality_model.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations, with length and digest of what they are rendered as."""
    formatted = chat.format_chats(_table(spark, sf_dir, "conversations"))
    return formatted.select("conv_id", "part", "n_turns", "n_copies", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")))
    sharded = sharding.shard(docs, 16, columns=["doc_id", "text_crc32"])
    return sharded.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_token_counts(spark: SparkSession, sf_dir: str, model: str = VOCABULARY) -> DataFrame:
    """Tokens of each document under the pieces of a vocabulary file, read by the driver, which sends them along."""
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), token_count.Vocabulary.from_model(model))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies that each document is in, over two-word shingles."""
    return near_dedup.link(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mix_sources, op2_warc_revisits, op3_template_leaks, op4_quality_rules, op5_pii, op6_quality_classifier, op7_chat_snapshots, op8_shard, op9_token_counts, op10_near_dedup)}


OP1 = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), dealt AS (
  SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS DOUBLE) AS weight FROM per
), caps AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS pos,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         coalesce(sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM dealt
), levels AS (
  SELECT *, CAST(total - held AS DOUBLE) / (weights - gone) AS level FROM caps
), chosen AS (
  SELECT arg_min(level, pos) FILTER (WHERE level * weight <= 3 * source_size) AS level FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN weight * c.level > 3 * source_size THEN CAST(3 * source_size AS DOUBLE) ELSE weight * c.level END AS target
  FROM dealt, chosen c
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets
), planned AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, d.source, CAST(r.rate AS DOUBLE) AS rate,
         CAST(floor(r.rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < r.rate - floor(r.rate) THEN 1 ELSE 0 END AS copies
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, rate, CAST(copies AS BIGINT) AS copies FROM planned
"""


OP4 = """
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT row_no, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM d
), spans AS (
  SELECT row_no, unnest(range(1, len(words) - 6)) AS place, words FROM w WHERE len(words) >= 8
), windows AS (
  SELECT row_no, place, array_to_string(words[place:place + 7], ' ') AS win FROM spans
), again AS (
  SELECT row_no, place FROM windows QUALIFY count(*) OVER (PARTITION BY row_no, win) > 1
), repeated AS (
  SELECT row_no, sum(least(8, coalesce(lead_place - place, 8))) AS n FROM (
    SELECT *, lead(place) OVER (PARTITION BY row_no ORDER BY place) AS lead_place FROM again
  ) GROUP BY row_no
), raw_lines AS (
  SELECT row_no, unnest(lines) AS line FROM w
), held_lines AS (
  SELECT row_no, line FROM raw_lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n FROM held_lines GROUP BY row_no
), normal AS (
  SELECT DISTINCT row_no, trim(regexp_replace(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line FROM held_lines
), texts AS (
  SELECT n.line, d.source, d.text, d.row_no FROM normal n JOIN d USING (row_no)
), hosts AS (
  SELECT source, count(DISTINCT text) AS texts FROM texts GROUP BY source
), frequent AS (
  SELECT t.source, t.line FROM texts t JOIN hosts h ON t.source IS NOT DISTINCT FROM h.source
  GROUP BY t.source, t.line, h.texts HAVING count(DISTINCT t.text) > 20 AND count(DISTINCT t.text) > h.texts * 0.1::DOUBLE
), depth AS (
  SELECT t.row_no, sum(length(t.line)) AS chars, coalesce(sum(length(t.line)) FILTER (WHERE f.line IS NOT NULL), 0) AS lost
  FROM texts t LEFT JOIN frequent f ON t.source IS NOT DISTINCT FROM f.source AND t.line = f.line GROUP BY t.row_no
), figures AS (
  SELECT d.doc_id, CAST(len(w.words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(x.chars, 0) AS BIGINT) AS chars, CAST(coalesce(x.chars - x.lost, 0) AS BIGINT) AS chars_left
  FROM d JOIN w USING (row_no) LEFT JOIN dup USING (row_no) LEFT JOIN repeated r USING (row_no) LEFT JOIN depth x USING (row_no)
), verdict AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM figures
)
SELECT *, NOT base_failed AND chars_left >= chars * 0.5::DOUBLE AS kept FROM verdict
"""


OP7 = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), coded AS (
  SELECT *, md5(role || ' ' || md5(text)) AS code FROM placed
), pre AS (
  SELECT conv_id, place, n, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM coded
), proper AS (
  SELECT DISTINCT prefix FROM pre WHERE place < n - 1
), whole AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies, any_value(n) AS n_turns FROM pre WHERE place = n - 1 GROUP BY prefix
), kept AS (
  SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper)
), rendered AS (
  SELECT p.conv_id, CAST(p.place // 1024 AS INTEGER) AS part,
         string_agg('<|im_start|>' || role || chr(10) || regexp_replace(text, '<\\|(im_start|im_end)\\|>', '<|' || chr(8203) || '\\1|>', 'g') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
  FROM placed p GROUP BY 1, 2
)
SELECT r.conv_id, r.part, CAST(k.n_turns AS BIGINT) AS n_turns, CAST(k.n_copies AS BIGINT) AS n_copies, CAST(length(r.text) AS BIGINT) AS n_chars, sha256(r.text) AS text_sha256
FROM rendered r JOIN kept k ON r.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP2 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), h AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p
), d AS (
  SELECT *, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(('0x' || substr(hex, 5 * (i // 4) + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1) FOR i IN range(32)], '') AS payload_digest FROM h
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""


def oracle_sql() -> dict:
    return {"op1_mix_sources": OP1, "op2_warc_revisits": OP2, "op4_quality_rules": OP4, "op7_chat_snapshots": OP7}
