"""The corpus operators as queries over the warehouse tables, with an SQL statement where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frisk.llm import alignment, byte_bpe, conversation_repair, html_text, language_id, line_dedup, ngram_join, packing, quality_classifier, quality_rules, rank_bpe, search, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINES_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.doc_id, pos, line, common.k IS NOT NULL AND keyed.doc_id <> keeper AS gone
  FROM keyed LEFT JOIN common ON keyed.k = common.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op1_ngram_join")
def op1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return ngram_join.jaccard_groups(docs, ngram_join.Similarity(words=3, percent=90))


@query("op2_quality_rules")
def op2(spark, d):
    out = quality_rules.quality_filter(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


@query("op3_quality_classifier")
def op3(spark, d):
    out = quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels"))
    return out.select(F.col("id").alias("doc_id"), "quality_score", "toxic_score", "kept")


@query("op4_byte_bpe")
def op4(spark, d):
    import public_tokenizers as P
    docs, ranks = table(spark, d, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken")
    decoded = byte_bpe.decode(byte_bpe.encode(docs, ranks, P.PATTERN), ranks, P.PATTERN)
    return byte_bpe.per_document(docs, decoded)


@query("op5_html_text")
def op5(spark, d):
    return html_text.extract(table(spark, d, "pages"))


@query("op6_topk_search")
def op6(spark, d):
    rows = search.vectors(table(spark, d, "documents").select("doc_id", "text"))
    return search.search(rows, rows.filter("id % 50 = 0"), k=10)


PAGES_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
h AS (SELECT payload, first, sha1(payload) AS hex FROM g),
d AS (SELECT payload, first, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + (v >> (5 * (3 - j)))::INTEGER % 32, 1), '' ORDER BY i, j)
      FROM (SELECT i, j, ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT AS v FROM range(8) a(i), range(4) b(j))) AS digest FROM h)
SELECT page_id, octet_length(p.payload) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN d ON p.payload = d.payload
"""


@query("op7_warc", PAGES_SQL)
def op7(spark, d):
    history = warc.archive_and_index(table(spark, d, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_line_dedup", LINES_SQL)
def op8(spark, d):
    out = line_dedup.dedup_lines(table(spark, d, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").cast("long").alias("n_dropped"),
                      F.sha2("text", 256).alias("kept_sha256"))


@query("op9_language_id")
def op9(spark, d):
    return language_id.identify(table(spark, d, "documents").select("doc_id", "text", "lang"))


@query("op10_packing")
def op10(spark, d):
    import public_tokenizers as P
    return packing.pack(table(spark, d, "documents").select("doc_id", "text"), P.path("word_bpe_49k.json"))


@query("op11_alignment")
def op11(spark, d):
    import public_tokenizers as P
    return alignment.per_document(table(spark, d, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


REPAIR_SQL = """
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, row_number() OVER () AS id FROM conversations),
faulty AS (  -- crc32 bit by bit
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: CASE WHEN v & 1 = 1 THEN xor(3988292384::BIGINT, v >> 1) ELSE v >> 1 END))) % 20 AS f FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, id, copy
  FROM faulty, (SELECT unnest([1, 2]) AS copy) WHERE f <> 0 AND (copy = 1 OR f = 3)),
placed AS (
  SELECT *, row_number() OVER w AS pos, lag(left(role, 1)) OVER w AS before,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, id, copy) AS nth,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), id, copy)),
rows AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
convs AS (SELECT conv_id, count(*) AS n FROM rows GROUP BY conv_id),
-- from the last row to the first: cost, audit and repaired text from each grammar state (nothing yet, after s, after u, after a)
w AS (
  SELECT conv_id, n AS p, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 4::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} AS s1,
         {'c': 2::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'} AS s2, {'c': 0::BIGINT, 'a': '', 't': ''} AS s3
  FROM convs
  UNION ALL
  SELECT conv_id, p, list_sort([b0, {'c': f2.c + 2, 'a': 'I' || f2.a, 't': chr(10) || 'user:' || f2.t}])[1],
         list_sort([b1, {'c': f2.c + 2, 'a': 'I' || f2.a, 't': chr(10) || 'user:' || f2.t}])[1], f2,
         list_sort([b3, {'c': b2.c + 2, 'a': 'I' || b2.a, 't': chr(10) || 'user:' || b2.t}])[1]
  FROM (SELECT *, list_sort([b2, {'c': b3.c + 2, 'a': 'I' || b3.a, 't': chr(10) || 'assistant:' || b3.t}])[1] AS f2 FROM (
    SELECT w.conv_id, p - 1 AS p,
      list_sort([{'c': s0.c + 3, 'a': 'D' || s0.a, 't': s0.t}, {'c': s2.c + m + 2, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t},
        CASE i WHEN 's' THEN {'c': s1.c + m, 'a': 'K' || s1.a, 't': own || s1.t} WHEN 'u' THEN {'c': s2.c + m, 'a': 'K' || s2.a, 't': own || s2.t}
               ELSE {'c': 99999999::BIGINT, 'a': '', 't': ''} END])[1] AS b0,
      list_sort([{'c': s1.c + 3, 'a': 'D' || s1.a, 't': s1.t}, {'c': s2.c + m + 2, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t},
        CASE i WHEN 'u' THEN {'c': s2.c + m, 'a': 'K' || s2.a, 't': own || s2.t} ELSE {'c': 99999999::BIGINT, 'a': '', 't': ''} END])[1] AS b1,
      list_sort([{'c': s2.c + 3, 'a': 'D' || s2.a, 't': s2.t}, {'c': s3.c + m + 2, 'a': 'R' || s3.a, 't': chr(10) || 'assistant:' || text || s3.t},
        CASE i WHEN 'a' THEN {'c': s3.c + m, 'a': 'K' || s3.a, 't': own || s3.t} ELSE {'c': 99999999::BIGINT, 'a': '', 't': ''} END])[1] AS b2,
      list_sort([{'c': s3.c + 3, 'a': 'D' || s3.a, 't': s3.t}, {'c': s2.c + m + 2, 'a': 'R' || s2.a, 't': chr(10) || 'user:' || text || s2.t},
        CASE i WHEN 'u' THEN {'c': s2.c + m, 'a': 'K' || s2.a, 't': own || s2.t} ELSE {'c': 99999999::BIGINT, 'a': '', 't': ''} END])[1] AS b3
    FROM w JOIN (SELECT conv_id AS conv, pos, text, left(role, 1) AS i, chr(10) || role || ':' || text AS own,
                   CASE WHEN fault IN ('blank', 'duplicate') THEN 88888888 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS m FROM rows)
      ON conv IS NOT DISTINCT FROM w.conv_id AND pos = p))),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
         count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(substr(s0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM o.conv_id AND w.p = 0
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12(spark, d):
    return conversation_repair.damaged_and_repaired(table(spark, d, "conversations"))


@query("op13_rank_bpe")
def op13(spark, d):
    import public_tokenizers as P
    return rank_bpe.per_document(table(spark, d, "documents").select("doc_id", "text"), P.path("byte_bpe_50k.json"))
