"""The queries of this subpackage: each applies an operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fill_in_middle, kneser_ney, licenses, near_duplicates, prefix_trie, quality, sentence_pieces, sharding, substrings, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, "doc_id")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.near_duplicates(docs, size=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substrings.remove_repeats(docs.withColumnRenamed("text", "original"), text="original")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write(_table(spark, sf_dir, "documents").select("doc_id", "text"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_checksums(spark, folder).withColumnRenamed("key", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}

_WS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL3 = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WS}') AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS MATERIALIZED (
  SELECT x, y FROM pairs UNION SELECT y, x FROM pairs
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), component AS (
  SELECT x, min(y) AS c FROM reach GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept FROM sets JOIN component ON doc_id = x
"""

_SQL4 = f"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WS}') AS w FROM documents
), runs AS MATERIALIZED (
  SELECT doc_id, i, hash(list_slice(w, i, i + 34)) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), repeated AS MATERIALIZED (
  SELECT doc_id, i FROM runs WHERE h IN (SELECT h FROM runs GROUP BY h HAVING count(*) > 1)
), gone AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM repeated) GROUP BY doc_id
), placed AS (
  SELECT w.doc_id, len(w) AS n, coalesce(len(ps), 0) AS r,
    CASE WHEN ps IS NULL THEN w ELSE list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(ps, i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) END AS k
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, r::BIGINT AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM placed
"""

_SQL9 = f"""
WITH dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark
), patterns AS MATERIALIZED (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, i, i + least(13, len(w)) - 1) AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)
), lengths AS (
  SELECT DISTINCT k FROM patterns
), found AS MATERIALIZED (
  SELECT DISTINCT d.doc_id, d.i, d.k, p.item_id
  FROM (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS q FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lengths WHERE len(w) >= k)) d
  JOIN patterns p ON d.k = p.k AND d.q = p.p
), hits AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM found) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
  sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(w) AS contaminated
FROM dw d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN items t ON d.doc_id = t.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": _SQL3, "op4_substring_dedup": _SQL4, "op9_decontamination": _SQL9}


def op7_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.perspectives(_table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id",
        "part",
        "perspective",
        "n_turns",
        "n_targets",
        F.col("start").alias("first_char"),
        F.length("rendered").cast("long").alias("n_chars"),
        F.sha2(F.encode("rendered", "UTF-8"), 256).alias("rendered_sha256"),
        F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",").alias("spans"),
    )


QUERIES |= {"op7_kd_shards": op7_kd_shards, "op8_perspectives": op8_perspectives}

_SQL8 = r"""
WITH turns AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '<\|') AS role, replace(coalesce(text, ''), '<|', '<\|') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'
), shown AS (
  SELECT t.*, (k - 1) // 1024 AS part, perspective, role = perspective AS target,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || role || '|>' || chr(10) END AS head,
    text || '<|end|>' || chr(10) AS body
  FROM numbered t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, part, perspective ORDER BY k) AS stop FROM shown
), parts AS (
  SELECT conv_id, part::BIGINT AS part, perspective, count(*)::BIGINT AS n_turns, count(*) FILTER (target)::BIGINT AS n_targets, sum(length(head) + length(body))::BIGINT AS n_chars,
    sha256(string_agg(head || body, '' ORDER BY k)) AS rendered_sha256,
    coalesce(string_agg((stop - length(body))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (target), '') AS spans
  FROM placed GROUP BY conv_id, part, perspective
)
SELECT *, (sum(n_chars) OVER (PARTITION BY conv_id, perspective ORDER BY part) - n_chars)::BIGINT AS first_char FROM parts
"""
ORACLE_SQL["op8_perspectives"] = _SQL8


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["start"])
    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


QUERIES["op6_license_scan"] = op6_license_scan


def op2_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), order=3)


QUERIES["op2_kneser_ney"] = op2_kneser_ney


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256).alias(f"{c}_sha256")
    return fill_in_middle.restore(rows).select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt_turns(_table(spark, sf_dir, "conversations")))


QUERIES |= {"op11_sentence_pieces": op11_sentence_pieces, "op12_fill_in_middle": op12_fill_in_middle, "op13_prefix_trie": op13_prefix_trie}

_SQL12 = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cut AS MATERIALIZED (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, list_transform(range(0, 4), lambda i: ('0x' || h[8 * i + 1 : 8 * i + 8])::BIGINT) AS h FROM texts
), placed AS (
  SELECT *, len(u) AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM cut
), parts AS (
  SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : n], ''), '') AS s,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM placed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""

# the CRC-32 of a conversation's digits, by bits: SQL has no function for it
_SQL13 = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
  SELECT DISTINCT c, c::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS x FROM turns
  UNION ALL
  SELECT c, s, i + 1, CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END
  FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(x, ascii(s[i // 8 + 1])::BIGINT) ELSE x END AS y FROM bits WHERE i < 8 * length(s))
), heads AS (
  SELECT c, xor(x, 4294967295::BIGINT) % 6 AS h FROM bits WHERE i = 8 * length(s)
), taken AS (
  SELECT c, h, (SELECT least(h, count(*)) FROM turns b WHERE b.c = heads.c - heads.c % 100) AS m FROM heads
), rebuilt AS MATERIALIZED (
  SELECT t.c, b.k AS d, b.role, b.text FROM taken t JOIN turns b ON b.c = t.c - t.c % 100 AND b.k <= t.h
  UNION ALL SELECT t.c, o.k - t.h + t.m, o.role, o.text FROM taken t JOIN turns o ON o.c = t.c AND o.k > t.h
), whole AS (
  SELECT t.c, coalesce(list(sha256(length(role) || ':' || role || text) ORDER BY d) FILTER (d IS NOT NULL), []) AS keys, coalesce(list(length(text) ORDER BY d) FILTER (d IS NOT NULL), []) AS sizes
  FROM taken t LEFT JOIN rebuilt r ON t.c = r.c GROUP BY t.c
), members AS MATERIALIZED (
  SELECT c, d, len(keys) AS l, coalesce(sizes[d], 0) AS size, min(c) OVER (PARTITION BY d, array_to_string(keys[1 : d], ',')) AS node
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM whole)
), nodes AS MATERIALIZED (
  SELECT node, d, count(*) AS n, any_value(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (l = d), '') AS ends FROM members GROUP BY node, d
), linked AS MATERIALIZED (
  SELECT n.*, p.node AS parent FROM nodes n LEFT JOIN members p ON p.c = n.node AND p.d = n.d - 1
), kids AS MATERIALIZED (
  SELECT parent AS node, d - 1 AS d, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT m.node, m.d, sum((x.n - 1) * x.size) AS saved, count(*) FILTER (k.k IS NULL) AS leaves
  FROM members m JOIN nodes x ON x.node = m.c AND x.d >= m.d LEFT JOIN kids k ON k.node = x.node AND k.d = x.d GROUP BY m.node, m.d
)
SELECT n.node AS conv_id, n.d::BIGINT AS depth, n.parent AS parent_conv_id, n.n AS n_convs, coalesce(k.k, 0)::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM linked n JOIN below b ON n.node = b.node AND n.d = b.d LEFT JOIN kids k ON k.node = n.node AND k.d = n.d
"""
ORACLE_SQL |= {"op12_fill_in_middle": _SQL12, "op13_prefix_trie": _SQL13}
