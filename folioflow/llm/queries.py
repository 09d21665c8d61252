"""Queries over the operators of this subpackage, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, jaccard, langid, licenses, media, mixing, packing, prefixtrie, ruleclf, rules, secrets, textstats, tokencodes
from .common import documents, is_held_out, shared_path, written


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, each row a ``message`` event, plus conversation -1."""
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') "
        "AS t(conv_id, turn, role, text)"
    )
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    events = turns.select("conv_id", "turn", "role", "text").unionByName(extra).select(
        "conv_id", F.col("turn").alias("seq"), F.col("turn").alias("message_id"),
        F.lit("message").alias("kind"), "role", "text",
    )
    return chat.digests(chat.read_back(chat.render(chat.fold_messages(events))))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*(?:/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>))', '\1\\\2', 'g') AS body
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(role) + length(body))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a PNG member of an archive, read back by byte ranges."""
    stored = media.store_texts(documents(spark, sf_dir), shared_path(spark, "media"))
    return media.media_features(stored)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, weak parts only where complementary parts are near."""
    return secrets.scan(documents(spark, sf_dir))


OP3_SQL = r"""
WITH patterns(kind, name, pattern, grp, least) AS (VALUES
  (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 0),
  (1, 'access', 'AKIA[A-Z0-9]{14,}', 0, 0),
  (2, 'hex', '[0-9a-f]{16,}', 0, 0),
  (4, 'user', '(?i:user_?name|user_?id|login|client_?id|account)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@-]+)', 1, 3),
  (5, 'endpoint', '(?:https?://[A-Za-z0-9./_:?&=%-]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b)', 0, 7)
), texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), raw AS (
  SELECT row, kind, least,
    CASE kind WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN regexp_extract_all(text, 'AKIA[A-Z0-9]{14,}') WHEN 2 THEN regexp_extract_all(text, '[0-9a-f]{16,}')
      WHEN 4 THEN regexp_extract_all(text, '(?i:user_?name|user_?id|login|client_?id|account)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@-]+)')
      ELSE regexp_extract_all(text, '(?:https?://[A-Za-z0-9./_:?&=%-]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b)') END AS matches,
    CASE kind WHEN 0 THEN regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)
      WHEN 4 THEN regexp_extract_all(text, '(?i:user_?name|user_?id|login|client_?id|account)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@-]+)', 1) END AS vals,
    CASE kind WHEN 0 THEN string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)')
      WHEN 1 THEN string_split_regex(text, 'AKIA[A-Z0-9]{14,}') WHEN 2 THEN string_split_regex(text, '[0-9a-f]{16,}')
      WHEN 4 THEN string_split_regex(text, '(?i:user_?name|user_?id|login|client_?id|account)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.@-]+)')
      ELSE string_split_regex(text, '(?:https?://[A-Za-z0-9./_:?&=%-]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?\b)') END AS pieces
  FROM texts, patterns WHERE regexp_matches(text, pattern)
), one AS (
  SELECT row, kind, least, i, length(pieces[i]) AS gap, length(matches[i]) AS n, length(coalesce(vals, matches)[i]) AS v
  FROM (SELECT *, unnest(range(1, len(matches) + 1)) AS i FROM raw)
), placed AS (
  SELECT row, CASE WHEN kind = 0 AND v < 12 THEN 3 ELSE kind END AS kind, v,
    CASE WHEN kind = 0 AND v < 12 THEN 4 ELSE least END AS least, n,
    sum(gap + n) OVER (PARTITION BY row, kind ORDER BY i) AS "end"
  FROM one
), spans AS (
  SELECT row, kind, "end" - n AS start, "end" FROM placed WHERE v >= least
), linked AS (
  SELECT s.*, kind <= 2 OR EXISTS (
    SELECT 1 FROM spans o WHERE o.row = s.row AND abs(o.start - s.start) <= 200
      AND CASE WHEN s.kind = 3 THEN o.kind IN (1, 4, 5) ELSE o.kind IN (0, 2, 3) END) AS reported
  FROM spans s
), said AS (
  SELECT row, kind, start, (['assign', 'access', 'hex', 'short_assign', 'user', 'endpoint'])[kind + 1] || ':' || start::BIGINT || ':' || "end"::BIGINT AS said
  FROM linked WHERE reported
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind) FILTER (kind <= 2), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, kind), '') AS spans
FROM texts LEFT JOIN said USING (row) GROUP BY row, doc_id
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, the base rule and the verdict of risk-controlled cutoffs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.judged(documents(spark, sf_dir), labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles."""
    return jaccard.link(documents(spark, sf_dir))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
    JOIN sizes p ON p.doc_id = x.doc_id JOIN sizes q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.other
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes USING (doc_id)
  JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; learned outside the held-out quarter."""
    docs = documents(spark, sf_dir)
    samples = langid.training_texts(docs.where(~is_held_out()))
    rows = docs.select("doc_id", "text", is_held_out().alias("held_out"))
    return langid.identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 512 to 4096 tokens."""
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every text, with matched coverage and span."""
    return licenses.scan(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text; learned outside the held-out quarter."""
    stats = written(textstats.statistics(documents(spark, sf_dir)), "stats")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~is_held_out())
    scored = ruleclf.scored(stats, ruleclf.fit(stats, labels))
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def op11_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as directly addressable codes, and each one's span read back from the files."""
    import public_tokenizers

    path = shared_path(spark, "codes")
    tokencodes.write_codes(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), path)
    return tokencodes.spans(spark, path)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every two sources of a language, and the terms that set each source apart."""
    return divergence.audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM texts
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM texts) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.total + 2 * v) AS p,
    1 + (1000000000 * (k.n + 2)::HUGEINT) // (s.total + 2 * v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return prefixtrie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, strlen(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS i FROM said
), convs AS ( -- h is crc32 of the decimal id, bit by bit, modulo 9
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), parts AS (
  SELECT c.conv_id, t.i, t.said, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 8 + t.i, t.said, t.size FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, said, size FROM parts
), prefixes AS (
  SELECT conv_id, d, size, sha256(string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY d)) AS node FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT node, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM prefixes GROUP BY node
), edges AS (
  SELECT DISTINCT c.node, p.node AS parent FROM prefixes c JOIN prefixes p ON p.conv_id = c.conv_id AND p.d = c.d - 1
), kids AS (
  SELECT parent AS node, count(*) AS k FROM edges GROUP BY parent
), sums AS (
  SELECT a.node, sum((n.n - 1) * n.size) AS saved, count(*) FILTER (k.k IS NULL) AS leaves
  FROM nodes n JOIN prefixes a ON a.conv_id = n.conv_id AND a.d <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY a.node
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM prefixes JOIN (SELECT conv_id, max(d) AS d FROM prefixes GROUP BY conv_id) USING (conv_id, d) GROUP BY node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node)
  LEFT JOIN edges e ON e.node = n.node LEFT JOIN nodes p ON p.node = e.parent
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_media_columns": op2_media_columns,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_license_scan": op8_license_scan,
    "op9_source_mix": op9_source_mix,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_token_codes": op11_token_codes,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_chat_format": OP1_SQL,
    "op3_secret_scan": OP3_SQL,
    "op5_ngram_jaccard_join": OP5_SQL,
    "op12_source_divergence": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
