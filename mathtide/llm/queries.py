"""The registered queries of this subpackage and their DuckDB restatements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mathtide.llm import conversations, decontaminate, lm, merkle, mixing, packing, quality_classifier, quality_rules, \
    secrets, sharding, simhash, token_output, toxicity
from mathtide.llm.common import table


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.materialise(table(spark, sf_dir, "documents")).drop("path")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf_dir, "conversations")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(table(spark, sf_dir, "documents"))


def op13_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_secrets": op2_secrets,
    "op3_simhash_groups": op3_simhash_groups,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_shards": op7_shards,
    "op8_lm_scores": op8_lm_scores,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_repair_conversations": op11_repair_conversations,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_pack_sequences": op13_pack_sequences,
}

OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE
         ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap
  FROM s),
levels AS (   -- every source as the first that is not held at its cap
  SELECT a.source, a.cap / a.w AS ratio,
         ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE
          - coalesce((SELECT sum(b.cap) FROM r b WHERE b.cap / b.w < a.cap / a.w), 0.0::DOUBLE))
         / (SELECT sum(b.w) FROM r b WHERE b.cap / b.w >= a.cap / a.w) AS level
  FROM r a),
chosen AS (SELECT min(ratio) AS first_ratio, arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN c.level IS NULL OR r.cap / r.w < c.level THEN r.cap ELSE r.w * c.level END AS target
  FROM r CROSS JOIN chosen c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * epochs + least(size, greatest(0, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""

# crc32 of an ASCII text ``id``, bit by bit
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(list_filter(string_split(id, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
        lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

OP11_SQL = r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id,
         coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, CASE WHEN conv_id IS NULL THEN 'n' ELSE 'v' || conv_id END AS g
  FROM conversations),
drawn AS (SELECT *, {crc} % 20 AS kind FROM raw),
damaged AS (
  SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, (VALUES (0), (1)) AS copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
rows AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, sha256(role || chr(0) || text)) - 1 AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed
  FROM damaged),
faults AS (
  SELECT *, trimmed = '' AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AND trimmed <> '' AS duplicate,
         left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY i) AS earlier
  FROM rows),
turns AS (SELECT *, NOT blank AND NOT duplicate AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated FROM faults),
step(p, letter, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(p, q, audit, lines) AS (
  SELECT p, p, '', []::VARCHAR[] FROM range(4) AS places(p)
  UNION ALL VALUES (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']),
                   (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:'])),
edits(edit, cost, letter, becomes) AS (VALUES ('K', 0, NULL, NULL), ('R', 1, 'u', 'user'), ('R', 1, 'a', 'assistant')),
moves AS (      -- what an edit of a turn does at a place, closed under insertions behind it
  SELECT t.g, t.i, s.p, n.q, e.cost + CASE WHEN t.truncated THEN 5 ELSE 0 END + 5 * length(n.audit) AS cost,
         e.edit || n.audit AS audit, [coalesce(e.becomes, t.role) || ':' || t.text] || n.lines AS lines
  FROM turns t CROSS JOIN edits e JOIN step s ON s.letter = coalesce(e.letter, t.initial) JOIN inserted n ON n.p = s.q
  WHERE NOT t.blank AND NOT t.duplicate
  UNION ALL
  SELECT t.g, t.i, n.p, n.q, 2 + 5 * length(n.audit), 'D' || n.audit, n.lines FROM turns t CROSS JOIN inserted n),
walk(g, i, p, best) AS (
  SELECT g, 0::BIGINT, q, {'cost': CAST(5 * length(audit) AS BIGINT), 'audit': audit, 'lines': lines}
  FROM (SELECT DISTINCT g FROM turns) CROSS JOIN inserted WHERE p = 0
  UNION ALL
  SELECT w.g, w.i + 1, m.q, min({'cost': CAST(w.best.cost + m.cost AS BIGINT), 'audit': w.best.audit || m.audit,
                                 'lines': w.best.lines || m.lines})
  FROM walk w JOIN moves m ON m.g = w.g AND m.i = w.i AND m.p = w.p GROUP BY w.g, w.i, m.q),
sums AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY g),
done AS (SELECT w.g, min(w.best) AS best FROM walk w JOIN sums s ON s.g = w.g AND s.n = w.i WHERE w.p IN (0, 3) GROUP BY w.g)
SELECT r.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(s.blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(s.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(s.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(d.best.cost, 0) AS BIGINT) AS cost,
       coalesce(d.best.audit, '') AS audit, sha256(coalesce(array_to_string(d.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM raw) r LEFT JOIN sums s ON s.g = r.g LEFT JOIN done d ON d.g = r.g
""".replace("{crc}", CRC32)

OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 'v' || source END AS g,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
         text, replace(text, chr(10), '') AS bare, coalesce(CAST(doc_id AS VARCHAR), '') AS id
  FROM documents),
leaves AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN {crc} % 2 = 0 THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-'))
              ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS checked
  FROM d),
ranked AS (
  SELECT doc_id, g, leaf, checked, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS place, count(*) OVER (PARTITION BY g) AS n
  FROM leaves),
nodes(g, level, i, n, digest) AS (
  SELECT g, 0, i, n, leaf FROM ranked
  UNION ALL
  SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM nodes
  WHERE n > 1 GROUP BY g, level, i // 3, n),
subroots AS (
  SELECT g, level AS height, digest, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper(level, i, n, digest) AS (
  SELECT 0, i, n, digest FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY i)) FROM upper
  WHERE n > 1 GROUP BY level, i // 3, n),
runs AS (
  SELECT g, level, i // 3 AS parent, list(digest ORDER BY i) AS run FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', level, i // 3, list(digest ORDER BY i) FROM upper WHERE n > 1 GROUP BY ALL),
-- a leaf climbs through its source's tree, then through the tree of subroots
climb(doc_id, place, leaf, g, tree, level, i, folded, proof) AS (
  SELECT doc_id, place, leaf, g, g, 0, i, checked, '' FROM ranked
  UNION ALL
  SELECT c.doc_id, c.place, c.leaf, c.g, CASE WHEN r.run IS NULL THEN '' ELSE c.tree END,
         CASE WHEN r.run IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN r.run IS NULL THEN s.i ELSE c.i // 3 END,
         CASE WHEN r.run IS NULL THEN c.folded ELSE sha256(array_to_string(r.run[:c.i % 3] || [c.folded] || r.run[c.i % 3 + 2:], '')) END,
         CASE WHEN r.run IS NULL THEN c.proof ELSE c.proof || array_to_string(r.run[:c.i % 3] || r.run[c.i % 3 + 2:], '') END
  FROM climb c LEFT JOIN runs r ON r.g = c.tree AND r.level = c.level AND r.parent = c.i // 3
  LEFT JOIN subroots s ON s.g = c.g AND c.tree <> ''
  WHERE r.run IS NOT NULL OR c.tree <> ''),
tops AS (SELECT doc_id, place, leaf, g, arg_max(folded, (tree = '', level)) AS folded,
                arg_max(proof, (tree = '', level)) AS proof
         FROM climb GROUP BY ALL)
SELECT t.doc_id, t.leaf, s.digest AS subroot, u.digest AS root, sha256(t.proof) AS proof_sha256,
       t.folded AS folded_root, t.folded = u.digest AS verified
FROM tops t JOIN subroots s ON s.g = t.g CROSS JOIN (SELECT digest FROM upper WHERE n = 1) u
""".replace("{crc}", CRC32)

ORACLE = {"op4_mix_sources": OP4_SQL, "op11_repair_conversations": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
