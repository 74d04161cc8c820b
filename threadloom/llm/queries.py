"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, conversation_repair, exact_dedup, jaccard_join, packing, passages, permutation_index, quality, secret_scan, simhash, source_audit, urls
from .common import save, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_digest(packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats_digest(passages.remove_repeats(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("row_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digest(bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role")) for k, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(said)).select(F.lit(-1).alias("conv_id"), "turn", "role", F.lit(probe).alias("text")).to(turns.schema)
    return chat.conversation_digest(chat.prefix_target_examples(turns.unionByName(extra)))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence_audit(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_audit(save(conversation_repair.damage(turns), "damaged"), turns)


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"), words=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_repeats": op4_repeats,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_url_filters": op8_url_filters,
    "op9_bpe": op9_bpe,
    "op10_chat_format": op10_chat_format,
    "op11_source_audit": op11_source_audit,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op5_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

_ESC = "replace(replace(replace(replace({}, '\\', '\\s'), '<', '\\l'), '[', '\\b'), '|', '\\p')"
ORACLE_SQL["op10_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length({_ESC.format('role')}) + length({_ESC.format('text')}) + 8 AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM t),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_RULES = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in _RULES]
ORACLE_SQL["op8_url_filters"] = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
j AS (
  SELECT *, CASE {" ".join(f"WHEN {fits} THEN '{rule}'" for fits, rule, _ in _FITS)} END AS rule,
         CASE {" ".join(f"WHEN {fits} THEN {int(v == 'block')}" for fits, _, v in _FITS)} END AS label,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
           CASE WHEN length(s) > 40 OR length(s) - length(replace(s, '-', '')) >= 3 THEN '{{v}}'
                ELSE regexp_replace(regexp_replace(s, '[0-9a-f]{{12,}}', '{{h}}', 'g'), '[0-9]+', '{{n}}', 'g') END) AS template
  FROM u),
leaves AS (SELECT host, template, count(label)::DOUBLE AS n, coalesce(sum(label), 0)::DOUBLE AS b FROM j GROUP BY ALL),
levels AS (SELECT *, unnest(range(0, len(template) + 1)) AS level FROM leaves),
steps AS (
  SELECT *, array_to_string(template[1:level], '/') AS node,
         CASE WHEN level > 0 THEN array_to_string(template[1:level - 1], '/') END AS parent
  FROM levels),
nodes AS (SELECT host, node, parent, sum(n) AS n, sum(b) AS b FROM steps GROUP BY ALL),
p AS (SELECT host, node AS parent, (b + {urls.WEIGHT}::DOUBLE * 0.5::DOUBLE) / (n + {urls.WEIGHT}::DOUBLE) AS p FROM nodes),
judged AS (
  SELECT host, node, abs(b - n * p) > {urls.BOUND}::DOUBLE * sqrt(n * p * (1 - p)) AS apart FROM nodes JOIN p USING (host, parent)),
branches AS (
  SELECT host, template, string_agg(CASE WHEN apart THEN template[level] ELSE '*' END, '/' ORDER BY level) AS branch
  FROM steps JOIN judged USING (host, node) WHERE level > 0 GROUP BY ALL),
tree AS (SELECT leaves.*, coalesce(branch, '') AS branch FROM leaves LEFT JOIN branches USING (host, template)),
overall AS (SELECT (coalesce(sum(b), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS o FROM leaves),
hosts AS (SELECT host, (sum(b) + {urls.WEIGHT}::DOUBLE * any_value(o)) / (sum(n) + {urls.WEIGHT}::DOUBLE) AS h FROM tree, overall GROUP BY host),
ends AS (
  SELECT host, branch, (sum(b) + {urls.WEIGHT}::DOUBLE * any_value(h)) / (sum(n) + {urls.WEIGHT}::DOUBLE) AS purity
  FROM tree JOIN hosts USING (host) GROUP BY host, branch)
SELECT page_id, host, path, rule,
       CASE WHEN coalesce(label, (purity >= {urls.REJECT_FROM}::DOUBLE)::INT) = 1 THEN 'block' ELSE 'allow' END AS verdict
FROM j JOIN tree USING (host, template) JOIN ends USING (host, branch)
"""

#: Terms, kept terms, shares of groups (p) and languages (q), both by way of every kept term for every group.
ORACLE_SQL["op11_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms
  FROM documents),
t AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
groups AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
full_ AS (SELECT lang, source, term, coalesce(own.n, 0) AS n, kept.n AS n_lang FROM groups JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n) AS total FROM full_ GROUP BY lang, source),
p AS (
  SELECT lang, source, term, f.n,
         1 + (1000000000::HUGEINT * (f.n + 5)) // (totals.total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (n_lang + 5)) // (v.total + 5 * v) AS q
  FROM full_ f JOIN totals USING (lang, source) JOIN v USING (lang)),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source AS sa, b.source AS sb, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
    GROUP BY ALL) x ON x.lang = a.lang AND x.sa = a.source AND x.sb = b.source
  GROUP BY ALL),
term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

#: After each turn, by the last retained role (r): the least (cost, audit) and the turns so far.
ORACLE_SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(2) copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i FROM damaged),
t AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
                 WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault,
         coalesce(lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
ins(r, x, added) AS (VALUES ('', 's', ''), ('', 'u', ''), ('', 'a', 'u'), ('s', 'u', ''), ('s', 'a', 'u'), ('u', 'u', 'a'), ('u', 'a', ''), ('a', 'u', ''), ('a', 'a', 'u')),
says(a, line) AS (VALUES ('', ''), ('u', chr(10) || 'user:'), ('a', chr(10) || 'assistant:'), ('ua', chr(10) || 'user:' || chr(10) || 'assistant:')),
walk AS (
  SELECT conv_id, 0::BIGINT AS pos, '' AS r, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS s FROM (SELECT DISTINCT conv_id FROM t)
  UNION ALL
  SELECT conv_id, pos, r, min(s) FROM (
    SELECT w.conv_id, t.pos, w.r, {'cost': s.cost + 4, 'audit': s.audit || 'D', 'said': s.said} AS s
    FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1
    UNION ALL
    SELECT w.conv_id, t.pos, ins.x, {
      'cost': s.cost + 3 * length(added) + CASE WHEN i = x THEN 0 ELSE 3 END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END,
      'audit': s.audit || repeat('I', length(added)) || CASE WHEN i = x THEN 'K' ELSE 'R' END,
      'said': s.said || line || chr(10) || CASE WHEN i = x THEN role WHEN x = 'u' THEN 'user' ELSE 'assistant' END || ':' || text}
    FROM walk w JOIN t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos + 1 JOIN ins ON ins.r = w.r JOIN says ON says.a = added
    WHERE (fault IS NULL OR fault = 'truncated') AND (x <> 's' OR i = 's')) GROUP BY conv_id, pos, r),
ends(r, added) AS (VALUES ('', ''), ('s', 'ua'), ('u', 'a'), ('a', '')),
done AS (
  SELECT conv_id, min({'cost': s.cost + 3 * length(added), 'audit': s.audit || repeat('I', length(added)), 'said': s.said || line}) AS s
  FROM walk JOIN (SELECT conv_id AS c, max(pos) AS n FROM t GROUP BY conv_id) ON c IS NOT DISTINCT FROM conv_id AND pos = n JOIN ends USING (r) JOIN says ON a = added
  GROUP BY conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM t GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(s.cost, 0) AS cost, coalesce(s.audit, '') AS audit, sha256(substr(coalesce(s.said, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id
"""
