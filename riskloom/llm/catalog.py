"""The registered queries of the operators, their SQL, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import (
    brown, decontam, divergence, lines, merkle, mixing, neardup, packing, pages, quality, search, toolchat, toxicity,
)
from riskloom.session import table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


SEARCH_SQL = r"""
WITH words AS (
  SELECT doc_id, [x for x in string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+') if x <> ''] AS ws FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS w FROM words) GROUP BY ALL),
size AS (SELECT doc_id, len(ws) AS dl FROM words),
stat AS (SELECT count(*) AS n, sum(dl) / count(*) AS mean FROM size),
idf AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stat GROUP BY w, n),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id,
         round(sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM tf q JOIN tf d ON q.w = d.w JOIN idf ON idf.w = q.w JOIN size ON size.doc_id = d.doc_id, stat
  WHERE q.doc_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 10
"""


@query("op1_topk_search", SEARCH_SQL)
def op1_topk_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, search.stated_queries(docs))


LINES_SQL = r"""
WITH line AS (
  SELECT doc_id, i AS pos, l AS line,
         translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
dup AS (SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10
        GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT line.*, dup.key IS NOT NULL AND line.doc_id <> dup.first AS gone
           FROM line LEFT JOIN dup ON line.key = dup.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", LINES_SQL)
def op3_line_dedup(spark, sf_dir):
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_quality_rules")
def op7_quality_rules(spark, sf_dir):
    found = quality.judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                        "n_repeat_words", "base_failed", "kept",
                        *[f"cover_{n}" for n in quality.NGRAM_LIMITS],
                        "n_lines", "dup_line_chars")


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op5_source_mixing", mixing.oracle_sql())
def op5_source_mixing(spark, sf_dir):
    return mixing.place(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query("op8_bag_minhash_near_dedup")
def op8_bag_minhash_near_dedup(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query("op2_html_extraction")
def op2_html_extraction(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_brown_lm")
def op6_brown_lm(spark, sf_dir):
    return brown.score(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH RECURSIVE msg AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
call AS (
  SELECT u.conv_id, u.turn, 'c' || u.conv_id || '-' || u.turn AS call_id,
         CASE WHEN u.turn < 2 THEN 'ask' ELSE 'follow_up' END AS name, u.text, a.text AS result, a.turn AS answered,
         len([x for x in string_split_regex(u.text, '[\x20\x09-\x0D]+') if x <> '']) AS words,
         CASE WHEN u.turn < 2 THEN 60 ELSE 40 END AS most, u.turn // 2 % 4 AS topic, u.conv_id % 8 = 0 AS ring
  FROM msg u LEFT JOIN msg a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user'),
edge AS (
  SELECT c.call_id, c.conv_id, c.turn, n.call_id AS need, n.turn AS need_turn, n.turn IS NULL AS lost
  FROM (SELECT *, turn + CASE WHEN topic = 1 THEN 2 WHEN topic = 3 OR ring THEN -2 ELSE -4 END AS at FROM call WHERE topic > 0) c
  LEFT JOIN call n ON n.conv_id = c.conv_id AND n.turn = c.at),
near AS (  -- every call that a call needs, directly or not, along moved ones
  SELECT call_id, turn, need, need_turn FROM edge WHERE NOT lost),
reach AS (
  SELECT call_id, turn, need, need_turn FROM near
  UNION SELECT r.call_id, r.turn, n.need, n.need_turn FROM reach r JOIN near n ON n.call_id = r.need),
loops AS (SELECT call_id FROM reach WHERE call_id = need),
behind AS (SELECT call_id FROM loops UNION SELECT r.call_id FROM reach r JOIN loops l ON l.call_id = r.need),
spot AS (
  SELECT c.conv_id, c.turn, c.call_id, b.call_id IS NOT NULL AS late,
         CASE WHEN b.call_id IS NULL THEN greatest(c.turn, max(r.need_turn)) END AS place FROM call c
  LEFT JOIN reach r ON r.call_id = c.call_id LEFT JOIN behind b ON b.call_id = c.call_id
  GROUP BY c.conv_id, c.turn, c.call_id, b.call_id),
cut AS (  -- a cycle is two calls here, the earlier is freed
  SELECT x.call_id FROM loops l JOIN near x ON x.call_id = l.call_id WHERE x.turn < x.need_turn),
wait AS (
  SELECT call_id, 0 AS round FROM spot WHERE NOT late OR call_id IN (FROM cut)
  UNION ALL
  SELECT n.call_id, w.round + 1 FROM wait w JOIN near n ON n.need = w.call_id
  JOIN spot s ON s.call_id = n.call_id JOIN spot t ON t.call_id = n.need
  WHERE s.place IS NOT DISTINCT FROM t.place AND n.call_id NOT IN (FROM cut)),
sorted AS (
  SELECT s.conv_id, s.call_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY late, place, max(round), s.turn) AS nth
  FROM spot s JOIN wait w ON w.call_id = s.call_id GROUP BY s.conv_id, s.call_id, s.turn, late, place),
moved AS (
  SELECT s.call_id, t.turn AS order_turn FROM sorted s JOIN
  (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM call) t
  ON t.conv_id = s.conv_id AND t.nth = s.nth),
checked AS (
  SELECT c.*, order_turn, concat_ws('; ',
    CASE WHEN text = '' THEN '$.text: shorter than minLength' END,
    CASE WHEN words < 1 THEN '$.words: below minimum' WHEN words > most THEN '$.words: above maximum' END,
    CASE WHEN c.call_id IN (FROM cut) THEN 'dependency: cycle' END,
    CASE WHEN lost THEN 'dependency: unknown id' END) AS errors,
    CASE WHEN answered IS NULL THEN 'unanswered' ELSE 'linked' END AS status
  FROM call c JOIN moved m ON m.call_id = c.call_id LEFT JOIN edge e ON e.call_id = c.call_id)
SELECT conv_id, order_turn * 1048576 AS order_at, 'call' AS kind, call_id, name, status, errors = '' AS valid, errors,
       '{"arguments":{"text":' || to_json(text) || ',"words":' || words || '},"id":' || to_json(call_id) ||
       ',"name":"' || name || '","result":' || coalesce(to_json(result)::VARCHAR, 'null') || ',"status":"' ||
       status || '"}' AS json
FROM checked
UNION ALL
SELECT conv_id, turn * 1048576, 'message', NULL, NULL, 'message', true, '',
       '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}'
FROM msg WHERE role NOT IN ('user', 'assistant')
UNION ALL
SELECT a.conv_id, a.turn * 1048576, 'result', 'c' || a.conv_id || '-' || (a.turn - 1), NULL, 'orphan', false, '',
       '{"id":' || to_json('c' || a.conv_id || '-' || (a.turn - 1)) || ',"result":' || to_json(a.text) || '}'
FROM msg a LEFT JOIN msg u ON u.role = 'user' AND u.conv_id = a.conv_id AND u.turn = a.turn - 1
WHERE a.role = 'assistant' AND u.turn IS NULL
"""


@query("op10_tool_call_linking", CHAT_SQL)
def op10_tool_call_linking(spark, sf_dir):
    return toolchat.format_chat(toolchat.trace(table(spark, sf_dir, "conversations")))


DIVERGENCE_SQL = r"""
WITH doc AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
word AS (SELECT lang, source, d, unnest(ws) AS w FROM doc),
kept AS (SELECT lang, w, count(*) AS nl FROM word GROUP BY lang, w HAVING count(DISTINCT d) >= 3),
hold AS (SELECT lang, source, w, count(*) AS n FROM word JOIN kept USING (lang, w) GROUP BY ALL),
whole AS (SELECT lang, sum(nl)::HUGEINT AS nl, count(*) AS v FROM kept GROUP BY lang),
part AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM hold GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
given AS (
  SELECT g.lang, g.source, k.w, coalesce(h.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(h.n, 0) + 1) // (coalesce(p.n, 0) + t.v) AS p,
         1 + 1000000000::HUGEINT * (k.nl + 1) // (t.nl + t.v) AS q
  FROM grp g JOIN kept k ON k.lang = g.lang JOIN whole t ON t.lang = g.lang
  LEFT JOIN part p ON p.lang = g.lang AND p.source = g.source
  LEFT JOIN hold h ON h.lang = g.lang AND h.source = g.source AND h.w = k.w),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM given x JOIN given y ON x.lang = y.lang AND x.w = y.w AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (SELECT lang, source, w AS item, (p - q) * (p - q) // q AS value FROM given WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL
  SELECT lang, source, 'term', item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""


@query("op11_source_divergence_audit", DIVERGENCE_SQL)
def op11_source_divergence_audit(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


DECONTAM_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT item_id, ws, least(len(ws), 10) AS l FROM (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS t
        FROM (SELECT *, unnest(range(1, len(ws) - l + 2)) AS i FROM iw)),
gram AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS t
         FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM dw, (SELECT DISTINCT l FROM win))),
occ AS (SELECT DISTINCT doc_id, i, l, item_id FROM gram JOIN win USING (l, t)),
hit AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS w FROM occ) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
         FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit ON hit.doc_id = dw.doc_id LEFT JOIN held ON held.doc_id = dw.doc_id
"""


@query("op12_benchmark_decontamination", DECONTAM_SQL)
def op12_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


MERKLE_SQL = r"""
WITH RECURSIVE told AS (
  SELECT doc_id, source, text,
         CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END ||
         CASE WHEN source IS NULL THEN '-' ELSE strlen(source::VARCHAR) || ':' || source::VARCHAR END ||
         CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang::VARCHAR) || ':' || lang::VARCHAR END ||
         CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR END AS head,
         xor(list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT for x in string_split(doc_id::VARCHAR, '')],
             lambda acc, b: list_reduce([xor(acc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                        lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295) AS crc
  FROM documents),
hashed AS (
  SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text::VARCHAR) || ':' || text::VARCHAR END) AS leaf,
         CASE WHEN crc % 5 = 0 THEN sha256(head || CASE WHEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IS NULL THEN '-' ELSE strlen(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR END) END AS probe
  FROM told),
leaf AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s
  FROM hashed),
low AS (
  SELECT 0 AS lvl, s, i, leaf AS h, n FROM leaf
  UNION ALL
  SELECT lvl + 1, s, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM low WHERE n > 1 GROUP BY lvl, s, i // 16),
sub AS (SELECT s, h FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lvl, s AS i, h, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT lvl + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 15) // 16
  FROM high WHERE n > 1 GROUP BY lvl, i // 16),
node AS (SELECT lvl, s, i, h FROM low WHERE n > 1 UNION ALL SELECT 100 + lvl, -1, i, h FROM high WHERE n > 1),
side AS (
  SELECT a.lvl, a.s, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM node a JOIN node b ON a.lvl = b.lvl AND a.s = b.s AND a.i // 16 = b.i // 16 GROUP BY a.lvl, a.s, a.i),
step AS (
  SELECT leaf.s, leaf.i, lvl, l, r FROM leaf JOIN side
    ON lvl < 100 AND side.s = leaf.s AND side.i = leaf.i // (1::BIGINT << (4 * lvl)::BIGINT)
  UNION ALL
  SELECT leaf.s, leaf.i, lvl, l, r FROM leaf JOIN side
    ON lvl >= 100 AND side.i = leaf.s // (1::BIGINT << (4 * (lvl - 100))::BIGINT)),
path AS (SELECT s, i, string_agg(l || r, '' ORDER BY lvl) AS proof, list([l, r] ORDER BY lvl) AS steps
         FROM step GROUP BY s, i),
folded AS (
  SELECT doc_id, leaf, sub.h AS subroot, (SELECT h FROM high WHERE n = 1) AS root,
         sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce([[coalesce(probe, leaf), '']] || coalesce(steps, []),
                     lambda acc, x: [sha256(x[1] || acc[1] || x[2]), ''])[1] AS folded_root
  FROM leaf JOIN sub ON sub.s = leaf.s LEFT JOIN path ON path.s = leaf.s AND path.i = leaf.i)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
