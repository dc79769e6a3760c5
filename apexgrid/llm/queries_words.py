"""Queries of operators 11 to 13, over their whole tables with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import query, table
from .personal import digest_columns, personal_spans
from .repair import damaged, repair_conversations
from .spelling import spelling_groups

#: CRC-32 in SQL: the table of the polynomial, and the checksum of the hexadecimal digits ``x`` of some bytes.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)
    ORDER BY i) AS t FROM range(256) r(i))"""
CRC = """xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda j:
    (instr('0123456789ABCDEF', x[j]) - 1) * 16 + instr('0123456789ABCDEF', x[j + 1]) - 1), lambda c, v: xor(c >> 8, t[1 + (xor(c, v) & 255)]), 4294967295))"""

_SPELLING_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
l AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT run, count(*) AS n, hex(encode(coalesce(cast(doc_id AS varchar), '') || ':' || run)) AS x FROM l WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, n, {CRC} AS h FROM g, crc_table),
w AS (SELECT word, cast(sum(n) AS bigint) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT word AS a, d AS b FROM v WHERE d IN (SELECT word FROM w) UNION SELECT d, word FROM v WHERE d IN (SELECT word FROM w)
      UNION SELECT v.word, o.word FROM v JOIN v o ON v.i = o.i AND v.d = o.d AND v.word <> o.word),
b AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM p JOIN w ON w.word = p.b GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, form AS at FROM f WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL),
r AS (SELECT c.word, c.at AS root FROM c JOIN f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, coalesce(root, word) AS root FROM f LEFT JOIN r USING (word)
"""


@query("op11_spelling_groups", _SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


@query("op12_personal_data")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(personal_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


_REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             hex(encode(coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' '))) AS x FROM conversations),
h AS (SELECT conv_id, turn, role, text, {CRC} % 20 AS harm FROM k, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN harm = 1 THEN '' WHEN harm = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy
      FROM h WHERE harm <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS said,
             regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS body FROM d),
r AS (SELECT conv_id, turn, role, text, i, CASE WHEN body = '' THEN 'blank' WHEN said > 1 THEN 'duplicate' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
             left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM o),
jump(b, e, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 5, 'I'), (1, 2, 5, 'I'), (3, 2, 5, 'I'), (2, 3, 5, 'I'), (0, 3, 10, 'II'), (1, 3, 10, 'II')),
move(b, e, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
ins AS (SELECT b, e, cost, audit, CASE WHEN audit = '' THEN [] WHEN audit = 'II' THEN ['user:', 'assistant:'] WHEN e = 2 THEN ['user:'] ELSE ['assistant:'] END AS lines FROM jump),
dp AS (SELECT conv_id, cast(0 AS bigint) AS i, 0 AS state, {{'cost': 0, 'audit': '', 'lines': cast([] AS varchar[])}} AS best FROM (SELECT DISTINCT conv_id FROM r)
       UNION ALL
       SELECT conv_id, i, state, min(best) FROM (
           SELECT dp.conv_id, r.i, ins.e AS state, {{'cost': dp.best.cost + ins.cost + 2, 'audit': dp.best.audit || ins.audit || 'D', 'lines': list_concat(dp.best.lines, ins.lines)}} AS best
           FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.i = dp.i + 1 JOIN ins ON ins.b = dp.state
           UNION ALL
           SELECT dp.conv_id, r.i, move.e, {{'cost': dp.best.cost + ins.cost + CASE WHEN move.initial = r.initial THEN 0 ELSE 1 END + CASE WHEN r.fault = 'truncated' THEN 5 ELSE 0 END,
                  'audit': dp.best.audit || ins.audit || CASE WHEN move.initial = r.initial THEN 'K' ELSE 'R' END,
                  'lines': list_concat(dp.best.lines, ins.lines, [CASE WHEN move.initial = r.initial THEN r.role WHEN move.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text])}}
           FROM dp JOIN r ON r.conv_id = dp.conv_id AND r.i = dp.i + 1 AND r.fault NOT IN ('blank', 'duplicate')
                JOIN ins ON ins.b = dp.state JOIN move ON move.b = ins.e AND (move.initial <> 's' OR r.initial = 's')) GROUP BY conv_id, i, state),
done AS (SELECT conv_id, min({{'cost': best.cost + ins.cost, 'audit': best.audit || ins.audit, 'lines': list_concat(best.lines, ins.lines)}}) AS best
         FROM dp JOIN (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id) USING (conv_id, i) JOIN ins ON ins.b = state AND ins.e IN (0, 3) GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cast(coalesce(best.cost, 0) AS bigint) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s USING (conv_id) LEFT JOIN done USING (conv_id)
"""


@query("op13_conversation_repair", _REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
