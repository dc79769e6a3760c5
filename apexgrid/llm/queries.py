"""One query per operator, over its whole table, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import query, table
from .decontaminate import leaks
from .fingerprints import neighbour_fingerprints
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .line_dedup import line_report
from .packing import pack
from .quality import quality_scores
from .secrets import digest_columns, scan_secrets
from .token_shards import read_sequences, write_shards
from .url_filter import judge_urls

#: Files of the public tokenizers; end tokens are the contracts'.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2

_LINES_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM s)),
k AS (SELECT doc_id, line_no, doc_id * 100000000 + line_no AS place,
             string_split(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS w FROM l),
c AS (SELECT w, len(w) AS n, min(place) AS place FROM k WHERE len(w) >= 5 GROUP BY w),
v AS (SELECT place, n, a, list_concat(w[1:a - 1], w[a + 1:]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS a FROM c)),
g AS (SELECT rest, n, a, min(place) AS first FROM v GROUP BY ALL HAVING count(*) > 1),
gone AS (SELECT v.place FROM v JOIN g ON v.rest = g.rest AND v.n = g.n AND v.a = g.a WHERE v.place > g.first
         UNION SELECT greatest(v.place, c.place) FROM v JOIN c ON v.rest = c.w),
r AS (SELECT doc_id, count(*) AS n, string_agg(cast(line_no AS varchar), ',' ORDER BY line_no) AS removed FROM k
      WHERE len(w) >= 5 AND (place NOT IN (SELECT place FROM c) OR place IN (SELECT place FROM gone)) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN r USING (doc_id)
"""


@query("op2_line_dedup", _LINES_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


_EVERY_LINE_SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM s)),
k AS (SELECT * FROM (SELECT doc_id, line_no, doc_id * 100000000 + line_no AS place,
             string_split(trim(regexp_replace(line, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS w FROM l) WHERE w <> ['']),
a AS (SELECT w, len(w) AS n, min(place) AS place FROM k GROUP BY w),
c AS (SELECT * FROM a WHERE n >= 5),
v AS (SELECT place, n, a, list_concat(w[1:a - 1], w[a + 1:]) AS rest FROM (SELECT *, unnest(range(1, n + 1)) AS a FROM c)),
g AS (SELECT rest, n, a, min(place) AS first FROM v GROUP BY ALL HAVING count(*) > 1),
gone AS (SELECT v.place FROM v JOIN g ON v.rest = g.rest AND v.n = g.n AND v.a = g.a WHERE v.place > g.first
         UNION SELECT greatest(v.place, c.place) FROM v JOIN c ON v.rest = c.w),
r AS (SELECT doc_id, count(*) AS n, string_agg(cast(line_no AS varchar), ',' ORDER BY line_no) AS removed FROM k
      WHERE place NOT IN (SELECT place FROM a) OR place IN (SELECT place FROM gone) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(r.n, 0) AS n_removed, coalesce(r.removed, '') AS removed
FROM documents d LEFT JOIN r USING (doc_id)
"""


@query("op2_line_dedup_every_line", _EVERY_LINE_SQL)
def op2_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of every line that is not blank; edits from five words on."""
    return line_report(table(spark, sf_dir, "documents"), exact_words=1)


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids."""
    return pack(docs, WORD_BPE, END_ID).withColumn("ids_crc32", F.crc32("ids")) \
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


_LEAKS_SQL = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM t),
s AS (SELECT DISTINCT side, id, w[i:i + least(4, len(w) - 1)] AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n_item, count(*) AS n_shared, count(*)::double / n_item AS containment
FROM s b JOIN s d ON b.g = d.g AND d.side = 'd' JOIN n ON n.id = b.id WHERE b.side = 'b'
GROUP BY d.id, b.id, n_item HAVING 100 * count(*) >= 75 * n_item
"""


@query("op8_benchmark_decontamination", _LEAKS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_quality_classifier")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "p_quality", "p_toxic", "keep")


@query("op1_secret_scan")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest_columns(scan_secrets(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query("op3_document_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


@query("op5_token_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = write_shards(table(spark, sf_dir, "documents"), WORD_BPE, END_ID, key=20240607)
    return read_sequences(spark, folder).select("slot", "shard", "offset", F.col("n_tokens").cast("long").alias("n_tokens"),
                                                F.array_join("docs", ",").alias("doc_ids"), F.crc32("record").alias("record_crc32"))


# fixed values: the rules, as (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: What decides where no rule fits: hosts by a label, and a path.
BLOCKED = ["*casino*/**", "*adult-*/**", "*free-bets*/**", "*spam-farm*/**", "*cheap-pills*/**", "*ads-track*/**", "*casino*", "*adult-*", "*free-bets*",
           "*spam-farm*", "*cheap-pills*", "*ads-track*", "**/ads/**", "**.exe"]

_URL_SQL = r"""
WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_extract(substr(url, position('://' IN url) + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN position('/' IN rest) > 0 THEN substr(rest, position('/' IN rest)) ELSE '' END AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM p)),
r(verdict, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(m.verdict, CASE WHEN regexp_matches(host, 'casino|adult-|free-bets|spam-farm|cheap-pills|ads-track')
       OR position('/ads/' IN path) > 0 OR ends_with(host || path, '.exe') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""


@query("op7_url_filter", _URL_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, BLOCKED).select("page_id", "host", "path", "rule", "verdict")


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
