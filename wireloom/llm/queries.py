"""Registered queries of this package and the SQL that DuckDB can run for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.llm import alignment, bpe, decontam, hamming, licenses, linedup, lmscore, neardup, personal, secrets, toxicity, variants, warc
from wireloom.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


@query("op8_bpe")
def op8(spark, sf_dir):
    return bpe.digests(bpe.encode(read(spark, sf_dir, "documents")))


DECONTAM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
lens AS (SELECT DISTINCT least(len(w), 10) AS m FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lens WHERE len(w) >= m)),
occ AS (SELECT dw.r, dw.i, dw.m, win.item FROM dw JOIN win ON dw.s = win.s AND dw.m = win.m),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""


@query("op10_decontamination", DECONTAM_SQL)
def op10(spark, sf_dir):
    return decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op6_licenses")
def op6(spark, sf_dir):
    return licenses.notice_report(read(spark, sf_dir, "documents"))


@query("op1_secrets")
def op1(spark, sf_dir):
    return secrets.secret_report(read(spark, sf_dir, "documents"))


WARC_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, url, html, md5(concat('response|', coalesce(CAST(page_id AS VARCHAR), ''), '|', coalesce(url, ''))) AS h,
  concat('HTTP/1.1 200 OK', chr(13), chr(10), 'Content-Type: text/html; charset=utf-8', chr(13), chr(10), 'Content-Length: ', strlen(html), chr(13), chr(10)) AS header FROM p),
s AS (SELECT *, concat('<urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32], '>') AS source_id,
  'sha256:' || sha256(header || chr(13) || chr(10) || html) AS block_d, 'sha256:' || sha256(html) AS payload_d,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<title\b.*?</title[^>]*>|<!--.*?-->|<![a-z][^>]*>', ' ', 'g'),
    '(?i)</?(p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|tr|table|thead|tbody|article|section|header|footer|nav|main|aside|body|html|head|blockquote|pre|form|figure)\b[^>]*>', chr(10), 'g'), '</?[A-Za-z][^>]*>', '', 'g') AS t0,
  trim(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title', 1), '[ \t\r\n\f]+', ' ', 'g')) AS title,
  regexp_extract(html, '(?i)<html\b[^>]*\blang=["'']?([A-Za-z-]+)', 1) AS language FROM r),
u AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t0, '&nbsp;', ' '), '&copy;', '©'), '&reg;', '®'), '&middot;', '·'), '&ndash;', '–'),
  '&mdash;', '—'), '&hellip;', '…'), '&laquo;', '«'), '&raquo;', '»'), '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS t1 FROM s),
v AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t1, '[ \t\r\f]+', ' ', 'g'), ' *\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') AS txt, md5('conversion|' || source_id) AS ch, md5('metadata|' || source_id) AS mh FROM u),
w AS (SELECT *, concat('<urn:uuid:', ch[1:8], '-', ch[9:12], '-', ch[13:16], '-', ch[17:20], '-', ch[21:32], '>') AS conv_id, concat('<urn:uuid:', mh[1:8], '-', mh[9:12], '-', mh[13:16], '-', mh[17:20], '-', mh[21:32], '>') AS meta_id, chr(13) || chr(10) AS nl FROM v),
x AS (SELECT *, concat('source-block-digest: ', block_d, nl, 'source-payload-digest: ', payload_d, nl, 'conversion-record-id: ', conv_id, nl, 'conversion-block-digest: sha256:', sha256(txt), nl, 'language: ', language, nl, 'title: ', title, nl, 'source-http-header:', nl, header) AS meta FROM w)
SELECT page_id, 'metadata' AS warc_type, meta_id AS record_id, source_id AS refers_to, url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date, 'application/warc-fields' AS content_type, CAST(strlen(meta) AS BIGINT) AS content_length, meta AS block, 'sha256:' || sha256(meta) AS block_digest, payload_d AS source_digest FROM x
UNION ALL
SELECT page_id, 'conversion', conv_id, source_id, url, '2024-01-01T00:00:00Z', 'text/plain; charset=utf-8', CAST(strlen(txt) AS BIGINT), txt, 'sha256:' || sha256(txt), payload_d FROM x
"""


@query("op7_warc", WARC_SQL)
def op7(spark, sf_dir):
    return warc.derivatives(warc.responses(read(spark, sf_dir, "pages")))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


HAMMING_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(range(1, 65), lambda i: coalesce(embedding[i] >= 0, false)) AS s FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
p AS (SELECT a.vec_id AS query_id, b.vec_id, min(CAST(len(list_filter(range(1, 65), lambda i: a.s[i] <> b.s[i])) AS INTEGER)) AS distance
      FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""


@query("op4_hamming_topk", HAMMING_SQL)
def op4(spark, sf_dir):
    return hamming.nearest(read(spark, sf_dir, "embeddings"))


LM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS t FROM documents),
tok AS (SELECT r, t, unnest(w) AS w FROM d), cnt AS (SELECT w, count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1 FROM tok GROUP BY w),
voc AS (SELECT w, n0, n1 FROM cnt),
ends AS (SELECT count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1 FROM d WHERE len(w) > 0),
tot AS (SELECT sum(n0) AS n0, sum(n1) AS n1 FROM cnt), uni AS (
  SELECT w, n0, n1 FROM voc UNION ALL SELECT '', n0, n1 FROM ends UNION ALL SELECT '?', tot.n0 - coalesce((SELECT sum(n0) FROM voc), 0), tot.n1 - coalesce((SELECT sum(n1) FROM voc), 0) FROM tot),
size AS (SELECT (SELECT n0 FROM tot) + (SELECT n0 FROM ends) AS m0, (SELECT n1 FROM tot) + (SELECT n1 FROM ends) AS m1, (SELECT count(*) FROM voc) + 2 AS v),
pos AS (SELECT r, t, i, CASE WHEN i = 0 OR i = len(w) + 1 THEN '' ELSE w[i] END AS x FROM (SELECT r, t, w, unnest(range(0, len(w) + 2)) AS i FROM d WHERE len(w) > 0)),
known AS (SELECT r, t, i, CASE WHEN x = '' THEN '' WHEN voc.w IS NULL THEN '?' ELSE x END AS x FROM pos LEFT JOIN voc ON pos.x = voc.w),
big AS (SELECT a.r, a.t, a.x AS v, b.x AS w FROM known a JOIN known b ON a.r = b.r AND b.i = a.i + 1),
bc AS (SELECT v, w, count(*) FILTER (WHERE t = 0) AS n0, count(*) FILTER (WHERE t = 1) AS n1 FROM big GROUP BY v, w),
los AS (SELECT bc.v, bc.w, -ln(0.7 * bc.n0 / greatest(c.n0, 1) + 0.3 * (u.n0 + 1) / (m0 + v_)) AS l0, -ln(0.7 * bc.n1 / greatest(c.n1, 1) + 0.3 * (u.n1 + 1) / (m1 + v_)) AS l1
  FROM bc JOIN uni c ON bc.v = c.w JOIN uni u ON bc.w = u.w, (SELECT m0, m1, v AS v_ FROM size)),
per AS (SELECT r, count(*) AS n, sum(CAST(l0 AS DOUBLE)) AS l0, sum(CAST(l1 AS DOUBLE)) AS l1 FROM big JOIN los USING (v, w) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(l1 / n, 6) AS loss_target, round(l0 / n, 6) AS loss_background, round(l1 / n - l0 / n, 6) AS score FROM d LEFT JOIN per USING (r)
"""


@query("op3_lm_score", LM_SQL)
def op3(spark, sf_dir):
    target = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    out = lmscore.cross_entropy_difference(read(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "score")])


#: Distances are taken on one byte for each letter: DuckDB counts bytes, so letters beyond ASCII get a control character.
LINE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT r, doc_id, i, ls[i] AS line FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
l AS (SELECT line, min(doc_id) AS first_doc, count(*) AS n, length(line) AS c, translate(line, 'áéíóúñüäößèêçÁÉÍÓÚÑÜÄÖÈÊÇ', concat(chr(1), chr(2), chr(3), chr(4), chr(5), chr(6), chr(7), chr(8), chr(11), chr(12), chr(14), chr(15), chr(16), chr(17), chr(18), chr(19), chr(20), chr(21), chr(22), chr(23), chr(24), chr(25), chr(26), chr(27), chr(28))) AS t
      FROM e WHERE length(line) >= 16 GROUP BY line),
k AS (SELECT a.line AS a, b.line AS b FROM l a JOIN l b ON b.c = a.c AND a.line < b.line AND levenshtein(a.t, b.t) <= 1
      UNION ALL SELECT a.line, b.line FROM l a JOIN l b ON b.c = a.c + 1 AND levenshtein(a.t, b.t) <= 1),
g AS (SELECT a AS u, b AS v FROM k UNION ALL SELECT b, a FROM k),
reach(u, v) AS (SELECT u, u FROM (SELECT DISTINCT u FROM g) UNION SELECT reach.u, g.v FROM reach JOIN g ON reach.v = g.u),
key AS (SELECT u AS line, min({'d': lv.first_doc, 'l': lv.line}) AS m FROM reach JOIN l lv ON reach.v = lv.line GROUP BY u),
deg AS (SELECT u AS line, count(*) AS links FROM g GROUP BY u),
rule AS (SELECT l.line, CASE WHEN key.m IS NULL OR key.m.l = l.line THEN l.first_doc END AS keep_doc, coalesce(deg.links, 0) AS links FROM l LEFT JOIN key USING (line) LEFT JOIN deg USING (line)),
m AS (SELECT e.r, e.i, e.line, rule.line IS NULL OR (rule.keep_doc = e.doc_id AND row_number() OVER (PARTITION BY e.r, e.line ORDER BY e.i) = 1) AS stays,
      CASE WHEN row_number() OVER (PARTITION BY e.r, e.line ORDER BY e.i) = 1 THEN coalesce(rule.links, 0) ELSE 0 END AS links FROM e LEFT JOIN rule ON e.line = rule.line),
x AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE stays) AS n_kept, sum(links) AS n_links, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS text FROM m GROUP BY r)
SELECT doc_id, n_lines, n_kept, CAST(n_links AS BIGINT) AS n_links, text FROM x JOIN d USING (r)
"""


@query("op2_line_dedup", LINE_SQL)
def op2(spark, sf_dir):
    return linedup.dedup_lines(read(spark, sf_dir, "documents"))


@query("op5_near_dup")
def op5(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), share=0.0)


@query("op11_personal")
def op11(spark, sf_dir):
    return personal.personal_report(read(spark, sf_dir, "documents"))


@query("op12_alignment")
def op12(spark, sf_dir):
    return alignment.alignment_report(read(spark, sf_dir, "documents"))


#: Near words share what is left after one letter is taken out: at the same place in both, or in the longer one.
VARIANT_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
tok AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
run AS (SELECT d, w, count(*) AS n, hex(encode(d || ':' || w)) AS x FROM tok WHERE length(w) >= 6 GROUP BY 1, 2),
sums AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(x), 2), lambda i: 16 * instr('123456789ABCDEF', x[i]) + instr('123456789ABCDEF', x[i + 1]))),
  lambda c, y: xor(c >> 8, t[1 + xor(c, y) % 256]))) AS h FROM run, tab),
wc AS (SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS w, n FROM sums),
words AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM wc WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
cut AS (SELECT DISTINCT w, i, w[:i - 1] || w[i + 1:] AS rest FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
near AS (SELECT a.w AS a, b.w AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.w <> b.w
  UNION SELECT cut.w, words.w FROM cut JOIN words ON cut.rest = words.w UNION SELECT words.w, cut.w FROM cut JOIN words ON cut.rest = words.w),
best AS (SELECT a AS w, count(*) AS n_near, min({'m': -n, 'w': b}) AS top FROM near JOIN words ON b = w GROUP BY 1),
f AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.m >= 5 * n THEN top.w END AS form, CASE WHEN -top.m >= 5 * n THEN -top.m END AS form_n FROM words LEFT JOIN best USING (w)),
way(w, here, onward) AS (SELECT w, w, form FROM f UNION ALL SELECT way.w, way.onward, f.form FROM way JOIN f ON way.onward = f.w)
SELECT f.w AS word, form, here AS root, n, n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN way ON way.w = f.w AND way.onward IS NULL
"""


@query("op13_variants", VARIANT_SQL)
def op13(spark, sf_dir):
    return variants.variant_groups(read(spark, sf_dir, "documents"))
