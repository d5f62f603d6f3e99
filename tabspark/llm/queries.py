"""One query per operator, over whole tables with production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import decontamination, exact_dedup, hard_negatives, html_extract, license_scan, line_dedup, lm_score, near_dedup, phrases, quality, sentencepiece_codec, substring_dedup, toxicity
from tabspark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SOLID = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn
    return register


@query(rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id""")
def op6_line_dedup(spark, sf):
    return line_dedup.line_report(table(spark, sf, "documents"))


@query(rf"""
WITH n AS (SELECT doc_id, {LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g ON n.t = g.t""")
def op7_exact_dedup(spark, sf):
    return exact_dedup.exact_dedup(table(spark, sf, "documents"))


@query(rf"""
WITH low AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all({LOWER}, '{WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n,
               unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS g
        FROM item WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p,
              unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM low, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT low.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN pos ON low.doc_id = pos.doc_id LEFT JOIN ids ON low.doc_id = ids.doc_id""")
def op1_decontamination(spark, sf):
    return decontamination.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SOLID}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM comp LEFT JOIN n USING (doc_id)""")
def op10_near_dedup(spark, sf):
    return near_dedup.near_dedup(table(spark, sf, "documents"))


@query()
def op9_toxicity(spark, sf):
    return toxicity.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op8_quality(spark, sf):
    return quality.report(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op5_license_scan(spark, sf):
    return license_scan.report(table(spark, sf, "documents"))


@query()
def op2_lm_score(spark, sf):
    return lm_score.score(table(spark, sf, "documents"), own_contexts=True)


@query()
def op3_html_extract(spark, sf):
    return html_extract.extract(table(spark, sf, "pages"))


@query()
def op4_sentencepiece(spark, sf):
    return sentencepiece_codec.report(table(spark, sf, "documents"))


@query("""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank,
       s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) <= 3""")
def op12_hard_negatives(spark, sf):
    return hard_negatives.report(table(spark, sf, "embeddings"))


@query(rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
two AS (SELECT lang, phrase, a, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
cut AS (SELECT two.*, h.a AS l, t.a AS r, (CAST(1000000 AS HUGEINT) * two.a * two.a) // (CAST(h.a AS HUGEINT) * t.a) AS score
        FROM two JOIN f h ON two.lang = h.lang AND two.head = h.phrase JOIN f t ON two.lang = t.lang AND two.tail = t.phrase),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
part AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
around AS (SELECT lang, phrase, max(a) AS longer FROM part GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN around USING (lang, phrase) WHERE coalesce(100 * longer < 50 * a, true)),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n ON kept.lang = n.lang QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000""")
def op13_phrase_collocations(spark, sf):
    return phrases.report(table(spark, sf, "documents"))


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{SOLID}') AS w FROM documents),
win AS (SELECT row, doc_id, unnest(range(1, len(w) - 11)) AS p, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d WHERE len(w) >= 13),
own AS (SELECT g, min(doc_id) AS owner FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT DISTINCT row, unnest(range(p, p + 13)) AS q FROM win JOIN own USING (g) WHERE owner < doc_id),
word AS (SELECT row, doc_id, unnest(range(1, len(w) + 1)) AS q, unnest(w) AS x FROM d),
kept AS (SELECT word.row, count(hit.q) AS n_removed, string_agg(x, ' ' ORDER BY word.q) FILTER (WHERE hit.q IS NULL) AS t
         FROM word LEFT JOIN hit ON word.row = hit.row AND word.q = hit.q GROUP BY word.row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.row = kept.row""")
def op11_substring_dedup(spark, sf):
    return substring_dedup.report(table(spark, sf, "documents"))
