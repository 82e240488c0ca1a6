"""The registered queries of this package and the SQL they must equal where SQL can say it."""

from __future__ import annotations

import public_tokenizers

from brickyard.llm import (exact, jaccard, packing, phrases, pseudonyms, quality, secrets, toxicity,
                           tries, unigram, variants, vectors, warc)
from brickyard.llm.common import table

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PSEUDONYM_KEY = "a key from the operator's own store"


def op1_secret_field(spark, sf_dir):
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op2_toxicity_grades(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark, sf_dir):
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_unigram_counts(spark, sf_dir):
    return unigram.token_counts(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op6_pseudonyms(spark, sf_dir):
    return pseudonyms.pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op7_decontamination(spark, sf_dir):
    return phrases.contamination(table(spark, sf_dir, "documents"),
                                 table(spark, sf_dir, "benchmark")).drop("seal")


def op8_warc_revisits(spark, sf_dir):
    return warc.pages_archive(table(spark, sf_dir, "pages"))


def op9_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op11_conversation_trie(spark, sf_dir):
    return tries.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_near_vectors(spark, sf_dir):
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark, sf_dir):
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_field, op2_toxicity_grades, op3_exact_dedup, op4_jaccard_join, op5_unigram_counts,
    op6_pseudonyms, op7_decontamination, op8_warc_revisits, op9_quality, op10_packing,
    op11_conversation_trie, op12_near_vectors, op13_spelling_variants)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# CRC-32 of a string's UTF-8 bytes, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, octet_length(encode({s})) + 1),
    lambda p: ('0x' || substr(hex(encode({s})), 2 * p - 1, 2))::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
    lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

SQL = {
    "op3_exact_dedup": r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS c,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size, doc_id = first_value(doc_id) OVER w AS kept,
  h AS text_sha256
FROM n WINDOW w AS (PARTITION BY h ORDER BY c DESC, doc_id)
""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id,
    regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 5
      THEN list_transform(range(1, len(a) - 3), lambda i: array_to_string(a[i:i+4], ' '))
      WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * i >= 75 * (x.k + y.k - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.k), 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id,
    regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
b AS (SELECT item_id,
    regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(a) >= 10
        THEN list_transform(range(1, len(a) - 8), lambda i: array_to_string(a[i:i+9], ' '))
        WHEN len(a) > 0 THEN [array_to_string(a, ' ')] ELSE [] END) AS g FROM b),
m AS (SELECT DISTINCT g, len(string_split(g, ' ')) AS k FROM bw),
ks AS (SELECT DISTINCT k FROM m),
dw AS (SELECT doc_id, k, unnest(list_transform(range(1, len(a) - k + 2),
        lambda i: {{'s': i, 'g': array_to_string(a[i:i+k-1], ' ')}})) AS x FROM d, ks WHERE len(a) >= k),
f AS (SELECT doc_id, x.s AS s, m.k AS k, m.g AS g FROM dw JOIN m ON m.g = x.g AND m.k = dw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM f)
      GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n, string_agg(t, ',' ORDER BY t) AS l FROM (
      SELECT DISTINCT doc_id, item_id::VARCHAR AS t FROM f JOIN bw USING (g)) GROUP BY 1)
SELECT d.doc_id, len(a)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit,
  coalesce(i.n, 0)::BIGINT AS n_items, sha256(coalesce(i.l, '')) AS items_sha256,
  coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
""",
    "op8_warc_revisits": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, octet_length(encode(t)) AS n, array_to_string(list_transform(
      range(0, 8), lambda i: array_to_string(list_transform([32768, 1024, 32, 1],
        lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
          ((('0x' || substr(sha1(t), i * 5 + 1, 5))::BIGINT // k) % 32 + 1)::INT, 1)), '')), '') AS h FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM q)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM r
""",
    "op11_conversation_trie": rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, {_CRC.format(s="conv_id::VARCHAR")} % 4 AS h FROM t),
u AS (SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
a AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS s
  FROM (FROM u UNION ALL SELECT conv_id, NULL, NULL, NULL FROM c) GROUP BY 1),
m AS (SELECT conv_id, d::BIGINT AS depth, coalesce(s, [])[1:d] AS p, d = len(coalesce(s, [])) AS over
  FROM a, LATERAL (SELECT unnest(range(0, len(coalesce(s, [])) + 1)) AS d) x),
n AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE over), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1)
      * len(regexp_extract_all(p[depth].t, '[^\x20\x09-\x0D]+')) END AS own FROM m GROUP BY p, depth),
k AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM n WHERE depth > 0 GROUP BY 1),
f AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM n LEFT JOIN k ON k.p = n.p),
s AS (SELECT p[1:d] AS p, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM f, LATERAL (SELECT unnest(range(0, depth + 1)) AS d) x GROUP BY 1)
SELECT f.conv_id, f.depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.p = f.p LEFT JOIN n q ON f.depth > 0 AND q.p = f.p[1:f.depth - 1]
""",
    "op12_near_vectors": """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT * FROM v WHERE len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.vec_id <> b.vec_id
  AND list_inner_product(a.v, b.v) >= 0.9 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(c) AS component_id, r.vec_id = min(c) AS kept
FROM r LEFT JOIN n ON n.a = r.vec_id GROUP BY r.vec_id
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE o AS (SELECT doc_id, r, length(r) AS k, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)
  WHERE length(r) >= 5 GROUP BY 1, 2),
h AS (SELECT *, {_CRC.format(s="(doc_id::VARCHAR || ':' || r)")} AS h FROM o),
m AS (SELECT CASE WHEN h % 97 = 0 THEN substr(r, 1, (h % k)::INT) || substr(r, (h % k)::INT + 2) ELSE r END AS word, n
  FROM h),
w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
d AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM c),
p AS (SELECT x.word, y.word AS near, y.n FROM d x JOIN d y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.a || d.b
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.a || d.b),
b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY 1),
e AS (SELECT p.word, min(p.near) AS best FROM p JOIN b ON b.word = p.word AND b.top = p.n GROUP BY 1),
g AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form,
    CASE WHEN top >= 2 * w.n THEN top END AS form_n FROM w LEFT JOIN b ON b.word = w.word LEFT JOIN e ON e.word = w.word),
r AS (SELECT word, word AS root, 0 AS step FROM g
  UNION ALL SELECT r.word, g.form, step + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL),
l AS (SELECT word, max_by(root, step) AS root FROM r GROUP BY 1)
SELECT g.word, g.form, l.root, g.n, g.n_near, g.form_n FROM g JOIN l ON l.word = g.word
""",
}
