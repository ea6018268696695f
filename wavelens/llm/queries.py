"""The registered queries of this package: thin digests of each operator's own output."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, decontam, embed, html, lm, pii, simhash, suffix, toxicity
from .common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix(spark, sf_dir):
    return suffix.digest(suffix.deduplicate(table(spark, sf_dir, "documents")))


def op4_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op5_cross_entropy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lm.cross_entropy_difference(docs, lm.targets(docs, table(spark, sf_dir, "labels")))


def op6_byte_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_embedding(spark, sf_dir):
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_chat(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark, sf_dir):
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pii_key(spark) -> str:
    """The session's ``spark.wavelens.pii.key``; where it is unset, as on test tables, a published one that protects nothing."""
    return spark.conf.get("spark.wavelens.pii.key", "published key for test tables")


def op10_pii(spark, sf_dir):
    counts = [f"n_{k}" for k in pii.KINDS]
    return pii.replace(table(spark, sf_dir, "documents"), pii_key(spark)).select("doc_id", "text", *counts)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_embedding": op2_embedding,
    "op3_suffix": op3_suffix,
    "op4_html": op4_html,
    "op5_cross_entropy": op5_cross_entropy,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}

_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLES: dict[str, str] = {
    "op2_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.a), l AS (SELECT a, count(*) AS k FROM n GROUP BY a)
SELECT r.a AS vec_id, CAST(coalesce(any_value(k), 0) AS BIGINT) AS n_links, CAST(min(c) AS BIGINT) AS component_id, r.a = min(c) AS kept FROM r LEFT JOIN l ON l.a = r.a GROUP BY r.a
""",
    "op3_suffix": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM d),
q AS (SELECT doc_id, b, substr(h, 2 * b + 1, 2100) AS q FROM (SELECT doc_id, h, unnest(range(0, n - 49, 1000)) AS b FROM n WHERE n >= 50)),
w AS (SELECT doc_id, b + o AS p, substr(q, 2 * o + 1, 100) AS s FROM (SELECT doc_id, b, q, unnest(range(0, least(1000, length(q) // 2 - 49))) AS o FROM q)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)), g AS (SELECT w.doc_id, p FROM w JOIN f USING (s) WHERE first < w.doc_id),
o AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM g), i AS (SELECT doc_id, p, sum(CASE WHEN p <= b + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM o),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY 1, 2), t AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
c AS (SELECT t.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS fin, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS head FROM t JOIN n ON n.doc_id = t.doc_id GROUP BY 1)
SELECT n.doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * fin + 1), h))) AS kept_sha256 FROM n LEFT JOIN c ON c.doc_id = n.doc_id
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ii AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM ii)),
ks AS (SELECT DISTINCT k FROM ii),
dw AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, ks WHERE len(w) >= k)),
m AS (SELECT doc_id, item_id, dw.k AS k, a FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id),
it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(w) AS term FROM ii)),
po AS (SELECT doc_id, term, pos FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d) WHERE term IN (SELECT term FROM it)),
df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
pk AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS need, min(df) OVER (PARTITION BY item_id) AS lo FROM
  (SELECT item_id, it.term, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(df, 0), it.term) AS k FROM it LEFT JOIN df USING (term)) WHERE k <= 3),
ls AS (SELECT doc_id, item_id, pos, need, max(CASE WHEN k = 1 THEN pos END) OVER s AS l1, max(CASE WHEN k = 2 THEN pos END) OVER s AS l2, max(CASE WHEN k = 3 THEN pos END) OVER s AS l3
  FROM po JOIN pk USING (term) WHERE lo > 0 WINDOW s AS (PARTITION BY doc_id, item_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM ls WHERE l1 IS NOT NULL AND (need < 2 OR l2 IS NOT NULL) AND (need < 3 OR l3 IS NOT NULL)
  AND pos - least(pos, coalesce(l1, pos), coalesce(l2, pos), coalesce(l3, pos)) + 1 <= 20 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nr USING (doc_id)
""",
}
