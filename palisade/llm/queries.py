"""Registered queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from palisade.llm import (
    byte_bpe, conversation_repair, decontaminate, licenses, mixing, prefix_trie, quality_lm, quality_rules, sharding, simhash,
    substring_dedup, token_counts, url_filter)

QUERIES = {
    "op1_license_scan": licenses.op1,
    "op2_url_filter": url_filter.op2,
    "op3_simhash_dedup": simhash.op3,
    "op4_quality_classifier": quality_lm.op4,
    "op5_mixing": mixing.op5,
    "op6_sharding": sharding.op6,
    "op7_token_counts": token_counts.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_substring_dedup": substring_dedup.op10,
    "op11_prefix_trie": prefix_trie.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_byte_bpe": byte_bpe.op13,
}

ORACLES = {
    "op9_decontaminate": r"""
WITH lowered AS (
    SELECT doc_id AS id, 'd' AS kind, text FROM documents UNION ALL SELECT item_id, 'b', text FROM benchmark),
t AS (SELECT id, kind, regexp_extract_all(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
b AS (SELECT id AS item_id, w, least(10, len(w)) AS n FROM t WHERE kind = 'b' AND len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS words
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM win),
hit AS (SELECT p.id, p.i, p.n, item_id
        FROM (SELECT t.id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t, sizes WHERE kind = 'd' AND len(w) >= n) p
        JOIN win ON win.n = p.n AND win.words = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY 1),
named AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
          FROM (SELECT DISTINCT id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT t.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN covered USING (id) LEFT JOIN named USING (id) WHERE kind = 'd'""",
    "op10_substring_dedup": r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) > 1 AS again
      FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE again),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM t),
kept AS (SELECT a.doc_id, count(*) FILTER (b.i IS NOT NULL) AS n_removed,
                coalesce(string_agg(word, ' ' ORDER BY a.i) FILTER (b.i IS NULL), '') AS kept
         FROM words a LEFT JOIN gone b ON a.doc_id = b.doc_id AND a.i = b.i GROUP BY 1)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)""",
}
