"""DuckDB statements for the queries of this subpackage that SQL can express.

They compute each result from the tables directly, by the contract and not by
the operators' methods.  The classifier (op2), the byte-pair encoder (op9), the
surrogates (op10) and the main text of pages (op12) are tested in ``tests/llm``.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACE = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

_OP1 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS n_text,
         length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '<(\\*)\|', '<\1\\|', 'g')) AS n_role,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN joined THEN 10 ELSE 12 + n_role + 1 + 11 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP3 = f"""
WITH iw AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(generate_series(1, len(w) - least(10, len(w)) + 1),
         lambda i: array_to_string(w[i:i + least(10, len(w)) - 1], ' '))) AS win
  FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
spots AS (
  SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM d, sizes WHERE len(w) >= n),
occ AS (
  SELECT DISTINCT s.doc_id, s.i, s.n, x.item_id FROM spots s JOIN windows x
  ON x.n = s.n AND x.win = array_to_string(s.w[s.i:s.i + s.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""

_OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACE} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM both_ JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = w.doc_id
"""

_OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.v FROM reach r JOIN links l ON l.u = r.b),
n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN n ON n.u = a GROUP BY a
"""

_B32 = " || ".join(f"""lpad(translate(lower(
    substr('0123456789abcdefghijklmnopqrstuv', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INT >> 15) & 31), 1) ||
    substr('0123456789abcdefghijklmnopqrstuv', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INT >> 10) & 31), 1) ||
    substr('0123456789abcdefghijklmnopqrstuv', 1 + ((('0x' || substr(h, {1 + 5 * i}, 5))::INT >> 5) & 31), 1) ||
    substr('0123456789abcdefghijklmnopqrstuv', 1 + (('0x' || substr(h, {1 + 5 * i}, 5))::INT & 31), 1)),
    '0123456789abcdefghijklmnopqrstuv', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'), 4, 'A')""" for i in range(8))

_OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM l
"""

def _crc_table() -> list[int]:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_OP11 = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
df AS (SELECT unnest(w) AS f FROM d),
tf AS (SELECT unnest({_ALNUM}) AS f FROM benchmark),
v AS (SELECT DISTINCT f, hex(encode(f)) AS x, {_crc_table()}::BIGINT[] AS t FROM (SELECT f FROM df UNION ALL SELECT f FROM tf)),
b AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(generate_series(1, length(x), 2),
         lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) % 10000 AS bucket
  FROM v),
sn AS (SELECT bucket, count(*) AS s FROM df JOIN b USING (f) GROUP BY bucket),
tn AS (SELECT bucket, count(*) AS t FROM tf JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM df) + 10000)
         / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * ((SELECT count(*) FROM tf) + 10000)))) AS BIGINT) AS gain
  FROM sn FULL JOIN tn USING (bucket)),
m AS (
  SELECT doc_id, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
  FROM (SELECT doc_id, unnest(w) AS f FROM d) JOIN b USING (f) JOIN g USING (bucket) GROUP BY doc_id),
r AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
         / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN m ON m.doc_id = d.doc_id),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS wanted FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM r LEFT JOIN o ON o.doc_id = r.doc_id
"""

_OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least_ AS (SELECT text, min(doc_id) AS first FROM d GROUP BY text),
said AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS g, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS t
         FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (
  SELECT part, (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN d.doc_id > first THEN 'E' ELSE '' END) AS fails,
         count(*) AS n, sum(coalesce(g, 0)) AS good, sum(coalesce(t, 0)) AS toxic
  FROM d JOIN least_ ON least_.text = d.text LEFT JOIN said ON said.doc_id = d.doc_id GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS x, '[' || substr(filter_order, 1, step - 1) || ' ]' AS before
      FROM o, (SELECT CAST(unnest(generate_series(1, 5)) AS INTEGER) AS step)),
k AS (SELECT part, filter_order, step, x, n, good, toxic, fails, contains(fails, x) AS bad, regexp_matches(fails, before) AS gone FROM c, s),
q AS (
  SELECT part, filter_order, step, x, sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN bad AND gone THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = x THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost
  FROM k GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM q
"""

ORACLE: dict[str, str] = {
    "op1_chat_formatting": _OP1,
    "op3_decontamination": _OP3,
    "op4_minhash_near_dedup": _OP4,
    "op5_embedding_near_dedup": _OP5,
    "op7_warc": _OP7,
    "op11_importance_resampling": _OP11,
    "op13_filter_audit": _OP13,
}
