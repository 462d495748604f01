"""DuckDB SQL for the rows of queries whose SQL is long."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Unsigned crc32 of the id's decimal digits: a fold over characters, and over eight bits of each.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, c: list_reduce(list_prepend(xor(a, c), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS BIGINT[])), lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""


def _leaf(text: str) -> str:
    parts = [f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')" for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _trees(name: str, source: str, part: str, levels: int) -> list[str]:
    """Levels of the trees over ``source`` (part, i, h); a tree with one node left stays as it is."""
    out = [f"{name}0 AS MATERIALIZED (SELECT {part}, i, h, count(*) OVER (PARTITION BY {part}) AS n FROM ({source}))"]
    up = "CASE WHEN n = 1 THEN 0 ELSE i // 8 END"
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {part}) AS n FROM (
  SELECT {part}, {up} AS i, CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY {part}, {up}))""")
    return out


def _climb(name: str, source: str, trees: str, part: str, levels: int) -> list[str]:
    """``source`` (id, part, i, own, proof) from leaf to top, with its own digest in the place of the tree's."""
    out = [f"{name}0 AS MATERIALIZED ({source})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT c.id, c.{part}, CASE WHEN max(t.n) = 1 THEN c.i ELSE c.i // 8 END AS i,
  CASE WHEN max(t.n) = 1 THEN c.own ELSE sha256(string_agg(CASE WHEN t.i = c.i THEN c.own ELSE t.h END, '' ORDER BY t.i)) END AS own,
  c.proof || coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i <> c.i), '') AS proof
  FROM {name}{k} c JOIN {trees}{k} t ON t.{part} = c.{part} AND t.i // 8 = c.i // 8 GROUP BY c.id, c.{part}, c.i, c.own, c.proof)""")
    return out


#: Up to 8**8 documents of a language and 8**4 languages.
MERKLE = "WITH " + ", ".join([
    f"""l AS MATERIALIZED (SELECT doc_id, coalesce('l' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, {_leaf('text')} AS h,
  CASE WHEN {_CRC} % 3 = 0 THEN {_leaf(LOWER)} ELSE {_leaf('text')} END AS own FROM documents)""",
    *_trees("t", "SELECT g, i, h FROM l", "g", 8),
    *_climb("c", "SELECT doc_id AS id, g, i, own, '' AS proof FROM l", "t", "g", 8),
    "s AS MATERIALIZED (SELECT 0 AS z, g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM t8)",
    *_trees("u", "SELECT z, i, h FROM s", "z", 4),
    *_climb("d", "SELECT c.id, 0 AS z, s.i, c.own, c.proof FROM c8 c JOIN s ON s.g = c.g", "u", "z", 4),
]) + """
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, u4.h AS root, sha256(d.proof) AS proof_sha256, d.own AS folded_root, d.own = u4.h AS verified
FROM l JOIN s ON s.g = l.g JOIN d4 d ON d.id = l.doc_id CROSS JOIN u4"""

_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

LEXICAL = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, {_TERM}) AS w FROM documents WHERE text IS NOT NULL),
 g AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
 f AS MATERIALIZED (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
 tf AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM f GROUP BY ALL),
 b AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, {_TERM})) AS t FROM benchmark) GROUP BY ALL),
 w AS (SELECT t, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN g GROUP BY t),
 s AS (SELECT b.item_id, tf.doc_id, CAST(sum(b.k * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * (75 + (25 * tf.n * g.n_docs) // g.n_terms)))) AS BIGINT) AS score
   FROM b JOIN tf USING (t) JOIN w USING (t) CROSS JOIN g GROUP BY ALL),
 r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""

_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {_SPACED}) AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM w),
 x AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
 e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id
   AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
 r(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.a AND r.c < e.b)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""

DECONTAMINATED = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, {_ALNUM}), []) AS w FROM documents),
 i AS (SELECT item_id, coalesce(regexp_extract_all({LOWER}, {_ALNUM}), []) AS w FROM benchmark),
 v AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + 9), ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
 z AS (SELECT DISTINCT n FROM v),
 o AS MATERIALIZED (SELECT DISTINCT doc_id, p, f.n, item_id FROM (SELECT doc_id, z.n, p, array_to_string(list_slice(w, p, p + z.n - 1), ' ') AS t
   FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM d) CROSS JOIN z WHERE p + z.n - 1 <= len(w)) f JOIN v ON v.n = f.n AND v.t = f.t),
 h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM o) GROUP BY doc_id),
 m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM o) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)"""

REPEATED_WORDS = f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
 v AS MATERIALIZED (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 12), ' ') AS t FROM (SELECT *, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)),
 f AS (SELECT *, min(doc_id) OVER (PARTITION BY t) AS first FROM v),
 g AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM f WHERE first < doc_id),
 k AS (SELECT x.doc_id, string_agg(x.t, ' ' ORDER BY x.p) AS kept FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) x ANTI JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)"""
