"""DuckDB SQL for the queries that SQL can express."""

FILL_MIDDLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u,
    [CAST('0x' || substr(d, 1 + 8 * i, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h
  FROM cut
), counted AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n FROM units
), placed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM counted
), parts AS (
  SELECT doc_id, t, n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
         WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:a], '') AS prefix,
    array_to_string(u[a + 1:b], '') AS middle,
    array_to_string(u[b + 1:n], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
                   WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts
"""

_LEAF = " || ".join(
    f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    for c in ("doc_id", "source", "lang", "{n_chars}", "text")
)
_HIT = "n_chars + CASE WHEN {crc} % 7 = 0 THEN 1 ELSE 0 END"

#: CRC-32 of a text, bit by bit, as DuckDB has no function for it: the polynomial is a fixed value.
_CRC = (
    "(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
    "lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), "
    "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), "
    "CAST(4294967295 AS BIGINT)))"
)

MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, sha256({_LEAF.format(n_chars="n_chars")}) AS leaf,
    sha256({_LEAF.format(n_chars=_HIT.format(crc=_CRC))}) AS claimed
  FROM documents
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), tree AS (
  SELECT lang, 0 AS lvl, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM ranked
  UNION ALL
  SELECT lang, lvl, i, h, count(*) OVER (PARTITION BY lang) FROM (
    SELECT lang, lvl + 1 AS lvl, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h
    FROM tree WHERE n > 1 GROUP BY lang, lvl + 1, i // 2)
), subroots AS MATERIALIZED (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS lvl, i, h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT lvl, i, h, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, i // 2 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h
    FROM upper_tree WHERE n > 1 GROUP BY lvl + 1, i // 2)
), steps AS MATERIALIZED (
  SELECT lang, lvl, i, coalesce(lag(h) OVER w, '') AS before, coalesce(lead(h) OVER w, '') AS after
  FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lang, lvl, i // 2 ORDER BY i)
), upper_steps AS MATERIALIZED (
  SELECT lvl, i, coalesce(lag(h) OVER w, '') AS before, coalesce(lead(h) OVER w, '') AS after
  FROM upper_tree WHERE n > 1 WINDOW w AS (PARTITION BY lvl, i // 2 ORDER BY i)
), paths AS (
  SELECT r.lang, r.i, s.lvl, s.before, s.after
  FROM ranked r JOIN steps s ON s.lang IS NOT DISTINCT FROM r.lang AND s.i = r.i // CAST(2 ** s.lvl AS BIGINT)
  UNION ALL
  SELECT r.lang, r.i, 1000 + s.lvl, s.before, s.after
  FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang
  JOIN upper_steps s ON s.i = b.i // CAST(2 ** s.lvl AS BIGINT)
), proofs AS MATERIALIZED (
  SELECT lang, i, list(struct_pack(before := before, after := after) ORDER BY lvl) AS proof FROM paths GROUP BY lang, i
), folded AS (
  SELECT r.lang, r.i, r.claimed AS h, 1 AS k FROM ranked r
  UNION ALL
  SELECT f.lang, f.i, sha256(p.proof[k].before || h || p.proof[k].after), k + 1
  FROM folded f JOIN proofs p ON p.lang IS NOT DISTINCT FROM f.lang AND p.i = f.i WHERE k <= len(p.proof)
), tops AS (
  SELECT lang, i, arg_max(h, k) AS folded_root FROM folded GROUP BY lang, i
)
SELECT r.doc_id, r.leaf, b.h AS subroot, t.h AS root,
  sha256(coalesce(list_reduce(list_prepend('', list_transform(p.proof, lambda s: s.before || s.after)),
    lambda x, y: x || y), '')) AS proof_sha256,
  f.folded_root, f.folded_root = t.h AS verified
FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang
JOIN (SELECT h FROM upper_tree WHERE n = 1) t ON true
JOIN tops f ON f.lang IS NOT DISTINCT FROM r.lang AND f.i = r.i
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM r.lang AND p.i = r.i
"""

TOP_K = """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

VECTORS = """
WITH RECURSIVE fit AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reached AS (
  SELECT DISTINCT a AS origin, a AS node FROM links
  UNION
  SELECT origin, b FROM reached JOIN links ON a = node
), component AS (SELECT origin, min(node) AS smallest FROM reached GROUP BY origin)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  coalesce(c.smallest, e.vec_id) AS component_id, coalesce(c.smallest, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN component c ON c.origin = e.vec_id
"""

ORACLES: dict[str, str] = {
    "op2_topk": TOP_K,
    "op10_vector_dedup": VECTORS,
    "op11_fill_middle": FILL_MIDDLE,
    "op13_merkle": MERKLE,
}
