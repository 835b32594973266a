"""DuckDB SQL for those of the thirteen queries that SQL can express."""


def _assign(books: str) -> str:
    """Each part's nearest entry ``e`` and its squared distance ``d``; ties go to the lower index."""
    return f"""SELECT vec_id, label, k, v, key % 64 AS e, key // 64 AS d FROM (
      SELECT p.vec_id, p.label, p.k, p.v, min(64 * list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + b.e) AS key
      FROM p JOIN {books} b USING (k) GROUP BY ALL)"""


def _move(parts: str, books: str) -> str:
    """Entries at the floors of their parts' means."""
    return f"""SELECT b.k, b.e, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
      SELECT k, e, list(q ORDER BY i) AS v FROM (
        SELECT k, e, i, (s - ((s % n) + n) % n) // n AS q FROM (
          SELECT k, e, i, sum(x)::BIGINT AS s, count(*) AS n
          FROM (SELECT k, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM {parts}) GROUP BY k, e, i)) GROUP BY k, e) m
      ON b.k = m.k AND b.e = m.e"""


SQL = {
    "op10_line_dedup": """
WITH l AS (
  SELECT doc_id, i AS pos, ls[i] AS line,
         translate(trim(ls[i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, f.first IS NOT NULL AND l.doc_id > f.first AS gone FROM l LEFT JOIN f ON l.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op12_ranked_search": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS total FROM d WHERE len(ts) > 0),
q AS (
  SELECT item_id, t, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY item_id, t
), p AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM d)
  WHERE t IN (SELECT t FROM q) GROUP BY r, doc_id, n, t
), w AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
s AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), g GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 10""",
    "op13_vector_codes": f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (SELECT vec_id, label, k, v[k * (len(v) // 16) + 1 : (k + 1) * (len(v) // 16)] AS v FROM v, range(16) t(k)),
b0 AS (SELECT k, e, v FROM (SELECT k, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS e, v FROM p) WHERE e < 64),
a1 AS ({_assign("b0")}), b1 AS ({_move("a1", "b0")}), a2 AS ({_assign("b1")}), b2 AS ({_move("a2", "b1")}), a3 AS ({_assign("b2")}),
c AS (
  SELECT vec_id, label, lower(string_agg(printf('%02x', e::INTEGER), '' ORDER BY k)) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY vec_id, label
), h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY k, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, h""",
}
