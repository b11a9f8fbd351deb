"""SQL for the queries of this package that DuckDB can express, over the same tables."""

from __future__ import annotations

_STEP = "xor(c >> 1, 3988292384 * (c & 1))"
# CRC-32 of a decimal number, bit by bit.
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({s}) + 1), "
    "lambda i: ascii({s}[i])::BIGINT)), lambda r, b: list_reduce("
    f"[xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_STEP})), 4294967295)"
)


def crc32(number: str) -> str:
    return _CRC.format(s=f"cast({number} as varchar)")


def _field(x: str) -> str:
    return f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, base: str) -> str:
    return f"""{name} AS (
  {base}
  UNION ALL
  SELECT g, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1
  GROUP BY g, level, pos // 3
)"""


MERKLE = f"""WITH RECURSIVE rows AS (
  SELECT *, {_field('source')} AS g, {_leaf('text')} AS leaf,
         {_leaf("CASE WHEN " + crc32('doc_id') + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS shown
  FROM documents
), placed AS (
  SELECT doc_id, source, g, leaf, shown, row_number() OVER () AS id,
         row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM rows
), {_tree("tree", "SELECT g, 0 AS level, pos, leaf AS digest FROM placed")}, subroots AS (
  SELECT g, arg_max(digest, level) AS subroot FROM tree GROUP BY g
), ranked AS (
  SELECT g, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM subroots JOIN (SELECT DISTINCT g, source FROM placed) USING (g)
), {_tree("crown", "SELECT 'top' AS g, 0 AS level, pos, subroot AS digest FROM ranked")}, steps AS (
  SELECT s.id, t.level,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.at), '') AS before,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.at), '') AS after
  FROM (SELECT id, g, v.level, pos // cast(3 ** v.level as bigint) AS at
        FROM placed JOIN (SELECT g, level FROM tree GROUP BY g, level HAVING count(*) > 1) v USING (g)) s
  JOIN tree t ON t.g = s.g AND t.level = s.level AND t.pos // 3 = s.at // 3
  GROUP BY s.id, t.level
  UNION ALL
  SELECT s.id, 1000 + t.level,
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos < s.at), ''),
         coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (t.pos > s.at), '')
  FROM (SELECT id, v.level, r.pos // cast(3 ** v.level as bigint) AS at
        FROM placed JOIN ranked r USING (g)
        JOIN (SELECT level FROM crown GROUP BY level HAVING count(*) > 1) v ON true) s
  JOIN crown t ON t.level = s.level AND t.pos // 3 = s.at // 3
  GROUP BY s.id, t.level
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS n FROM steps
), climbed AS (
  SELECT id, 0 AS n, shown AS node FROM placed
  UNION ALL
  SELECT c.id, c.n + 1, sha256(s.before || c.node || s.after)
  FROM climbed c JOIN numbered s ON s.id = c.id AND s.n = c.n + 1
), ends AS (
  SELECT id, arg_max(node, n) AS folded_root FROM climbed GROUP BY id
), proofs AS (
  SELECT id, sha256(string_agg(before || after, '' ORDER BY n)) AS proof_sha256 FROM numbered GROUP BY id
), top AS (
  SELECT arg_max(digest, level) AS root FROM crown
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed JOIN subroots USING (g) CROSS JOIN top JOIN ends USING (id) LEFT JOIN proofs USING (id)"""

_USABLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WHOLE = "list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint))"
_SCORE = "cast(list_dot_product(cast(a.v as double[]), cast(b.v as double[])) as bigint)"

TOP_K = f"""WITH rows AS (
  SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE embedding IS NOT NULL AND {_USABLE}
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, {_SCORE} AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, cast(rank as int) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5"""

NEGATIVES = f"""WITH rows AS (
  SELECT vec_id, {_WHOLE} AS v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_USABLE}
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, {_SCORE} AS score
  FROM rows a JOIN rows b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n
                 FROM scored WHERE alike) WHERE n <= 5
), ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
         s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike
   AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, cast(rank as int) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 3"""

ORACLE: dict[str, str] = {
    "op4_top_k": TOP_K,
    "op12_hard_negatives": NEGATIVES,
    "op13_merkle": MERKLE,
}
