"""DuckDB SQL for the operators on vectors: every pair is compared."""

#: Rows whose vector is not null and holds finite components only, as doubles in ``e``.
FINITE = """
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

HARD_NEGATIVES = f"""
WITH finite AS ({FINITE}), r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           list_transform(e, lambda x: floor(256 * x)) AS v
    FROM finite WHERE label IS NOT NULL
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""


def part_codes(parts=4, entries=256, rounds=4, scale=1024):
    """The rounds one after another; codebooks are rows of (part, entry, numbers)."""
    steps = [f"""
WITH finite AS ({FINITE}), kept AS (
    SELECT vec_id, label, list_transform(e, lambda x: floor({scale} * x)) AS v, CAST(len(e) AS BIGINT) // {parts} AS width,
           row_number() OVER (ORDER BY vec_id) AS n
    FROM finite
), p AS (
    SELECT vec_id, label, n, CAST(part AS INTEGER) AS part, v[part * width + 1:(part + 1) * width] AS x FROM kept, range({parts}) t(part)
), b0 AS (SELECT part, n - 1 AS entry, x AS c FROM p WHERE n <= {entries})"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
    SELECT p.part, p.n, arg_min(entry, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), entry)) AS entry,
           min(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)) AS d
    FROM p JOIN b{k} b ON p.part = b.part GROUP BY p.part, p.n
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
    SELECT part, entry, list(value ORDER BY pos) AS c FROM (
        SELECT part, entry, pos, floor(sum(value) / count(*)) AS value FROM (
            SELECT p.part, a.entry, unnest(x) AS value, generate_subscripts(x, 1) AS pos FROM p JOIN a{k} a USING (part, n))
        GROUP BY part, entry, pos) GROUP BY part, entry
), b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (part, entry))""")
    steps.append(f"""coded AS (
    SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY n
), books AS (
    SELECT sha256(string_agg(CAST(CAST(value AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (
        SELECT part, entry, unnest(c) AS value, generate_subscripts(c, 1) AS pos FROM b{rounds})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), books""")
    return ", ".join(steps[:-1]) + ", " + steps[-1]


NEAR_DUPLICATES = f"""
WITH RECURSIVE finite AS ({FINITE}), v AS (
    SELECT vec_id, label, e FROM finite WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reached AS (
    SELECT vec_id, vec_id AS node FROM v
    UNION
    SELECT reached.vec_id, links.other FROM reached JOIN links ON links.vec_id = reached.node
), component AS (
    SELECT vec_id, min(node) AS component_id FROM reached GROUP BY vec_id
), counted AS (
    SELECT vec_id, count(*) AS n_links FROM links GROUP BY vec_id
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN component USING (vec_id) LEFT JOIN counted USING (vec_id)
"""
