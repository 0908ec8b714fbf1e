"""DuckDB statements that define the results of operators SQL can express."""

from __future__ import annotations

from aftershock.llm import poisson_mix, site_lines

MIX = f"""
WITH RECURSIVE sizes AS (
    SELECT source, CAST(sum(coalesce(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), wanted AS (
    SELECT source, size, CASE WHEN size > 0 THEN pow(size, {poisson_mix.ALPHA}) ELSE 0 END AS wanted FROM sizes
), rates AS (
    SELECT source, CASE WHEN size > 0
        THEN wanted / (SELECT sum(wanted) FROM wanted) * (SELECT sum(size) FROM wanted) / size ELSE 1 END AS rate
    FROM wanted
), parts AS (
    SELECT source, rate, greatest(1, CAST(ceil(rate / {poisson_mix.PART_MEAN}) AS INT)) AS parts FROM rates
), steps AS (
    SELECT source, rate / parts AS mean, 0 AS k, exp(-rate / parts) AS p, exp(-rate / parts) AS reached FROM parts
    UNION ALL
    SELECT source, mean, k + 1, p * mean / (k + 1), reached + p * mean / (k + 1) FROM steps
    WHERE k < ceil(mean + 12 * sqrt(mean) + 12)
), named AS (
    SELECT *, coalesce(CAST(doc_id AS VARCHAR), '~' || md5(coalesce(text, ''))) AS who FROM documents
), draws AS (
    SELECT d.who, d.source, CAST('0x' || substr(
        md5('{poisson_mix.SEED}:' || d.who || ':' || part), 1, 13) AS BIGINT) / pow(2, 52) AS u
    FROM (SELECT DISTINCT who, source FROM named) d
    JOIN (SELECT source, unnest(range(1, parts + 1)) AS part FROM parts) p ON p.source IS NOT DISTINCT FROM d.source
), counts AS (
    SELECT x.who, x.source, count(*) AS n
    FROM draws x JOIN steps s ON s.source IS NOT DISTINCT FROM x.source AND s.reached <= x.u
    GROUP BY x.who, x.source
)
SELECT d.* EXCLUDE (who), round(r.rate, 9) AS rate, unnest(range(1, c.n + 1)) AS copy
FROM named d
JOIN counts c ON c.who = d.who AND c.source IS NOT DISTINCT FROM d.source
JOIN rates r ON r.source IS NOT DISTINCT FROM d.source
"""

LINES = f"""
WITH pages AS (
    SELECT DISTINCT coalesce(source, '') AS site, text FROM documents WHERE text IS NOT NULL
), totals AS (
    SELECT site, count(*) AS pages FROM pages GROUP BY site
), held AS (
    SELECT site, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM pages
), common AS (
    SELECT h.site, list(h.line) AS lines
    FROM (SELECT site, line, count(*) AS holders FROM held WHERE trim(line) <> '' GROUP BY site, line) h
    JOIN totals t ON t.site = h.site AND h.holders >= {site_lines.LEAST_HOLDERS} AND h.holders > t.pages * CASE
        WHEN length(trim(h.line)) - length(replace(trim(h.line), ' ', '')) >= {site_lines.LONG_WORDS - 1}
        THEN {site_lines.LONG_RATIO}::DOUBLE ELSE {site_lines.MAX_RATIO}::DOUBLE END
    GROUP BY h.site
), kept AS (
    SELECT d.*, string_split(d.text, chr(10)) AS own, coalesce(c.lines, []) AS common
    FROM documents d LEFT JOIN common c ON c.site = coalesce(d.source, '')
), filtered AS (
    SELECT *, list_filter(own, lambda x: NOT list_contains(common, x)) AS stay FROM kept
), sized AS (
    SELECT *, 2 * coalesce(list_sum(list_transform(stay, lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE length(x) END)), 0)
        < coalesce(list_sum(list_transform(own, lambda x: CASE WHEN trim(x) = '' THEN 0 ELSE length(x) END)), 0) AS mostly
    FROM filtered
)
SELECT doc_id, source, coalesce(len(own), 0) AS lines,
    CASE WHEN mostly THEN 0 ELSE coalesce(len(own) - len(stay), 0) END AS dropped,
    CASE WHEN mostly OR len(own) = len(stay) THEN text ELSE array_to_string(stay, chr(10)) END AS text
FROM sized
"""

SIMILAR = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\v\\f\\r]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s
    FROM words
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT u, v FROM pairs JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v
    WHERE 100 * common >= 90 * (x.n + y.n - common)
), reach AS (
    SELECT doc_id AS u, doc_id AS v FROM documents
    UNION
    SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.v) AS component_id
FROM documents d JOIN reach r ON r.u = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id
"""

PROJECTIONS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b
        ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_dot_product(a.e, b.e) >= 0.9 * sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))
), reach AS (
    SELECT vec_id AS u, vec_id AS v FROM embeddings
    UNION
    SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v
), counts AS (
    SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT e.vec_id, coalesce(any_value(c.n), 0) AS n_links, min(r.v) AS component_id, e.vec_id = min(r.v) AS kept
FROM embeddings e JOIN reach r ON r.u = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
GROUP BY e.vec_id
"""

NEGATIVES = """
WITH scaled AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM scaled a JOIN scaled b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank,
    s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""

ORACLE_SQL = {
    "op3_poisson_mix": MIX,
    "op6_site_lines": LINES,
    "op8_ngram_jaccard": SIMILAR,
    "op10_projection_dedup": PROJECTIONS,
    "op13_hard_negatives": NEGATIVES,
}
