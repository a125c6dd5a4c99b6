"""SQL of the corpus queries that SQL can express."""

from __future__ import annotations

from pixelloom.llm.phrases import LONGEST


def phrases_sql(least: int = 100, top: int = 2000, longest: int = LONGEST) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, words[i:i + {m - 1}] AS w FROM runs, range(1, len(words) - {m - 2}) AS t(i)" for m in range(1, longest + 1)
    )
    return f"""
    WITH runs AS (
        SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS words FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]'
            )) AS piece FROM documents)
    ), totals AS (
        SELECT lang, sum(len(words))::BIGINT AS n FROM runs GROUP BY lang
    ), grams AS MATERIALIZED (
        SELECT lang, w, count(*) AS f FROM ({grams}) GROUP BY lang, w HAVING count(*) >= {least}
    ), cuts AS MATERIALIZED (
        SELECT c.lang, c.w, c.f AS a, k::BIGINT AS k, p.f AS l, s.f AS r
        FROM (SELECT *, unnest(range(1, len(w))) AS k FROM grams WHERE len(w) > 1) c
        JOIN grams p ON p.lang = c.lang AND p.w = c.w[1:c.k]
        JOIN grams s ON s.lang = c.lang AND s.w = c.w[c.k + 1:]
    ), inside AS (
        SELECT DISTINCT g.lang, g.w[i:i + m - 1] AS w, g.f FROM grams g, range(2, {longest}) AS a(m), range(1, {longest}) AS b(i)
        WHERE m < len(g.w) AND i + m - 1 <= len(g.w)
    ), scored AS (
        SELECT c.lang, c.w, a, l, r, n, k, (1000::HUGEINT * a * n) // (l::HUGEINT * r) AS score
        FROM cuts c JOIN totals t ON t.lang = c.lang
        WHERE NOT EXISTS (SELECT 1 FROM inside e WHERE e.lang = c.lang AND e.w = c.w AND e.f >= c.a)
    ), best AS (
        SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS turn FROM scored
    ), ranked AS (
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank,
            array_to_string(w, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
        FROM best WHERE turn = 1
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""


def centroids_sql(k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64) -> str:
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT row, cluster, distance FROM (
                SELECT p.row, c.cluster, sum((p.v - c.v) * (p.v - c.v)) AS distance,
                    row_number() OVER (PARTITION BY p.row ORDER BY sum((p.v - c.v) * (p.v - c.v)), c.cluster) AS turn
                FROM points p JOIN middles{i} c ON c.dim = p.dim GROUP BY p.row, c.cluster) WHERE turn = 1)""")
        if i < rounds:
            steps.append(f"""middles{i + 1} AS MATERIALIZED (
                SELECT c.cluster, c.dim, coalesce(s.v, c.v) AS v FROM middles{i} c LEFT JOIN (
                    SELECT n.cluster, p.dim, (sum(p.v) - ((sum(p.v) % count(*)) + count(*)) % count(*)) // count(*) AS v
                    FROM near{i} n JOIN points p ON p.row = n.row GROUP BY n.cluster, p.dim
                ) s ON s.cluster = c.cluster AND s.dim = c.dim)""")
    return f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS row, vec_id, embedding FROM embeddings
        WHERE len(embedding) = {dims} AND NOT EXISTS (SELECT 1 FROM unnest(embedding) AS u(x) WHERE x IS NULL OR NOT isfinite(x))
    ), points AS MATERIALIZED (
        SELECT row, dim, floor({scale} * embedding[dim]::DOUBLE)::BIGINT AS v FROM kept, range(1, {dims + 1}) AS t(dim)
    ), first AS (
        SELECT row, row_number() OVER (ORDER BY vec_id IS NULL, sha256('1:' || vec_id), embedding) - 1 AS cluster FROM kept
    ), middles0 AS MATERIALIZED (
        SELECT cluster, dim, v FROM first JOIN points USING (row) WHERE cluster < {k}
    ), {', '.join(steps)}, names AS (
        SELECT cluster, sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM middles{rounds} GROUP BY cluster
    )
    SELECT k.vec_id, n.cluster::INTEGER AS cluster, n.distance::BIGINT AS distance,
        (sum(n.distance) OVER (PARTITION BY n.cluster))::BIGINT AS cluster_inertia, (sum(n.distance) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM near{rounds} n JOIN kept k ON k.row = n.row JOIN names c ON c.cluster = n.cluster"""


ARCHIVE = """
    WITH records AS (
        SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages
    ), shared AS (
        SELECT payload, max(page_id) AS keeper FROM records WHERE n >= 1000 GROUP BY payload
    )
    SELECT page_id, n AS payload_bytes, sha1(r.payload) AS payload_digest,
        CASE WHEN keeper IS NULL OR keeper IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN keeper IS DISTINCT FROM page_id THEN keeper END AS refers_to
    FROM records r LEFT JOIN shared s ON s.payload = r.payload"""

ORACLE: dict[str, str] = {
    "op11_phrases": phrases_sql(),
    "op12_centroids": centroids_sql(),
    "op13_archive": ARCHIVE,
}
