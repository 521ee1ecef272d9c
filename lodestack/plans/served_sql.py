"""DuckDB SQL of the queries over snapshots and of the atlas, on the relations of catalogue_sql."""

from __future__ import annotations

from lodestack.plans import catalogue_sql
from lodestack.plans.catalogue_sql import _ANALYTICS, _LABELS, _TOP, _TRUTH, _stages, with_lens

#: The ring of most overlap by trying all; of its two directions the one whose second genre comes before its last.
RING = """
names AS (SELECT genre, row_number() OVER (ORDER BY genre) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT genre FROM shares)),
overlap AS (SELECT a.genre, b.genre AS other, sum(least(a.share, b.share)) AS w FROM shares a JOIN shares b USING (style) WHERE a.genre <> b.genre GROUP BY ALL),
walk(path, w) AS (SELECT [genre], 0.0::DOUBLE FROM names WHERE i = 1
  UNION ALL SELECT list_append(path, names.genre), walk.w + coalesce(overlap.w, 0) FROM walk JOIN names ON NOT list_contains(path, names.genre) LEFT JOIN overlap ON overlap.genre = path[-1] AND overlap.other = names.genre),
best AS (SELECT path FROM walk LEFT JOIN overlap ON overlap.genre = path[-1] AND overlap.other = path[1]
  WHERE len(path) = (SELECT max(n) FROM names) AND path[2] <= path[-1] ORDER BY round(walk.w + coalesce(overlap.w, 0), 9) DESC, path LIMIT 1),
ring AS (SELECT genre, (place - 1)::INT AS ring_order, path[place % len(path) + 1] AS following, path[(place + len(path) - 2) % len(path) + 1] AS preceding
  FROM (SELECT path, unnest(path) AS genre, generate_subscripts(path, 1) AS place FROM best))"""


def _month(name: str, floor: float) -> str:
    """Relations of a month's parents, sectors and nodes at a floor of shares."""
    return f"""
{name}_parents AS (SELECT style, genre, share, row_number() OVER (PARTITION BY style ORDER BY share DESC, genre) = 1 AS is_dominant FROM shares WHERE share >= {floor}),
{name}_widths AS (SELECT ring.*, sqrt(coalesce(m, 0) + 1) AS root FROM ring LEFT JOIN (SELECT genre, count(*) AS m FROM {name}_parents GROUP BY genre) USING (genre)),
{name}_sectors AS (SELECT genre, ring_order, s AS sector_start, s + w AS sector_end, 0.65 * cos(s + w / 2) AS x, 0.65 * sin(s + w / 2) AS y, following, preceding, w
  FROM (SELECT *, 2 * pi() * root / sum(root) OVER () AS w, 2 * pi() * coalesce(sum(root) OVER (ORDER BY ring_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(root) OVER () AS s FROM {name}_widths)),
{name}_slots AS (SELECT CASE WHEN is_dominant THEN 'style' ELSE 'ghost' END AS node_kind, p.style, p.genre, sector_start, w,
  (row_number() OVER (PARTITION BY p.genre ORDER BY coalesce(f.share, 0) - coalesce(b.share, 0), p.style) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY p.genre) AS u,
  (row_number() OVER (PARTITION BY p.genre ORDER BY emergence NULLS LAST, p.style) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY p.genre) AS v
  FROM {name}_parents p JOIN {name}_sectors s ON s.genre = p.genre LEFT JOIN shares f ON f.style = p.style AND f.genre = following LEFT JOIN shares b ON b.style = p.style AND b.genre = preceding
  LEFT JOIN (SELECT style, min(emergence) AS emergence FROM {_stages()} GROUP BY style) e ON e.style = p.style),
{name}_nodes AS (SELECT node_kind, style, genre, (0.35 + 0.6 * v) * cos(sector_start + w * (0.1 + 0.8 * u)) AS x, (0.35 + 0.6 * v) * sin(sector_start + w * (0.1 + 0.8 * u)) AS y FROM {name}_slots)"""


def _on_ring(body: str, *more: str) -> str:
    return with_lens(body, ", ".join((RING, *more))).replace("WITH ", "WITH RECURSIVE ", 1)


#: A point is in a hull if one of the triangles of its corners holds it.
HULLS = """
points AS (SELECT *, node_kind || style AS id FROM now_nodes),
held AS (SELECT DISTINCT p.id, p.style, p.genre, t.genre AS hull FROM points p JOIN
  (SELECT a.genre, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, sign((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS turn
   FROM points a JOIN points b ON a.genre = b.genre AND a.id < b.id JOIN points c ON b.genre = c.genre AND b.id < c.id) t
  ON turn <> 0 AND turn * ((bx - ax) * (p.y - ay) - (by_ - ay) * (p.x - ax)) >= -1e-12 AND turn * ((cx - bx) * (p.y - by_) - (cy - by_) * (p.x - bx)) >= -1e-12 AND turn * ((ax - cx) * (p.y - cy) - (ay - cy) * (p.x - cx)) >= -1e-12
  UNION SELECT id, style, genre, genre FROM points)"""

#: Lifecycles by year for a month of 2003.
YEARS = """
year_counts AS (SELECT style, year AS period, count(*)::DOUBLE AS n FROM in_style JOIN releases USING (release_id) WHERE year IS NOT NULL AND year <= 2002 GROUP BY ALL),
style_grid AS (SELECT style, period, coalesce(n, 0) AS n FROM (SELECT DISTINCT style FROM year_counts) CROSS JOIN (SELECT unnest(range((SELECT min(period) FROM year_counts), 2003))::INT AS period) LEFT JOIN year_counts USING (style, period)),
genre_counts AS (SELECT genre AS style, year AS period, count(*)::DOUBLE AS n FROM in_genre JOIN releases USING (release_id) WHERE year IS NOT NULL AND year <= 2002 GROUP BY ALL),
genre_grid AS (SELECT style, period, coalesce(n, 0) AS n FROM (SELECT DISTINCT style FROM genre_counts) CROSS JOIN (SELECT unnest(range((SELECT min(period) FROM genre_counts), 2003))::INT AS period) LEFT JOIN genre_counts USING (style, period))"""


def oracle_sql() -> dict[str, str]:
    base = catalogue_sql.oracle_sql()
    named = "['absent', 'emerging', 'established', 'declining', 'reviving']"
    by_style, by_genre = _stages().replace("FROM grid", "FROM style_grid"), _stages().replace("FROM grid", "FROM genre_grid")
    recall = base["top_k_recall"]
    now, old = _month("now", 0.565), _month("old", 0.20)
    read = lambda since, who: f"""SELECT occurred_at::DATE AS summary_date, 'event_type' AS dimension, event_type AS dimension_key, count(*)::BIGINT AS record_count, count(DISTINCT subject_id)::BIGINT AS subject_count, NULL::BIGINT AS candidate_set_count
        FROM ev {who} WHERE k % 2 = 1 AND occurred_at >= TIMESTAMP '2024-01-{since[0]}' AND occurred_at < TIMESTAMP '2024-01-{since[1]}' GROUP BY ALL
        UNION ALL SELECT occurred_at::DATE, 'policy_id', policy_id, count(*), count(DISTINCT subject_id), count(DISTINCT candidate_set_id) FROM im {who} WHERE k % 2 = 1 AND occurred_at >= TIMESTAMP '2024-01-{since[0]}' AND occurred_at < TIMESTAMP '2024-01-{since[1]}' GROUP BY ALL"""  # noqa: E731
    # The read goes back nine days from January 26, so to January 18.
    return {
        "served_top_artists": f"SELECT * FROM ({base['artist_centrality']}) WHERE rank <= 25",
        "served_genre_trends": with_lens("SELECT genre, decade, release_count, (SELECT arg_max(decade, release_count * 10000 - decade) FROM trends WHERE genre = (SELECT min(genre) FROM trends))::INT AS peak_decade FROM trends WHERE genre = (SELECT min(genre) FROM trends)"),
        "served_label_longevity": with_lens(
            "SELECT rank, label_id, label_name, first_year, last_year, years_active, total_releases, peak_decade, still_active, is_placeholder FROM placed, edge WHERE (NOT is_placeholder AND rank <= 20) OR (is_placeholder AND (edge IS NULL OR place < edge))",
            _LABELS + ", placed AS (SELECT *, row_number() OVER (ORDER BY years_active DESC, total_releases DESC, label_id) AS place FROM ranked), edge AS (SELECT max(place) AS edge FROM placed WHERE NOT is_placeholder AND rank = 20)",
        ),
        "served_release_rarity": f"SELECT * FROM ({base['release_rarity']}) ORDER BY rarity_score DESC, release_id LIMIT 50",
        "release_rarity_parts": base["release_rarity"].rsplit("SELECT release_id::VARCHAR", 1)[0] + """SELECT r.release_id::VARCHAR AS release_id, round(l, 9) AS label_catalog, round(coalesce(old, 0), 9) AS temporal_scarcity, round(a, 9) AS graph_isolation, round(g, 9) AS collection_prevalence,
            (SELECT coalesce(string_agg(label_id::VARCHAR, ',' ORDER BY label_id), '') FROM on_label x WHERE x.release_id = r.release_id) AS label_ids, (SELECT coalesce(string_agg(artist_id::VARCHAR, ',' ORDER BY artist_id), '') FROM by_artist x WHERE x.release_id = r.release_id) AS artist_ids
            FROM releases r JOIN per USING (release_id) LEFT JOIN old USING (year)""",
        "served_this_month": base["anniversaries"],
        "served_data_completeness": base["data_completeness"],
        "served_activity_summary": with_lens(f"SELECT * FROM ({read((20, 27), f'SEMI JOIN {_ANALYTICS} e USING (subject_id)')}) UNION ALL SELECT * FROM ({read((18, 20), '')})"),
        "served_style_cotags": with_lens("SELECT style, other, release_count, rank FROM (SELECT *, row_number() OVER (PARTITION BY style ORDER BY release_count DESC, other)::INT AS rank FROM (SELECT a.style, b.style AS other, count(*)::BIGINT AS release_count FROM in_style a JOIN in_style b USING (release_id) WHERE a.style <> b.style GROUP BY ALL)) WHERE rank <= 25 AND style = (SELECT min(a.style) FROM in_style a JOIN in_style b USING (release_id) WHERE a.style <> b.style)"),
        "served_style_atlas": with_lens(
            f"""SELECT p.style, p.genre, {named}[coalesce(last.stage, 0) + 1] AS stage, {named}[coalesce(settled.stage, 0) + 1] AS settled_stage, last.emergence AS emergence_year,
            (SELECT string_agg(stage::VARCHAR, '' ORDER BY period) FROM {by_style} t WHERE t.style = p.style) AS stages, (SELECT count(*) FROM parents x WHERE x.style = p.style)::BIGINT AS parents,
            (SELECT count(*) FROM parents x JOIN (SELECT style AS genre, min(emergence) AS born FROM {by_genre} GROUP BY 1) y USING (genre) WHERE x.style = p.style AND last.emergence > born)::BIGINT AS later_than
            FROM parents p LEFT JOIN {by_style} last ON last.style = p.style AND last.period = 2002 LEFT JOIN {by_style} settled ON settled.style = p.style AND settled.period = 2000 WHERE is_dominant""",
            YEARS,
        ),
        "snapshot_upsert": """WITH e AS (SELECT CASE WHEN user_id % 7 <> 0 THEN user_id END AS subject, event_type, event_id, event_id % 3 AS part FROM events WHERE event_id % 3 < 2)
            SELECT subject, arg_max(event_type, part * 1000000000000 + event_id) AS event_type, coalesce(min(CASE WHEN part = 0 THEN event_id END), min(event_id)) AS first_event FROM e GROUP BY subject""",
        "snapshot_replace": "SELECT event_id, event_type FROM events WHERE coalesce(event_type <> 'click', true) OR event_id % 2 = 0",
        "snapshot_once": with_lens("SELECT genre, decade, release_count * f AS release_count, m AS month FROM trends, (VALUES (1, DATE '2024-01-01'), (2, DATE '2024-02-01')) t(f, m)"),
        "snapshot_pair": "SELECT n_nationkey AS key, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region",
        "embeddings_read_back": "SELECT vec_id AS id, CASE vec_id % 2 WHEN 0 THEN 'method@d1' ELSE 'method@d2' END AS model_version, len(embedding)::BIGINT AS dim, embedding[1]::DOUBLE AS first_value FROM embeddings",
        "served_similar_artists": f"SELECT id, string_agg(neighbour, ',' ORDER BY rank) AS neighbours FROM {_TOP % _TRUTH} WHERE rank <= 10 AND id = (SELECT min(vec_id::VARCHAR) FROM embeddings) GROUP BY id",
        "release_rotation": "SELECT 'v3' AS model_version, true AS is_current, (SELECT count(*) FROM embeddings WHERE vec_id::VARCHAR < '3')::BIGINT AS queries UNION ALL SELECT 'v2', false, (SELECT count(*) FROM embeddings WHERE vec_id::VARCHAR < '5')",
        "run_log": "SELECT * FROM (VALUES ('genre_trends', 'completed', 3::BIGINT, NULL::VARCHAR), ('style_atlas', 'interrupted', NULL, NULL), ('label_longevity', 'failed', NULL, 'no rows')) t(insight_type, status, rows_affected, error_message)",
        "load_latches": "SELECT event_type AS loader, event_id::VARCHAR AS version, event_type = 'view' AND CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 3 DAYS ELSE ts END >= TIMESTAMP '2024-01-18' AS blocks FROM events",
        "recall_by_degree": f"""WITH recall AS ({recall}), degree AS (SELECT o_custkey::VARCHAR AS id, count(*) AS d FROM orders GROUP BY 1)
            SELECT CASE WHEN d >= 256 THEN '256+' WHEN d >= 128 THEN '128-255' WHEN d >= 64 THEN '64-127' WHEN d >= 32 THEN '32-63' WHEN d >= 16 THEN '16-31' WHEN d >= 8 THEN '8-15' WHEN d >= 4 THEN '4-7' WHEN d >= 2 THEN '2-3' ELSE '1' END AS bucket,
            count(*)::BIGINT AS queries, avg(strict) AS strict, avg(tolerant) AS tolerant FROM recall JOIN degree USING (id) GROUP BY 1""",
        "reranked_neighbours": f"""WITH near AS (SELECT * FROM {_TOP % _TRUTH} WHERE rank <= 50 AND (id::INT + neighbour::INT) % 5 <> 0)
            SELECT id, neighbour, round(score, 6) AS score, rank FROM (SELECT id, neighbour, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour)::INT AS rank FROM near) WHERE rank <= 10""",
        "zero_filled_vectors": "SELECT c_custkey AS id, 64::BIGINT AS dim, coalesce(embedding[1], 0)::DOUBLE AS first_value FROM customer LEFT JOIN embeddings ON vec_id = c_custkey AND vec_id % 3 = 0",
        "similar_lists": f"SELECT id, list(neighbour ORDER BY rank) AS neighbours, list(score::FLOAT ORDER BY rank) AS scores FROM {_TOP % _TRUTH} WHERE rank <= 50 GROUP BY id",
        "atlas_sectors": _on_ring("SELECT genre, ring_order, sector_start, sector_end, x, y FROM now_sectors", now),
        "atlas_layout": _on_ring("SELECT * FROM now_nodes", now),
        "atlas_movement": _on_ring(
            "SELECT count(*)::BIGINT AS styles, quantile_cont(m, 0.5) AS median_nn, quantile_cont(m, 0.95) AS p95_nn, max(m) AS max_nn, avg((m > 1)::INT::DOUBLE) AS share_over_1nn FROM (SELECT gone / (SELECT quantile_cont(near, 0.5) FROM gaps) AS m FROM gaps) HAVING count(*) >= 2",
            now, old,
            "drawn AS (SELECT o.style, o.x, o.y, n.x AS nx, n.y AS ny FROM old_nodes o JOIN now_nodes n USING (style) WHERE o.node_kind = 'style' AND n.node_kind = 'style')",
            "gaps AS (SELECT a.style, sqrt((a.nx - a.x) ** 2 + (a.ny - a.y) ** 2) AS gone, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS near FROM drawn a JOIN drawn b ON a.style <> b.style GROUP BY ALL)",
        ),
        "atlas_hull_check": _on_ring(
            """SELECT (SELECT count(DISTINCT (id, genre)) FROM held h WHERE NOT EXISTS (FROM now_parents p WHERE p.style = h.style AND p.genre = h.hull))::BIGINT AS intruding_nodes,
            (SELECT count(*) FROM now_parents p WHERE NOT EXISTS (FROM held h WHERE h.style = p.style AND h.hull = p.genre))::BIGINT AS omitted_pairs, (SELECT count(*) FROM now_parents)::BIGINT AS parent_pairs""",
            now, HULLS,
        ),
    }
