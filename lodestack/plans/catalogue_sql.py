"""DuckDB SQL of the registered queries; a prelude defines the relations that sources.lens defines."""

from __future__ import annotations

LENS = """
releases AS (SELECT o_orderkey AS release_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders),
in_style AS (SELECT DISTINCT l_orderkey AS release_id, p_brand AS style FROM lineitem JOIN part ON l_partkey = p_partkey),
in_genre AS (SELECT DISTINCT l_orderkey AS release_id, p_type AS genre FROM lineitem JOIN part ON l_partkey = p_partkey),
by_artist AS (SELECT DISTINCT l_orderkey AS release_id, l_suppkey AS artist_id FROM lineitem),
on_label AS (SELECT DISTINCT l_orderkey AS release_id, l_partkey AS label_id FROM lineitem),
derived_from AS (SELECT o_orderkey AS release_id, o_custkey AS master_id FROM orders),
artists AS (SELECT s_suppkey AS artist_id, s_name AS artist_name FROM supplier),
labels_ AS (SELECT p_partkey AS label_id, p_name AS label_name, p_brand = 'Brand#1' AS is_placeholder FROM part),
masters AS (SELECT c_custkey AS master_id, c_name AS title, year(f)::INT AS year, month(f)::INT AS month FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey),
credits AS (SELECT p_name AS person_name, l_orderkey AS release_id, CASE l_returnflag WHEN 'A' THEN 'production' WHEN 'N' THEN 'design' ELSE 'session' END AS role_category FROM lineitem JOIN part ON l_partkey = p_partkey),
track_credits AS (SELECT p_name AS person_name, l_orderkey AS release_id, CASE l_linestatus WHEN 'F' THEN 'engineering' ELSE 'design' END AS role_category FROM lineitem JOIN part ON l_partkey = p_partkey),
same_as AS (SELECT DISTINCT p_name AS person_name, s_suppkey AS artist_id FROM part JOIN supplier ON p_partkey = s_suppkey),
ev AS (SELECT event_id, event_type, user_id AS subject_id, ts AS occurred_at, json_extract_string(props, '$.k')::INT AS k FROM events),
im AS (SELECT event_id AS impression_id, subject_id, 'policy-' || (k % 4)::VARCHAR AS policy_id, subject_id * 100 + k AS candidate_set_id, occurred_at, k FROM ev WHERE event_type = 'view'),
grants AS (SELECT DISTINCT user_id, purpose, CASE WHEN user_id % 11 = 0 THEN TIMESTAMP '2024-02-15' ELSE TIMESTAMP '2023-12-01' END AS granted_at, CASE WHEN user_id % 7 = 0 THEN TIMESTAMP '2024-01-10' END AS revoked_at
  FROM events, (VALUES ('analytics', 5), ('training', 4)) p(purpose, step) WHERE user_id % step <> 0),
shares AS (SELECT style, genre, n AS release_count, t AS style_release_count, n::DOUBLE / t AS share
  FROM (SELECT style, genre, count(*) AS n FROM in_style JOIN in_genre USING (release_id) GROUP BY ALL) JOIN (SELECT style, count(*) AS t FROM in_style GROUP BY ALL) USING (style)),
parents AS (SELECT style, genre, share, row_number() OVER (PARTITION BY style ORDER BY share DESC, genre) = 1 AS is_dominant FROM shares WHERE share >= 0.565),
trends AS (SELECT genre, (year // 10 * 10)::INT AS decade, count(*)::BIGINT AS release_count FROM in_genre JOIN releases USING (release_id) WHERE year IS NOT NULL GROUP BY ALL),
periods AS (SELECT style, ((year - 1995) * 12 + month - 1)::INT AS period, count(*)::DOUBLE AS n FROM in_style JOIN releases USING (release_id) WHERE year IS NOT NULL GROUP BY ALL),
grid AS (SELECT s.style, p.period, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT style FROM periods WHERE period <= 79) s,
  (SELECT unnest(range((SELECT min(period) FROM periods), 80))::INT AS period) p LEFT JOIN periods x ON x.style = s.style AND x.period = p.period),
edges_ AS (
  SELECT 'by_artist' AS relation, 'r:' || release_id AS src, 'a:' || artist_id AS dst FROM by_artist
  UNION ALL SELECT 'on_label', 'r:' || release_id, 'l:' || label_id FROM on_label
  UNION ALL SELECT 'derived_from', 'r:' || release_id, 'm:' || master_id FROM derived_from
  UNION ALL SELECT 'in_genre', 'r:' || release_id, 'g:' || genre FROM in_genre
  UNION ALL SELECT 'in_style', 'r:' || release_id, 's:' || style FROM in_style
  UNION ALL SELECT DISTINCT 'credited_on', 'r:' || release_id, 'a:' || artist_id FROM credits JOIN same_as USING (person_name) WHERE role_category IN ('production', 'engineering', 'session', 'other')
  UNION ALL SELECT DISTINCT 'track_credited_on', 'r:' || release_id, 'a:' || artist_id FROM track_credits JOIN same_as USING (person_name) WHERE role_category IN ('production', 'engineering', 'session', 'other')
  UNION ALL SELECT DISTINCT 'track_by_artist', 'r:' || l_orderkey, 'a:' || s_suppkey FROM lineitem JOIN supplier ON l_partkey = s_suppkey
  UNION ALL SELECT 'master_by_artist', 'm:' || c_custkey, 'a:' || s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey
  UNION ALL SELECT 'master_in_genre', 'm:' || c_custkey, 'g:' || p_type FROM customer JOIN part ON c_custkey = p_partkey
  UNION ALL SELECT 'master_in_style', 'm:' || c_custkey, 's:' || p_brand FROM customer JOIN part ON c_custkey = p_partkey),
both_ AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges_ UNION ALL SELECT dst, src FROM edges_))
"""


def _stages(rule: dict | None = None) -> str:
    r = {"total": 25, "share": 0.5, "years": 10, "ratio": 1.5, "floor": 0.25} | (rule or {})
    return f"""(
  WITH a AS (SELECT *, avg(n) OVER (PARTITION BY style ORDER BY period ROWS 2 PRECEDING) AS c, sum(n) OVER (PARTITION BY style ORDER BY period) AS total FROM grid),
  b AS (SELECT *, max(c) OVER (PARTITION BY style ORDER BY period) AS peak, total >= {r["total"]} AS live FROM a),
  d AS (SELECT *, min(CASE WHEN live THEN period END) OVER (PARTITION BY style) AS emergence, live AND c >= {r["share"]} * peak AS active FROM b),
  e AS (SELECT *, sum(CASE WHEN active OR NOT live THEN 1 ELSE 0 END) OVER (PARTITION BY style ORDER BY period) AS spell FROM d),
  f AS (SELECT *, min(CASE WHEN live AND NOT active THEN c END) OVER (PARTITION BY style, spell ORDER BY period) AS trough FROM e)
  SELECT style, period, n, emergence, (CASE WHEN NOT live THEN 0 WHEN active AND period - emergence < {r["years"]} THEN 1 WHEN active THEN 2
    WHEN c >= {r["ratio"]} * trough AND c >= {r["floor"]} * peak THEN 4 ELSE 3 END)::INT AS stage FROM f)"""


_TRUTH = """(SELECT a.vec_id::VARCHAR AS id, b.vec_id::VARCHAR AS neighbour, coalesce(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  nullif(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 0), 0) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"""
_TOP = "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, neighbour) AS rank FROM %s)"
_ELIGIBLE = """(SELECT user_id AS subject_id FROM grants WHERE purpose IN (%s) AND revoked_at IS NULL AND granted_at <= TIMESTAMP '2024-01-31' GROUP BY 1 HAVING count(DISTINCT purpose) = %d)"""
_BOTH = _ELIGIBLE % ("'analytics', 'training'", 2)
_ANALYTICS = _ELIGIBLE % ("'analytics'", 1)
_LABELS = """
spans AS (SELECT label_id::VARCHAR AS label_id, label_name, is_placeholder, min(year)::INT AS first_year, max(year)::INT AS last_year, (max(year) - min(year))::INT AS years_active, count(*)::BIGINT AS total_releases
  FROM on_label JOIN releases USING (release_id) JOIN labels_ USING (label_id) WHERE year IS NOT NULL AND label_name <> '' GROUP BY ALL),
peaks AS (SELECT label_id, arg_max(decade, n * 10000 - decade)::INT AS peak_decade FROM (SELECT label_id::VARCHAR AS label_id, (year // 10 * 10)::INT AS decade, count(*) AS n FROM on_label JOIN releases USING (release_id) WHERE year IS NOT NULL GROUP BY ALL) GROUP BY 1),
pos AS (SELECT *, row_number() OVER (ORDER BY years_active DESC, total_releases DESC, label_id) AS place, row_number() OVER (PARTITION BY is_placeholder ORDER BY years_active DESC, total_releases DESC, label_id) AS of_kind FROM spans),
lim AS (SELECT least(50, count(*)) AS reals, CASE WHEN count(*) >= 50 THEN max(place) END AS last FROM pos WHERE NOT is_placeholder AND of_kind <= 50),
ranked AS (SELECT (CASE WHEN is_placeholder THEN of_kind + reals ELSE of_kind END)::INT AS rank, label_id, label_name, first_year, last_year, years_active, total_releases, peak_decade, last_year >= 2001 - 2 AS still_active, is_placeholder
  FROM pos JOIN peaks USING (label_id), lim WHERE of_kind <= 50 AND (NOT is_placeholder OR last IS NULL OR place < last))
"""
_SIGNALS = """
deg AS (SELECT 'artist' AS s, artist_id::VARCHAR AS k, count(*) AS d FROM by_artist GROUP BY ALL UNION ALL SELECT 'label', label_id::VARCHAR, count(*) FROM on_label GROUP BY ALL UNION ALL SELECT 'genre', genre, count(*) FROM in_genre GROUP BY ALL),
rel AS (SELECT 'artist' AS s, release_id, artist_id::VARCHAR AS k FROM by_artist UNION ALL SELECT 'label', release_id, label_id::VARCHAR FROM on_label UNION ALL SELECT 'genre', release_id, genre FROM in_genre),
sig AS (SELECT r.release_id, x.s AS signal, coalesce(max(d), 0)::BIGINT AS value FROM releases r CROSS JOIN (VALUES ('artist'), ('label'), ('genre')) x(s) LEFT JOIN rel ON rel.release_id = r.release_id AND rel.s = x.s LEFT JOIN deg ON deg.s = x.s AND deg.k = rel.k GROUP BY ALL),
cnt AS (SELECT signal, value, count(*)::BIGINT AS releases FROM sig GROUP BY ALL)
"""


def with_lens(body: str, more: str = "") -> str:
    return f"WITH {LENS}{', ' + more if more else ''} {body}"


def oracle_sql() -> dict[str, str]:
    month = lambda rule=None: f"FROM {_stages(rule)}"
    q = {
        "genre_trends": "SELECT * FROM trends",
        "genre_peak_decade": "SELECT genre, arg_max(decade, release_count * 10000 - decade) AS peak_decade, sum(release_count)::BIGINT AS total FROM trends GROUP BY genre",
        "artist_centrality": "SELECT row_number() OVER (ORDER BY n DESC, a)::INT AS rank, a AS artist_id, artist_name, n AS edge_count FROM (SELECT artist_id::VARCHAR AS a, artist_name, count(*)::BIGINT AS n FROM by_artist JOIN artists USING (artist_id) WHERE artist_name <> '' GROUP BY ALL) ORDER BY rank LIMIT 100",
        "style_year_counts": "SELECT style, year, count(DISTINCT release_id)::BIGINT AS release_count, count(DISTINCT master_id)::BIGINT AS master_count FROM in_style JOIN releases USING (release_id) LEFT JOIN derived_from USING (release_id) WHERE year IS NOT NULL GROUP BY ALL",
        "genre_year_counts": "SELECT genre, year, count(*)::BIGINT AS release_count FROM in_genre JOIN releases USING (release_id) WHERE year IS NOT NULL GROUP BY ALL",
        "style_genre_shares": "SELECT * FROM shares",
        "style_parents": "SELECT * FROM parents",
        "style_landmarks": "SELECT style, m AS master_id, coalesce(title, '') AS title, year, n AS release_count, rank FROM (SELECT *, master_id::VARCHAR AS m, row_number() OVER (PARTITION BY style ORDER BY n DESC, master_id::VARCHAR)::INT AS rank FROM (SELECT style, master_id, count(*)::BIGINT AS n FROM in_style JOIN derived_from USING (release_id) GROUP BY ALL)) JOIN masters USING (master_id) WHERE rank <= 25",
        "style_cotags": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY style ORDER BY release_count DESC, other)::INT AS rank FROM (SELECT a.style, b.style AS other, count(*)::BIGINT AS release_count FROM in_style a JOIN in_style b USING (release_id) WHERE a.style <> b.style GROUP BY ALL)) WHERE rank <= 10",
        "anniversaries": "SELECT master_id::VARCHAR AS master_id, coalesce(title, '') AS title, NULL::VARCHAR AS artist_name, year AS release_year, (2025 - year)::INT AS anniversary, 2025 AS computed_year, 3 AS computed_month FROM masters WHERE month = 3 AND 2025 - year IN (25, 30, 40, 50, 75, 100)",
        "data_completeness": """SELECT 'release' AS entity_type, count(*)::BIGINT AS total_count, 0::BIGINT AS with_image, count(year)::BIGINT AS with_year, 0::BIGINT AS with_country, count(g)::BIGINT AS with_genre, (count(year)::DOUBLE / count(*) + count(g)::DOUBLE / count(*)) * 100 / 2 AS completeness_pct
            FROM releases LEFT JOIN (SELECT DISTINCT release_id, 1 AS g FROM in_genre) USING (release_id)
            UNION ALL SELECT 'master', count(*), 0, count(year), 0, 0, (count(year)::DOUBLE / count(*)) * 100 FROM masters
            UNION ALL SELECT 'artist', count(*), count(CASE WHEN s_acctbal > 0 THEN 1 END), 0, 0, 0, NULL FROM supplier
            UNION ALL SELECT 'label', count(*), 0, 0, count(CASE WHEN p_size > 10 THEN 1 END), count(p_type), (count(CASE WHEN p_size > 10 THEN 1 END)::DOUBLE / count(*) + count(p_type)::DOUBLE / count(*)) * 100 / 2 FROM part""",
        "eligible_subjects": f"SELECT subject_id FROM {_BOTH}",
        "consented_events": f"SELECT event_id, event_type, subject_id, occurred_at FROM ev SEMI JOIN {_BOTH} e USING (subject_id) WHERE k % 2 = 1 AND k % 3 = 0 AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'",
        "consented_impressions": f"SELECT impression_id, subject_id, policy_id, candidate_set_id, occurred_at FROM im SEMI JOIN {_ANALYTICS} e USING (subject_id) WHERE k % 2 = 1 AND policy_id IN ('policy-1', 'policy-3') AND occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-20'",
        "events_keyset_page": "SELECT event_id, occurred_at, event_type FROM ev WHERE (occurred_at, event_id) > (TIMESTAMP '2024-01-10', 0) ORDER BY occurred_at, event_id LIMIT 500",
        "activity_summary": f"""SELECT occurred_at::DATE AS summary_date, 'event_type' AS dimension, event_type AS dimension_key, count(*)::BIGINT AS record_count, count(DISTINCT subject_id)::BIGINT AS subject_count, NULL::BIGINT AS candidate_set_count FROM ev SEMI JOIN {_ANALYTICS} e USING (subject_id) WHERE k % 2 = 1 AND occurred_at >= TIMESTAMP '2024-01-20' AND occurred_at < TIMESTAMP '2024-01-27' GROUP BY ALL
            UNION ALL SELECT occurred_at::DATE, 'policy_id', policy_id, count(*), count(DISTINCT subject_id), count(DISTINCT candidate_set_id) FROM im SEMI JOIN {_ANALYTICS} e USING (subject_id) WHERE k % 2 = 1 AND occurred_at >= TIMESTAMP '2024-01-20' AND occurred_at < TIMESTAMP '2024-01-27' GROUP BY ALL""",
        "style_emergence": f"SELECT style, min(emergence)::INT AS emergence {month()} GROUP BY style",
        "style_lifecycle_stages": f"SELECT style, period, n, emergence, stage {month()}",
        "lifecycle_flip_share": f"SELECT coalesce(avg((a.stage <> b.stage)::INT::DOUBLE), 0) AS flip_share FROM {_stages()} a JOIN {_stages({'share': 0.5 * 1.1})} b USING (style, period) WHERE a.stage <> 0 OR b.stage <> 0",
        "genre_affinity": "SELECT a.genre, b.genre AS other, round(sum(least(a.share, b.share)), 6) AS affinity FROM shares a JOIN shares b USING (style) WHERE a.genre <> b.genre GROUP BY ALL",
        "atlas_members": "SELECT genre, count(*)::BIGINT AS members FROM parents GROUP BY genre",
        "atlas_ranks": f"""SELECT CASE WHEN is_dominant THEN 'style' ELSE 'ghost' END AS node_kind, p.style, p.genre, coalesce(f.share, 0) - coalesce(b.share, 0) AS lean,
            (row_number() OVER (PARTITION BY p.genre ORDER BY coalesce(f.share, 0) - coalesce(b.share, 0), p.style) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY p.genre) AS u,
            (row_number() OVER (PARTITION BY p.genre ORDER BY emergence NULLS LAST, p.style) - 0.5)::DOUBLE / count(*) OVER (PARTITION BY p.genre) AS v
            FROM parents p JOIN (SELECT genre, coalesce(lead(genre) OVER (ORDER BY genre), min(genre) OVER ()) AS following, coalesce(lag(genre) OVER (ORDER BY genre), max(genre) OVER ()) AS preceding FROM (SELECT DISTINCT genre FROM shares)) r ON r.genre = p.genre
            LEFT JOIN shares f ON f.style = p.style AND f.genre = r.following LEFT JOIN shares b ON b.style = p.style AND b.genre = r.preceding LEFT JOIN (SELECT style, min(emergence) AS emergence {month()} GROUP BY style) e ON e.style = p.style""",
        "credited_artist_edges": "SELECT DISTINCT release_id, artist_id FROM credits JOIN same_as USING (person_name) WHERE role_category IN ('production', 'engineering', 'session', 'other')",
        "discovered_releases": "SELECT DISTINCT release_id FROM credits WHERE role_category IN ('production', 'engineering', 'session', 'other')",
        "edge_report": "SELECT relation, count(*)::BIGINT AS edges, count(DISTINCT src)::BIGINT AS sources, count(DISTINCT dst)::BIGINT AS targets FROM edges_ GROUP BY relation",
        "vertex_counts": "SELECT split_part(src, ':', 1) AS kind, count(DISTINCT src)::BIGINT AS vertices FROM both_ GROUP BY 1",
        "vertex_degree": "SELECT src AS vertex, count(*)::BIGINT AS degree FROM both_ GROUP BY src",
        "transition_weights": "SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS weight FROM both_",
        "exact_top_k": f"SELECT id, neighbour, round(score, 6) AS score, rank::INT AS rank FROM {_TOP % _TRUTH} WHERE rank <= 10",
        "top_k_recall": f"""WITH t AS (SELECT * FROM {_TOP % _TRUTH} WHERE rank <= 10), f AS (SELECT * FROM {_TOP % f"(SELECT * FROM {_TRUTH} WHERE (id::INT + neighbour::INT) % 5 <> 0)"} WHERE rank <= 10),
            x AS (SELECT id, count(*) AS w, min(score) AS edge FROM t GROUP BY id), s AS (SELECT id, count(*) AS h FROM t JOIN f USING (id, neighbour) GROUP BY id), n AS (SELECT f.id, count(*) AS h FROM f JOIN x ON x.id = f.id AND f.score >= x.edge - 0.0001 GROUP BY f.id)
            SELECT x.id, coalesce(s.h, 0)::DOUBLE / w AS strict, least(coalesce(n.h, 0)::DOUBLE / w, 1.0) AS tolerant FROM x LEFT JOIN s USING (id) LEFT JOIN n USING (id)""",
        "churn_jaccard": f"""WITH t AS (SELECT * FROM {_TOP % _TRUTH} WHERE rank <= 10), f AS (SELECT * FROM {_TOP % f"(SELECT * FROM {_TRUTH} WHERE (id::INT + neighbour::INT) % 5 <> 0)"} WHERE rank <= 10)
            SELECT t.id, count(f.id)::DOUBLE / (10 + 10 - count(f.id)) AS jaccard FROM t LEFT JOIN f USING (id, neighbour) GROUP BY t.id""",
        "duplicate_vectors": "SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 20 THEN '5-20' ELSE '21+' END AS bucket, count(*)::BIGINT AS groups, sum(n)::BIGINT AS vectors FROM (SELECT embedding, count(*) AS n FROM (SELECT embedding FROM embeddings UNION ALL SELECT embedding FROM embeddings WHERE vec_id % 3 = 0) GROUP BY embedding) GROUP BY 1",
        "degree_buckets": "SELECT CASE WHEN d >= 256 THEN '256+' WHEN d >= 128 THEN '128-255' WHEN d >= 64 THEN '64-127' WHEN d >= 32 THEN '32-63' WHEN d >= 16 THEN '16-31' WHEN d >= 8 THEN '8-15' WHEN d >= 4 THEN '4-7' WHEN d >= 2 THEN '2-3' ELSE '1' END AS bucket, count(*)::BIGINT AS vertices FROM (SELECT count(*) AS d FROM both_ GROUP BY src) GROUP BY 1",
        "embedding_coverage": "SELECT count(*)::BIGINT AS wanted, count(vec_id)::BIGINT AS covered, avg((vec_id IS NOT NULL)::INT::DOUBLE) AS coverage FROM (SELECT DISTINCT c_custkey AS id FROM customer) LEFT JOIN embeddings ON vec_id = id",
        "latency_percentiles": "SELECT avg(value) AS mean, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events",
        "hash_sample": "SELECT vec_id AS id, label FROM embeddings ORDER BY md5('0:' || vec_id::VARCHAR), vec_id LIMIT 100",
        "computation_status": """WITH log AS (SELECT event_type AS insight_type, CASE event_id % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END AS status, ts AS started_at, event_id AS id FROM events),
            last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY insight_type ORDER BY started_at DESC, id DESC) = 1),
            fine AS (SELECT insight_type, max(started_at) AS last_completed FROM log WHERE status = 'completed' GROUP BY 1)
            SELECT k AS insight_type, CASE WHEN status IS NULL THEN 'never_run' WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR THEN 'stale' ELSE status END AS status, last_completed FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'error', 'refund']) AS k) LEFT JOIN last ON k = insight_type LEFT JOIN fine ON k = fine.insight_type""",
        "unpublished_versions": "SELECT 'v' || label AS model_version, count(*)::BIGINT AS vectors FROM embeddings WHERE label NOT IN (0, 3) GROUP BY label",
    }
    out = {}
    for name, body in q.items():
        out[name] = body if body.lstrip().startswith("WITH") and "both_" not in body else with_lens(body)
    out["label_longevity"] = with_lens("SELECT * FROM ranked WHERE NOT is_placeholder", _LABELS)
    out["label_longevity_with_placeholders"] = with_lens("SELECT * FROM ranked", _LABELS)
    out["rarity_quality_counts"] = with_lens("SELECT * FROM cnt", _SIGNALS)
    out["rarity_scarcity"] = with_lens("SELECT signal, value, coalesce(sum(releases) OVER (PARTITION BY signal ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(releases) OVER (PARTITION BY signal) AS score FROM cnt", _SIGNALS)
    scarce = "scarce AS (SELECT signal, value, coalesce(sum(releases) OVER (PARTITION BY signal ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(releases) OVER (PARTITION BY signal) AS score FROM cnt), "
    old = "old AS (SELECT year, 1 - sum(n) OVER (ORDER BY year)::DOUBLE / sum(n) OVER () AS old FROM (SELECT year, count(*) AS n FROM releases WHERE year IS NOT NULL GROUP BY year)), "
    per = "per AS (SELECT release_id, max(CASE WHEN signal = 'artist' THEN score END) AS a, max(CASE WHEN signal = 'label' THEN score END) AS l, max(CASE WHEN signal = 'genre' THEN score END) AS g FROM sig JOIN scarce USING (signal, value) GROUP BY 1)"
    body = "SELECT release_id::VARCHAR AS release_id, year, rarity_score, CASE WHEN rarity_score >= 0.9 THEN 'ultra-rare' WHEN rarity_score >= 0.75 THEN 'rare' WHEN rarity_score >= 0.5 THEN 'uncommon' ELSE 'common' END AS tier, round(rarity_score * (1 - a), 9) AS hidden_gem_score FROM (SELECT release_id, year, a, round(l * 0.25 + coalesce(old, 0) * 0.25 + a * 0.25 + g * 0.25, 9) AS rarity_score FROM releases JOIN per USING (release_id) LEFT JOIN old USING (year))"
    out["release_rarity"] = with_lens(body, _SIGNALS + ", " + scarce + old + per)
    return out
