"""DuckDB oracles of the search-analytics operators."""

from __future__ import annotations

from ..sources.derived import SEARCH_ANALYTICS

SA = f"WITH sa AS ({SEARCH_ANALYTICS})"


def agg(dims: str, first: int, last: int) -> str:
    by = f"GROUP BY {dims}" if dims else ""
    return f"(SELECT {dims + ',' if dims else ''} cast(sum(clicks) AS bigint) AS clicks, cast(sum(impressions) AS bigint) AS impressions, cast(sum(clicks) AS double) / cast(sum(impressions) AS double) AS ctr, cast(sum(impressions * position_x10) AS double) / (cast(sum(impressions) AS double) * 1e1) AS position FROM sa WHERE date BETWEEN DATE '2024-01-31' - {first} AND DATE '2024-01-31' - {last} {by})"


def top(rows: str, n: int, keys: str) -> str:
    return f"(SELECT * FROM {rows} ORDER BY clicks DESC, impressions DESC, {keys} LIMIT {n})"


CTR = "floor(ctr * 1e4 + 0.5e0) / 1e2 AS ctr_pct"
POS = "floor(position * 1e1 + 0.5e0) / 1e1 AS position"
PCT = "floor(((cast({n} AS double) - cast({o} AS double)) / nullif(cast({o} AS double), 0e0)) * 1e3 + 0.5e0) / 1e1"
AI = """((CASE WHEN regexp_matches({q}, '^\\w{{3,}} \\d{{1,2}} \\d{{4}} ') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches({q}, '(?i)latest$') THEN 1 ELSE 0 END)
 + (CASE WHEN regexp_matches({q}, '(?i)\\b(yes|no|true|false)\\b') THEN 1 ELSE 0 END) + (CASE WHEN len(string_split({q}, ' ')) > 12 THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches({q}, '\\d{{4}}.*\\d{{4}}') THEN 1 ELSE 0 END) >= 2)"""
AI_Q, AI_L = AI.format(q="query"), AI.format(q="lower(query)")
INTENT = f"""CASE WHEN {AI_L} THEN 'ai_grounding' WHEN regexp_matches(lower(query), '\\bvs\\b|compare|best|top \\d|ranked|alternative') THEN 'comparison'
 WHEN regexp_matches(lower(query), '\\bbuy\\b|pricing|cost|how to get|sign up|free trial') THEN 'transactional'
 WHEN regexp_matches(lower(query), '\\b(what|how|why|when|is |are |does )\\b') THEN 'informational' ELSE 'navigational' END"""
SHORT = "regexp_replace({u}, '^https?://[^/]+', '')"
CANNIBAL = f"(SELECT query, page, clicks, impressions, {POS}, row_number() OVER (PARTITION BY query ORDER BY floor(position * 1e1 + 0.5e0) / 1e1, clicks DESC, impressions DESC, page) AS rn, row_number() OVER (PARTITION BY query ORDER BY floor(position * 1e1 + 0.5e0) / 1e1 DESC, clicks, impressions, page DESC) AS back, count(*) OVER (PARTITION BY query) AS n FROM {agg('query, page', 28, 1)} WHERE impressions >= 100)"
EXPECTED = "(VALUES (3,8.0),(4,5.0),(5,3.5),(6,2.5),(7,2.0),(8,1.5),(9,1.2),(10,1.0),(11,0.8),(12,0.6),(13,0.5),(14,0.4),(15,0.3),(16,0.25),(17,0.2),(18,0.18),(19,0.15),(20,0.12))"
GAP_TYPE = """CASE WHEN regexp_matches(query, '\\d{4}') THEN 'TIME-SENSITIVE' WHEN regexp_matches(query, '(?i)^(what|how|why|when|where|who|is|are|can|do|does)\\b') THEN 'QUESTION'
 WHEN regexp_matches(query, '(?i)\\bvs\\b|versus|compared?\\b|comparison') THEN 'COMPARISON' WHEN regexp_matches(query, '(?i)\\bbest\\b|top\\b|ranking|rated') THEN 'RANKING'
 WHEN regexp_matches(query, '(?i)\\bprice|cost|salary|worth|valuation|revenue') THEN 'DATA-DRIVEN' ELSE 'INFORMATIONAL' END"""
GAPS = f"(SELECT query, clicks, impressions, {CTR}, floor(position * 1e1 + 0.5e0) / 1e1 AS position FROM {agg('query', 60, 1)} WHERE impressions >= 80 AND floor(position * 1e1 + 0.5e0) / 1e1 >= 15 AND NOT regexp_matches(query, '(?i)near me|jailbreak|login|sign ?in'))"
GAP_ROWS = f"SELECT query, clicks, impressions, ctr_pct, position, {GAP_TYPE} AS type, cast(floor(impressions * (1e0 / position) * 1e2 + 0.5e0) AS bigint) AS score FROM {GAPS}"

STRIKING = f"""near AS (SELECT page, query, clicks, impressions, {CTR}, {POS} FROM {top(agg('page, query', 28, 1), 10000, 'page, query')}),
 ok AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY impressions DESC, clicks DESC, query) AS rn FROM near WHERE position BETWEEN 5 AND 20 AND impressions >= 200),
 g AS (SELECT page, cast(sum(impressions) AS bigint) AS impressions, cast(sum(clicks) AS bigint) AS clicks, count(*) AS query_count FROM ok GROUP BY page),
 e AS (SELECT cast(col0 AS double) AS p, cast(col1 AS double) AS r FROM {EXPECTED}),
 j AS (SELECT g.page, ok.query AS top_query, ok.position, ok.ctr_pct, g.impressions, g.clicks, g.query_count, CASE WHEN ok.position > 10 THEN 8e0 ELSE greatest(3e0, ok.position - 2e0) END AS target_position FROM g JOIN ok ON g.page = ok.page AND ok.rn = 1),
 x AS (SELECT j.*, j.impressions * (coalesce(a.r, 0.5e0) / 1e2) AS now_, j.impressions * (coalesce(b.r, 5e0) / 1e2) AS then_, coalesce(a.r, 1e0) AS exp1 FROM j LEFT JOIN e a ON a.p = floor(j.position + 0.5e0) LEFT JOIN e b ON b.p = j.target_position)"""


def oracles() -> dict[str, str]:
    impact = f"""b AS (SELECT page, clicks, impressions, {CTR}, {POS} FROM {agg('page', 28, 15)}), a AS (SELECT page, clicks, impressions, {CTR}, {POS} FROM {agg('page', 14, 1)}),
 i AS (SELECT a.page, a.clicks AS after_clicks, a.impressions AS after_impressions, a.ctr_pct AS after_ctr_pct, a.position AS after_position, b.clicks AS before_clicks, b.impressions AS before_impressions, b.ctr_pct AS before_ctr_pct, b.position AS before_position,
 CASE WHEN b.impressions > 0 THEN cast(floor(cast(a.impressions - b.impressions AS double) / b.impressions * 1e2 + 0.5e0) AS bigint) ELSE 0 END AS impressions_change_pct, a.clicks - b.clicks AS clicks_change, floor((a.ctr_pct - b.ctr_pct) * 1e2 + 0.5e0) / 1e2 AS ctr_change, floor((b.position - a.position) * 1e1 + 0.5e0) / 1e1 AS position_change,
 CASE WHEN a.ctr_pct - b.ctr_pct > 0.5e0 AND a.clicks > b.clicks THEN 'WIN' WHEN a.ctr_pct - b.ctr_pct > 0.2e0 THEN 'SLIGHT WIN' WHEN a.ctr_pct - b.ctr_pct < -0.5e0 THEN 'REGRESSED' ELSE 'NEUTRAL' END AS verdict FROM a JOIN b USING (page))"""
    pages = f"(SELECT * FROM {top(agg('page', 28, 1), 5000, 'page')} WHERE impressions >= 1000 AND ctr <= 0.02e0 AND position BETWEEN 4 AND 20)"
    rewrite = f"""p AS {pages}, q AS (SELECT m.page, m.query, row_number() OVER (PARTITION BY m.page ORDER BY m.clicks DESC, m.impressions DESC, m.query) AS rn FROM {agg('page, query', 28, 1)} m JOIN p USING (page)),
 c AS (SELECT page, count(*) AS n_queries, count(*) FILTER ({INTENT} = 'informational') AS informational, count(*) FILTER ({INTENT} = 'comparison') AS comparison, count(*) FILTER ({INTENT} = 'transactional') AS transactional, count(*) FILTER ({INTENT} = 'navigational') AS navigational, count(*) FILTER ({INTENT} = 'ai_grounding') AS ai_grounding, count(*) FILTER ({AI_Q}) AS n_ai FROM q WHERE rn <= 20 GROUP BY page)"""
    return {
        "gsc_page_metrics": f"{SA} SELECT page, clicks, impressions, {CTR}, {POS} FROM {agg('page', 28, 1)}",
        "gsc_query_metrics": f"{SA} SELECT query, clicks, impressions, {CTR}, {POS} FROM {agg('query', 28, 1)}",
        "gsc_sitewide_weeks": f"""{SA} SELECT t.clicks AS this_clicks, t.impressions AS this_impressions, floor(t.ctr * 1e4 + 0.5e0) / 1e2 AS this_ctr_pct, floor(t.position * 1e1 + 0.5e0) / 1e1 AS this_position, l.clicks AS last_clicks, l.impressions AS last_impressions, floor(l.ctr * 1e4 + 0.5e0) / 1e2 AS last_ctr_pct, floor(l.position * 1e1 + 0.5e0) / 1e1 AS last_position,
 {PCT.format(o='l.clicks', n='t.clicks')} AS clicks_change, {PCT.format(o='l.impressions', n='t.impressions')} AS impressions_change, {PCT.format(o='l.ctr', n='t.ctr')} AS ctr_change FROM {agg('', 7, 1)} t, {agg('', 14, 8)} l""",
        "weekly_top_pages": f"{SA} SELECT page, clicks, impressions, {CTR}, {POS} FROM {top(agg('page', 28, 1), 50, 'page')}",
        "weekly_trending": f"""{SA}, t AS (SELECT n.*, coalesce(cast(p.impressions AS double) / 3e0, 0e0) AS prior FROM {top(agg('query', 7, 1), 500, 'query')} n LEFT JOIN {top(agg('query', 28, 8), 500, 'query')} p USING (query) WHERE n.impressions >= 50),
 g AS (SELECT *, CASE WHEN prior > 0 THEN (impressions - prior) / prior ELSE cast('Infinity' AS double) END AS growth FROM t)
 SELECT query, clicks, impressions, ctr, position, cast(floor(prior + 0.5e0) AS bigint) AS prior_avg_impr, growth FROM g WHERE growth > 1 ORDER BY growth DESC, clicks DESC, impressions DESC, query LIMIT 20""",
        "weekly_dropping": f"""{SA}, t AS (SELECT f.page, f.clicks AS prior_clicks, coalesce(s.clicks, 0) AS recent_clicks, f.impressions FROM {top(agg('page', 28, 15), 200, 'page')} f LEFT JOIN {top(agg('page', 14, 1), 200, 'page')} s USING (page) WHERE f.clicks >= 5),
 d AS (SELECT *, cast(floor(cast(prior_clicks - recent_clicks AS double) / prior_clicks * 1e2 + 0.5e0) AS bigint) AS drop_pct FROM t)
 SELECT page, prior_clicks, recent_clicks, drop_pct FROM d WHERE drop_pct >= 30 ORDER BY drop_pct DESC, prior_clicks DESC, impressions DESC, page LIMIT 15""",
        "weekly_ctr_triage": f"{SA} SELECT page, clicks, impressions, {CTR}, {POS} FROM (SELECT * FROM {
            top(agg('page', 28, 1), 50, 'page')
        } WHERE impressions >= 1000 AND ctr < 0.02e0 AND position BETWEEN 3 AND 20 ORDER BY impressions DESC, clicks DESC, page LIMIT 15)",
        "weekly_monopolies": f"{SA} SELECT query, clicks, impressions, {CTR}, {POS} FROM (SELECT * FROM {
            top(agg('query', 7, 1), 500, 'query')
        } WHERE position <= 3 AND impressions >= 100 ORDER BY impressions DESC, clicks DESC, query LIMIT 20)",
        "query_intent_counts": f"{SA} SELECT {INTENT} AS intent, count(*) AS queries, count(*) FILTER ({AI_Q}) AS machine FROM (SELECT DISTINCT query FROM sa) GROUP BY 1",
        "rewrite_candidates": f"""{SA}, {rewrite} SELECT p.page, p.clicks, p.impressions, floor(p.ctr * 1e4 + 0.5e0) / 1e2 AS ctr_pct, floor(p.position * 1e1 + 0.5e0) / 1e1 AS position,
 cast(floor(log10(p.impressions) * 2e1 + CASE WHEN p.position <= 10 THEN 3e1 WHEN p.position <= 15 THEN 15e0 ELSE 0e0 END + CASE WHEN p.ctr < 0.005e0 THEN 2e1 WHEN p.ctr < 0.01e0 THEN 1e1 ELSE 0e0 END - CASE WHEN cast(c.n_ai AS double) / c.n_queries > 0.5e0 THEN 4e1 ELSE 0e0 END + 0.5e0) AS bigint) AS rewrite_score,
 c.n_queries, c.informational, c.comparison, c.transactional, c.navigational, c.ai_grounding,
 CASE WHEN cast(c.ai_grounding AS double) / c.n_queries > 0.5e0 THEN '⚠ ' || cast(cast(floor(cast(c.ai_grounding AS double) / c.n_queries * 1e2 + 0.5e0) AS bigint) AS varchar) || '% AI-grounding queries — title rewrite unlikely to help. This is GEO traffic.'
 WHEN c.comparison > c.informational THEN 'Comparison intent dominant — consider adding "[X] vs [Y]" or "Best [X]" to the title.' WHEN p.ctr = 0 AND p.impressions > 50000 THEN 'Zero clicks at 50K+ impressions — likely AI Overview or featured snippet fully answering the query.'
 WHEN p.position <= 5 AND p.ctr < 0.01e0 THEN 'Top-5 position but <1% CTR — title may be answering the query. Tease, don''t tell.' END AS diagnosis FROM p JOIN c USING (page)""",
        "cannibal_clusters": f"""{SA}, c AS {CANNIBAL}, s AS (SELECT query, count(*) AS page_count, cast(sum(impressions) AS bigint) AS total_impressions, cast(sum(clicks) AS bigint) AS total_clicks, cast(sum(impressions) FILTER (rn > 1) AS bigint) AS wasted_impressions FROM c WHERE n >= 2 GROUP BY query)
 SELECT s.*, w.page AS winner_page, w.position AS winner_position, CASE WHEN s.page_count = 2 THEN 'Consolidate: 301 ' || {SHORT.format(u='l.page')} || ' → ' || {SHORT.format(u='w.page')} || ', merge best content.' ELSE 'Consolidate ' || cast(s.page_count - 1 AS varchar) || ' pages: 301 all losers → ' || {SHORT.format(u='w.page')} || ', merge best content from each.' END AS recommendation
 FROM s JOIN c w ON w.query = s.query AND w.rn = 1 JOIN c l ON l.query = s.query AND l.back = 1""",
        "cannibal_losers": f"{SA}, c AS {CANNIBAL} SELECT query, rn - 1 AS loser_rank, page, position, clicks, impressions FROM c WHERE rn >= 2",
        "striking_distance": f"{SA}, {STRIKING} SELECT page, top_query, position, ctr_pct, impressions, clicks, query_count, target_position, cast(floor(now_ + 0.5e0) AS bigint) AS current_est_clicks, cast(floor(then_ + 0.5e0) AS bigint) AS projected_clicks, cast(floor(then_ - now_ + 0.5e0) AS bigint) AS click_gain FROM x",
        "striking_actions": f"""{SA}, {STRIKING} SELECT page, CASE WHEN position > 10 THEN 'Add depth: expand the section that matches this query, add data/examples | Build internal links: point 3-5 related pages to this one' ELSE 'Add an FAQ section answering related questions | Update with fresh data — trigger lastmod freshness signal' END || CASE WHEN ctr_pct < exp1 THEN ' | Rewrite title to better match this query''s intent' ELSE '' END AS actions FROM x""",
        "query_gaps": f"{SA} {GAP_ROWS} ORDER BY score DESC, clicks DESC, impressions DESC, query LIMIT 25",
        "query_gaps_by_type": f"{SA} SELECT type, count(*) AS gaps FROM ({GAP_ROWS} ORDER BY score DESC, clicks DESC, impressions DESC, query LIMIT 25) GROUP BY type",
        "rewrite_impact": f"{SA}, {impact} SELECT * FROM i",
        "rewrite_impact_summary": f"{SA}, {impact} SELECT count(*) AS total, count(*) FILTER (verdict IN ('WIN', 'SLIGHT WIN')) AS wins, count(*) FILTER (verdict = 'REGRESSED') AS regressed, cast(coalesce(sum(clicks_change), 0) AS bigint) AS net_clicks FROM i",
    }
