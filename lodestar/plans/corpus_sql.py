"""DuckDB oracles of the corpus operators."""

from __future__ import annotations

from ..functions.text import AUDIT_PHRASES, ENTITIES, FACTS, TEMPLATES
from ..sources.derived import CONTENT, SEARCH_ANALYTICS
from .search_sql import agg

C = f"WITH c AS ({CONTENT})"
SA_C = f"WITH sa AS ({SEARCH_ANALYTICS}), c AS ({CONTENT})"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count(x: str, patterns: tuple[str, ...], flags: str = "") -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({x}, {q(flags + p)}))" for p in patterns) + ")"


def steps(x: str, *pairs: tuple[str, str]) -> str:
    for p, r in pairs:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


AUDIT_TEXT = trim(steps("raw", ("<[^>]+>", " "), ("\\{[^}]*\\}", " "), ("import\\s.+", ""), ("export\\s.+", ""), ("\\s+", " ")))
JSX = steps("raw", ("(?m)^import\\s.+$", ""), ("(?m)^export\\s.+$", ""), ("<[^>]+>", " "), ("\\{[^}]*\\}", " "), ('className="[^"]*"', ""), ("\\s+", " "))
FRONT = "regexp_replace(raw, '(?m)^---(?s:.*?)---', '')"
MD = (("!\\[.*?\\]\\(.*?\\)", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("#{1,6}\\s", ""), ("[*_`~]", ""))
TEXT = f"CASE WHEN ext IN ('.tsx', '.jsx') THEN {JSX} WHEN ext IN ('.md', '.mdx') THEN {steps(FRONT, *MD)} ELSE raw END"
TEXT_F = f"CASE WHEN ext IN ('.tsx', '.jsx') THEN {JSX} WHEN ext IN ('.md', '.mdx') THEN {steps(FRONT, ('(?s)```.*?```', ''), *MD)} ELSE raw END"
FEATURES = f"""f0 AS (SELECT path, slug, raw, len(list_filter(string_split_regex({AUDIT_TEXT}, '\\s+'), lambda w: length(w) > 1)) AS word_count, {AUDIT_TEXT} AS t FROM c),
 f AS (SELECT path, slug, word_count, word_count < 300 AS is_thin, {count('t', AUDIT_PHRASES, '(?i)')} AS template_count,
 len(regexp_extract_all(raw, 'href="https?://[^"]+"')) - len(regexp_extract_all(raw, 'href="https?://example\\.com[^"]*"')) AS external_links, regexp_matches(raw, 'application/ld\\+json|jsonLd|articleSchema|faqSchema') AS has_schema, len(regexp_extract_all(raw, '<img |<Image |next/image')) AS image_count FROM f0)"""
AUDIT = f"""{FEATURES}, pg AS (SELECT *, regexp_extract(page, '([^/]+)/*$', 1) AS slug FROM {agg('page', 28, 1)}),
 j AS (SELECT f.*, coalesce(pg.clicks, 0) AS clicks, coalesce(pg.impressions, 0) AS impressions, coalesce(pg.ctr, 0e0) AS ctr, coalesce(pg.position, 0e0) AS position FROM f LEFT JOIN pg USING (slug)),
 a AS (SELECT *, CASE WHEN is_thin AND clicks = 0 AND impressions < 50 THEN 'KILL' WHEN template_count >= 3 AND clicks = 0 THEN 'KILL' WHEN impressions > 100 AND impressions < 500 AND ctr < 0.005e0 THEN 'MERGE' WHEN impressions >= 1000 AND ctr < 0.02e0 AND position BETWEEN 4 AND 20 THEN 'UPDATE' WHEN clicks >= 10 AND ctr >= 0.01e0 THEN 'PROMOTE' ELSE 'KEEP' END AS bucket FROM j)"""
NUM = "regexp_replace(cast({x} AS varchar), '\\.0$', '')"
REASONS = f"""concat_ws(' | ', CASE WHEN is_thin THEN 'Thin content: ' || word_count || ' words' END, CASE WHEN template_count >= 2 THEN template_count || ' template phrases detected' END, CASE WHEN external_links = 0 THEN 'No external links (citation gap)' END, CASE WHEN NOT has_schema THEN 'Missing structured data / schema' END, CASE WHEN image_count = 0 THEN 'No images' END,
 CASE WHEN clicks = 0 AND impressions > 0 THEN impressions || ' impressions, 0 clicks' END, CASE WHEN bucket = 'UPDATE' THEN 'Title rewrite candidate: pos ' || {NUM.format(x='floor(position * 1e1 + 0.5e0) / 1e1')} || ', ' || {NUM.format(x='floor(ctr * 1e2 * 1e2 + 0.5e0) / 1e2')} || '% CTR' END, CASE WHEN bucket = 'PROMOTE' THEN 'High performer: ' || clicks || ' clicks. Boost with internal links.' END)"""
DATE = "try_cast(nullif(regexp_extract(raw, '{k}:\\s*[''\"]?(\\d{{4}}-\\d{{2}}-\\d{{2}})[''\"]?', 1), '') AS date)"
FILES = f"fl AS (SELECT doc_id AS file_ord, path, slug, coalesce({DATE.format(k='lastUpdated')}, {DATE.format(k='date')}) AS last_updated FROM c WHERE ext IN ('.md', '.mdx', '.tsx', '.jsx'))"
REFRESH = f"""{FILES},
 pg AS (SELECT page, clicks, impressions, floor(ctr * 1e4 + 0.5e0) / 1e2 AS ctr_pct, floor(position * 1e1 + 0.5e0) / 1e1 AS position FROM {agg('page', 28, 1)} WHERE impressions >= 100),
 m AS (SELECT pg.page, fl.path, fl.last_updated, date_diff('day', fl.last_updated, DATE '2024-01-31') AS days, row_number() OVER (PARTITION BY pg.page ORDER BY fl.file_ord) AS rn FROM pg JOIN fl ON contains(pg.page, fl.slug)),
 r AS (SELECT pg.*, m.path, m.last_updated, m.days AS days_since_update, CASE WHEN m.path IS NULL THEN 'UNMATCHED' WHEN m.days >= 30 THEN 'STALE' ELSE 'HEALTHY' END AS status FROM pg LEFT JOIN m ON m.page = pg.page AND m.rn = 1)"""
REASON = """coalesce(nullif(concat_ws('. ', CASE WHEN days_since_update >= 60 THEN 'Content is significantly outdated — Google may be deprioritizing for freshness' END, CASE WHEN impressions > 5000 AND ctr_pct < 0.5e0 THEN 'High impressions but very low CTR — title may need refreshing alongside content' END,
 CASE WHEN position BETWEEN 4 AND 10 THEN 'Ranking on page 1 — a refresh could push to top 3' END, CASE WHEN position > 10 AND position <= 20 THEN 'Page 2 — a content refresh with updated data could break back to page 1' END), ''), 'Page is stale and still getting traffic — refresh to maintain ranking')"""
HITS = f"{C}, t AS (SELECT path, {TEXT} AS text FROM c), h AS (" + " UNION ALL ".join(
    f"SELECT path, {q(p)} AS pattern, len(regexp_extract_all(text, {q('(?i)' + p)})) AS n FROM t" for p in TEMPLATES
) + ")"
GRAMS = f"""{C}, t AS (SELECT path, {TEXT} AS text FROM c), s AS (SELECT path, unnest(list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda x: lower({trim('x')})), lambda x: length(x) > 20)) AS s FROM t),
 w AS (SELECT path, string_split_regex(s, '\\s+') AS w FROM s), g AS (SELECT DISTINCT path, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS ngram FROM w WHERE len(w) >= 5)"""
PARAS = "list_filter(list_transform(string_split_regex({t}, '\\n\\n+'), lambda p: {trim}), lambda p: length(p) > {n})"
DENSITY = f"""{C}, t AS (SELECT path, {TEXT_F} AS t FROM c), w AS (SELECT path, t, len(list_filter(string_split_regex(t, '\\s+'), lambda x: length(x) > 0)) AS word_count, {PARAS.format(t='t', trim=trim('p'), n=50)} AS ps FROM t),
 d AS (SELECT path, word_count, {count('t', FACTS)} AS fact_count, {count('t', ENTITIES)} AS entity_count, floor(cast({count('t', FACTS)} AS double) / word_count * 1e4 + 0.5e0) / 1e1 AS density_per_1k, len(list_filter(ps, lambda p: {count('p', FACTS)} = 0)) AS paragraphs_without_facts, len(ps) AS total_paragraphs FROM w WHERE word_count >= 50),
 e AS (SELECT *, CASE WHEN density_per_1k >= 6 THEN 'A' WHEN density_per_1k >= 3 THEN 'B' WHEN density_per_1k >= 1.5e0 THEN 'C' WHEN density_per_1k > 0 THEN 'D' ELSE 'F' END AS grade FROM d)"""
EDGES = f"""{C}, h AS (SELECT path, slug, unnest(regexp_extract_all(raw, 'href=["'']([^"'']+)["'']', 1)) AS u FROM c),
 l AS (SELECT path, slug, regexp_extract(u, '([^/]+)/*$', 1) AS dst FROM h WHERE starts_with(u, '/') AND NOT starts_with(u, '//')
 UNION SELECT path, slug, d FROM (SELECT path, slug, unnest(regexp_extract_all(raw, '[''"]([a-z0-9](?:[a-z0-9-]*[a-z0-9]))[''"]', 1)) AS d FROM c) WHERE length(d) > 5 AND contains(d, '-')),
 e AS (SELECT DISTINCT path AS src_path, slug AS src_slug, dst AS dst_slug FROM l WHERE dst <> '' AND (NOT contains(dst, '.')) AND NOT starts_with(dst, '#') AND dst <> slug AND dst IN (SELECT slug FROM c))"""
DEGREES = f"""{EDGES}, i AS (SELECT dst_slug AS slug, count(*) AS inbound FROM e GROUP BY 1), o AS (SELECT src_slug AS slug, count(*) AS outbound FROM e GROUP BY 1),
 g AS (SELECT c.slug, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound FROM c LEFT JOIN i USING (slug) LEFT JOIN o USING (slug)),
 k AS (SELECT *, CASE WHEN inbound = 0 THEN 'orphan' WHEN inbound = 1 THEN 'low' ELSE 'linked' END AS class, outbound = 0 AS dead_end FROM g)"""


def oracles() -> dict[str, str]:
    return {
        "content_features": f"{C}, {FEATURES} SELECT * FROM f",
        "content_audit": f"{SA_C}, {AUDIT} SELECT path, slug, bucket, clicks, impressions, floor(ctr * 1e4 + 0.5e0) / 1e2 AS ctr_pct, floor(position * 1e1 + 0.5e0) / 1e1 AS position, word_count, template_count FROM a",
        "content_audit_reasons": f"{SA_C}, {AUDIT} SELECT path, bucket, {REASONS} AS reasons FROM a",
        "audit_bucket_counts": f"{SA_C}, {AUDIT} SELECT bucket, count(*) AS files FROM a GROUP BY bucket",
        "refresh_candidates": f"{SA_C}, {REFRESH} SELECT page, path, impressions, clicks, ctr_pct, position, cast(last_updated AS varchar) AS last_updated, days_since_update, status, CASE WHEN status = 'STALE' THEN CASE WHEN days_since_update >= 60 THEN 'CRITICAL' ELSE 'HIGH' END END AS urgency, CASE WHEN status = 'STALE' THEN {REASON} END AS reason FROM r",
        "template_pattern_hits": f"{HITS} SELECT pattern, cast(sum(n) AS bigint) AS matches, count(DISTINCT path) AS files FROM h WHERE n > 0 GROUP BY pattern HAVING sum(n) >= 3",
        "template_summary": f"{HITS}, o AS (SELECT pattern FROM h GROUP BY pattern HAVING sum(n) >= 3), f AS (SELECT count(DISTINCT path) AS files_with_hits FROM h WHERE n > 0 AND pattern IN (SELECT pattern FROM o)) SELECT (SELECT count(*) FROM c) AS files_scanned, files_with_hits, cast(floor(cast(files_with_hits AS double) / (SELECT count(*) FROM c) * 1e2 + 0.5e0) AS bigint) AS pct_affected FROM f",
        "repeated_ngrams": f"{GRAMS} SELECT ngram, count(*) AS files FROM g GROUP BY ngram HAVING count(*) >= 3",
        "shared_closers": f"{C}, t AS (SELECT path, {TEXT} AS text FROM c), p AS (SELECT path, {
            PARAS.format(t='text', trim=trim('p'), n=30)
        } AS ps FROM t), k AS (SELECT path, {trim('lower(right(ps[-1], 60))')} AS closer FROM p WHERE len(ps) > 0) SELECT closer, count(*) AS files FROM k GROUP BY closer HAVING count(*) >= 3",
        "factual_density": f"{DENSITY} SELECT * FROM e",
        "density_grades": f"{DENSITY} SELECT count(*) AS files_scored, floor(cast(sum(cast(floor(density_per_1k * 10 + 0.5e0) AS bigint)) AS double) / 1e1 / count(*) * 1e1 + 0.5e0) / 1e1 AS avg_density, count(*) FILTER (density_per_1k < 3) AS below_threshold, " + ", ".join(
            f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF"
        ) + " FROM e",
        "link_edges": f"{EDGES} SELECT * FROM e",
        "link_degrees": f"{DEGREES} SELECT * FROM k",
        "orphan_pages": f"{DEGREES} SELECT slug, outbound FROM k WHERE class = 'orphan'",
        "link_summary": f"{DEGREES} SELECT count(*) AS pages, count(*) FILTER (class = 'orphan') AS orphans, count(*) FILTER (class = 'low') AS low_link, count(*) FILTER (class = 'linked') AS well_linked, count(*) FILTER (dead_end) AS dead_ends, cast(coalesce(sum(inbound), 0) AS bigint) AS links FROM k",
        "outbound_links": f"""{C}, l AS (SELECT path, unnest(list_concat(regexp_extract_all(raw, 'href=["'']([^"''#]+?)["'']', 1), regexp_extract_all(raw, '\\[.*?\\]\\(([^)#]+?)\\)', 1))) AS url FROM c) SELECT url, count(*) AS places, count(DISTINCT path) AS files, min(path) AS first_file FROM l WHERE NOT regexp_matches(url, '^(mailto:|tel:|javascript:)') GROUP BY url""",
    }
