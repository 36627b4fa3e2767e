"""DuckDB oracles of the JSON-LD, network and gate operators."""

from __future__ import annotations

from ..operators.gates import BANNED, BLOCKED, INJECTED, REJECTED
from ..operators.rules import AEO_TYPES, CONTENT_FILES, STALE_DAYS, WEEKLY_MINIMUM, WORD_RANGES
from ..sources.derived import ANSWERS, CITED_SOURCES, CONTENT, DRAFTS, HOPS, LINK_STATUS, OG_PAGES, OVERVIEWS, POSTS, REDIRECTS, SEARCH_ANALYTICS, SITEMAPS, STATED_FACTS, URL_STATUS
from .corpus_sql import AUDIT, AUDIT_TEXT, DENSITY, FILES, SA_C, q
from .corpus_sql import oracles as corpus_oracles
from .search_sql import GAP_ROWS, SA, agg
from .search_sql import oracles as search_oracles

C = f"WITH c AS ({CONTENT})"
P = f"WITH p AS ({POSTS})"
SCRIPT = "(?is)<script[^>]*type=[\"'']application/ld\\+json[\"''][^>]*>(.*?)</script>"
ITEMS = f"""{C}, b0 AS (SELECT path, regexp_extract_all(raw, '{SCRIPT}', 1) AS bs FROM c), b AS (SELECT path, unnest(range(len(bs))) AS block, unnest(bs) AS body FROM b0),
 i AS (SELECT path, block, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN cast(body AS json) END AS j FROM b),
 k AS (SELECT *, CASE WHEN NOT ok THEN 'ParseError' ELSE coalesce(json_extract_string(j, '$."@type"'), 'Unknown') END AS type FROM i)"""
WORDS = "len(list_filter(string_split_regex(coalesce(json_extract_string(j, '$.mainEntity[0].acceptedAnswer.text'), ''), '\\s+'), lambda w: w <> ''))"
ISSUES = f"""{ITEMS}, x AS (
 SELECT path, type, 'error' AS severity, 'Invalid JSON in schema block' AS message FROM k WHERE NOT ok
 UNION ALL SELECT path, type, 'warn', 'Missing @context on ' || type || ' schema' FROM k WHERE ok AND json_extract(j, '$."@context"') IS NULL
 UNION ALL SELECT path, type, 'error', 'Article missing required field: ' || f FROM (SELECT path, type, j, unnest(['headline', 'author', 'datePublished']) AS f FROM k WHERE ok AND type = 'Article') a WHERE NOT list_contains(json_keys(j), f)
 UNION ALL SELECT path, type, 'error', 'FAQPage missing required field: mainEntity' FROM k WHERE ok AND type = 'FAQPage' AND json_extract(j, '$.mainEntity') IS NULL
 UNION ALL SELECT path, type, 'warn', 'FAQ answer too short (' || {WORDS} || ' words, min 30)' FROM k WHERE ok AND type = 'FAQPage' AND json_extract(j, '$.mainEntity') IS NOT NULL AND {WORDS} < 30
 UNION ALL SELECT path, type, 'warn', 'Article author missing sameAs/url (weakens E-E-A-T entity)' FROM k WHERE ok AND type = 'Article' AND json_extract(j, '$.author') IS NOT NULL AND json_extract(j, '$.author.sameAs') IS NULL AND json_extract(j, '$.author.url') IS NULL
 UNION ALL SELECT path, type, CASE WHEN type = 'FAQPage' THEN 'error' ELSE 'warn' END, 'Duplicate ' || type || ' schema (found ' || count(*) || ')' || CASE WHEN type = 'FAQPage' THEN ' — duplicate FAQPage triggers Google penalty suppressing ALL rich results' ELSE '' END FROM k WHERE ok GROUP BY path, type HAVING count(*) > 1)"""
U = f"WITH st AS ({URL_STATUS}), sm AS ({SITEMAPS}), su AS (SELECT sitemap_url, unnest(regexp_extract_all(xml, '<loc>(.*?)</loc>', 1)) AS url FROM sm)"
REPORT = f"""{U}, r AS (SELECT u.url, s.status, CASE WHEN s.status BETWEEN 300 AND 399 THEN 'redirect' WHEN s.status = 404 THEN 'not_found' WHEN coalesce(s.status, 0) = 0 THEN 'error' WHEN s.status = 200 THEN 'ok' ELSE 'other' END AS class, CASE WHEN s.status BETWEEN 300 AND 399 THEN s.location END AS target FROM (SELECT DISTINCT url FROM su) u LEFT JOIN st s USING (url))"""
BROKEN = f"""WITH st AS ({URL_STATUS}), l AS (SELECT url, count(*) AS files FROM pages WHERE url IS NOT NULL GROUP BY url), k AS (SELECT l.url, l.url AS full_url, starts_with(l.url, 'https://') AS internal, s.status, s.final_url, s.error, l.files, CASE WHEN coalesce(s.status, 0) BETWEEN 200 AND 399 THEN CASE WHEN s.redirected THEN 'redirected' ELSE 'ok' END ELSE 'broken' END AS class FROM l LEFT JOIN st s USING (url))"""
CITED = f"WITH a AS ({ANSWERS}), f AS (SELECT query, contains(coalesce(html, ''), 'site.example') AS cited, contains(coalesce(html, ''), 'site.example') AND contains(coalesce(html, ''), 'href') AS linked FROM a)"


def any_of(x: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(p)})" for p in phrases) + ")"


def oracles() -> dict[str, str]:
    hits = " UNION ALL ".join(
        f"SELECT {q(k)} AS category, {q(p)} AS phrase, count(*) AS files FROM l WHERE contains(t, {q(p)})" for k,
        ps in BLOCKED.items() for p in ps
    )
    hexfold = "(SELECT list_reduce(list_prepend(0, list_transform(range(1, 41), lambda i: cast(strpos('0123456789abcdef', substr(sha1(slug), i, 1)) - 1 AS bigint))), lambda a, h: (a * 16 + h) % 14))"
    return {
        "jsonld_items": f"{ITEMS} SELECT path, block, 0 AS item, type FROM k",
        "jsonld_issues": f"{ISSUES} SELECT * FROM x",
        "jsonld_summary": f"""{ISSUES} SELECT (SELECT count(*) FROM c) AS total_scanned, (SELECT count(DISTINCT path) FROM k) AS with_schemas, (SELECT count(*) FROM x WHERE severity = 'error') AS errors, (SELECT count(*) FROM x WHERE severity = 'warn') AS warnings, (SELECT string_agg(type, ',' ORDER BY type) FROM (SELECT DISTINCT type FROM k WHERE ok)) AS schema_types, 'BreadcrumbList,Organization,WebSite' AS missing_types""",
        "sitemap_urls": f"{U} SELECT sitemap_url, url FROM su",
        "redirect_report": f"{REPORT} SELECT * FROM r",
        "redirect_histogram": f"{REPORT} SELECT class, count(*) AS urls FROM r GROUP BY class",
        "broken_links": f"{BROKEN} SELECT * FROM k",
        "broken_link_histogram": f"{BROKEN} SELECT class, count(*) AS urls FROM k GROUP BY class",
        "citations": f"{CITED} SELECT * FROM f",
        "citation_rate": f"{CITED} SELECT count(*) AS queries_tested, count(*) FILTER (cited) AS cited, count(*) FILTER (linked) AS linked, cast(floor(cast(count(*) FILTER (cited) AS double) / count(*) * 1e2 + 0.5e0) AS bigint) AS citation_rate FROM f",
        "submission_batch": "SELECT page_id AS ord, url, 'URL_UPDATED' AS type FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 200",
        "redirect_chains": f"""WITH RECURSIVE h AS ({HOPS}), r AS (SELECT url, location FROM h WHERE status BETWEEN 300 AND 399), w AS (SELECT url, location AS here, 1 AS hops FROM r UNION ALL SELECT w.url, r.location, w.hops + 1 FROM w JOIN r ON r.url = w.here WHERE w.hops < 10) SELECT url, max_by(here, hops) AS final_url, max(hops) AS hops FROM w GROUP BY url""",
        "blocklist_hits": f"{C}, l AS (SELECT lower(raw) AS t FROM c), h AS ({hits}) SELECT * FROM h WHERE files > 0",
        "closer_gate": f"{P}, w AS (SELECT channel, slug, closer, list(closer) OVER (PARTITION BY channel ORDER BY ord ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS b FROM p), s AS (SELECT channel, slug, coalesce(len(list_filter(b, lambda c: c = closer)), 0) AS same, coalesce(len(b), 0) AS looked_at FROM w) SELECT *, CASE WHEN looked_at = 0 THEN false ELSE cast(same AS double) / looked_at > 0.4e0 END AS reject FROM s",
        "format_gate": f"{P} SELECT channel, slug, format, coalesce(lag(format) OVER (PARTITION BY channel ORDER BY ord) = format, false) AS repeats FROM p",
        "health_checks": f"""{C} SELECT path, regexp_matches(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\\$\\{{[A-Za-z_]+\\}}|\\[object Object\\]') AS variable_leak, {any_of('raw', INJECTED)} AS injected_link, regexp_matches(raw, '<p></p>|<p><p>') AS empty_paragraph, NOT contains(raw, 'application/ld+json') AS missing_schema, len(list_filter(string_split_regex({AUDIT_TEXT}, '\\s+'), lambda w: length(w) > 1)) < 300 AS thin, {
            any_of('lower(raw)', REJECTED)
        } AS template_phrase FROM c""",
        "title_rules": f"""{P} SELECT slug, headline AS title, length(headline) <= 60 AS short, regexp_matches(headline, '^[$]?[0-9]') AS number_first, contains(headline, ' — ') AS separated, {
            any_of('lower(headline)', BANNED)
        } AS banned_word, CASE WHEN contains(string_split(headline, ' ')[1], '$') THEN 'dollar' WHEN contains(string_split(headline, ' ')[1], '%') THEN 'percentage' WHEN regexp_matches(string_split(headline, ' ')[1], '[0-9]x$') THEN 'multiplier' WHEN regexp_matches(headline, '^[0-9]') THEN 'count' END AS hook FROM p""",
        "keyword_expansion": """WITH k AS (SELECT * FROM (VALUES ('{company} IPO'), ('{company} IPO date {year}'), ('{company} revenue {year}')) t(pattern)), y AS (SELECT pattern, unnest(CASE WHEN contains(pattern, '{year}') THEN [2025, 2026] ELSE [2025] END) AS year FROM k) SELECT pattern, n_name AS entity, replace(replace(pattern, '{company}', n_name), '{year}', cast(year AS varchar)) AS keyword FROM y, nation""",
        "slug_jitter": f"{P} SELECT slug, 1 + {hexfold} AS minutes_back FROM p",
        "position_drop": f"WITH sa AS ({SEARCH_ANALYTICS}) SELECT page, floor(b.position * 1e1 + 0.5e0) / 1e1 AS before, floor(n.position * 1e1 + 0.5e0) / 1e1 AS now FROM {agg('page', 7, 1)} n JOIN {agg('page', 14, 8)} b USING (page) WHERE b.position <= 10 AND n.position > 10",
        "publish_gaps": f"{P}, g AS (SELECT channel, slug, floor((epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY channel ORDER BY published_at, slug))) / 3600000000e0 * 1e1 + 0.5e0) / 1e1 AS gap_hours FROM p) SELECT * FROM g WHERE gap_hours > 20",
        "hourly_budget": f"{P} SELECT channel, strftime(date_trunc('hour', published_at), '%Y-%m-%d %H:%M') AS hour, count(*) AS posts FROM p GROUP BY 1, 2 HAVING count(*) > 2",
        "sitemap_entries": f"{P} SELECT 'https://example.com/blog/' || slug AS url, cast(coalesce(last_updated, date) AS varchar) AS last_modified, 'weekly' AS change_frequency, 0.7e0 AS priority FROM p UNION ALL SELECT * FROM (VALUES ('https://example.com', '2024-01-31', 'daily', 1e0), ('https://example.com/blog', '2024-01-31', 'daily', 0.9e0), ('https://example.com/blog/all', '2024-01-31', 'daily', 0.8e0))",
        "news_window": f"{P} SELECT slug, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS title, 'https://example.com/news/' || slug AS loc FROM p WHERE published_at > TIMESTAMP '2024-01-29 00:00:00'",
        "related_posts": f"{P}, t AS (SELECT slug, date, tag1 AS tag FROM p UNION ALL SELECT slug, date, tag2 FROM p), s AS (SELECT a.slug, b.slug AS related, b.date AS d, count(*) AS score FROM t a JOIN t b ON a.tag = b.tag AND a.slug <> b.slug GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY score DESC, d DESC, related) AS rank FROM s) SELECT slug, rank, related, score FROM r WHERE rank <= 4",
    }


D = f"WITH d AS ({DRAFTS})"
TITLE = "regexp_extract(raw, '(?m)title:\\s*[''\"]?(.*?)[''\"]?\\s*$', 1)"
DAYS = "date_diff('day', last_updated, DATE '2024-01-31')"


def values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + ")"


def rule_oracles() -> dict[str, str]:
    corpus = corpus_oracles()
    edges, outbound = f"({corpus['link_edges']})", f"({corpus['outbound_links']})"
    links = f"(SELECT c.path, coalesce(n, 0) AS links FROM ({CONTENT}) c LEFT JOIN (SELECT src_path, count(*) AS n FROM {edges} GROUP BY 1) e ON e.src_path = c.path)"
    full = "CASE WHEN starts_with(url, 'http') THEN url ELSE 'https://site.example' || url END"
    kinds = "CASE WHEN coalesce(s.status, 0) BETWEEN 200 AND 399 THEN CASE WHEN s.redirected THEN 'redirected' ELSE 'ok' END ELSE 'broken' END"
    content_links = f"(SELECT l.url, l.full_url, starts_with(l.full_url, 'https://site.example') AS internal, s.status, s.final_url, s.error, l.files, {kinds} AS class FROM (SELECT url, {full} AS full_url, files FROM {outbound}) l LEFT JOIN ({LINK_STATUS}) s ON s.url = l.full_url)"
    places = f"(SELECT DISTINCT path, unnest(list_concat(regexp_extract_all(raw, 'href=[\"'']([^\"''#]+?)[\"'']', 1), regexp_extract_all(raw, '\\[.*?\\]\\(([^)#]+?)\\)', 1))) AS url FROM ({CONTENT}) c)"
    missing = " || ".join(f"CASE WHEN list_contains(ts, {q(t)}) THEN '' ELSE {q(',' + t)} END" for t in AEO_TYPES)
    mark = lambda high, middle: f"CASE WHEN {high} THEN 3 WHEN {middle} THEN 2 ELSE 1 END"
    found = "len(list_filter(asked, lambda w: list_contains(named, w)))"
    marks = {
        "words": mark("words >= 800", "words >= 400"), "density": mark("density >= 3", "density >= 1"), "internal": mark(
            "internal >= 2", "internal = 1"
        ), "external": mark("external >= 2", "external = 1"),
        "schema": mark("article AND faq", "article"), "keyword": mark(
            f"{found} = len(asked)", f"{found} > 0"
        ), "freshness": mark("days < 90", "days <= 180"), "unique": mark("n = 1", "n < 20"),
    }
    word = lambda phrase: f"(?is)\\A(|.*?[^A-Za-z0-9_\\[<])({phrase})([^A-Za-z0-9_\\]>]|\\z)"
    linked = "raw"
    for phrases, url in ((["revenue", "filing"], "/blog/revenue"), (["users", "teams"], "/blog/users"), (["people"], "/blog/people")):
        step = "".join(f"WHEN regexp_matches(t, {q(word(p))}) THEN regexp_replace(t, {q(word(p))}, {q('\\1[\\2](' + url + ')\\3')}) " for p in phrases)
        linked = f"(SELECT CASE {step}ELSE t END FROM (SELECT {linked} AS t) z)"
    page_fact = f"WITH sa AS (SELECT * FROM ({SEARCH_ANALYTICS}) z WHERE page = 'https://site.example/blog/post-3')"
    topics = f"""t AS (SELECT DISTINCT w FROM (SELECT unnest(list_filter(list_transform(string_split_regex(regexp_replace(string_split(path, '/')[-1], '\\.(mdx|md|tsx|jsx)$', ''), '[-_]'), lambda x: lower(x)), lambda x: length(x) > 2)) AS w FROM ({CONTENT}) c WHERE ext IN ('.md', '.tsx')
 UNION ALL SELECT unnest(list_filter(string_split_regex(lower({TITLE}), '\\s+'), lambda x: length(x) > 3)) FROM ({CONTENT}) c WHERE ext IN ('.md', '.tsx')) z)"""
    gap = search_oracles() | {"rows": GAP_ROWS}
    return {
        "word_range_gate": f"""{D}, x AS (SELECT slug, format, len(list_filter(string_split_regex(text, '\\s+'), lambda w: length(w) > 0)) AS word_count, r.col1 AS lo, r.col2 AS hi FROM d LEFT JOIN {values([(k, *v) for k, v in WORD_RANGES.items()])} r ON r.col0 = d.format),
 y AS (SELECT slug, format, word_count, CASE WHEN lo IS NULL THEN 'no rule' WHEN word_count < lo THEN 'short' WHEN word_count > hi THEN 'long' ELSE 'ok' END AS verdict FROM x) SELECT *, verdict IN ('short', 'long') AS reject FROM y""",
        "internal_link_gate": f"SELECT path, links, links < 2 AS warn FROM {links} l",
        "topic_gate": f"{SA}, d AS ({DRAFTS}), b AS (SELECT query, page, row_number() OVER (PARTITION BY query ORDER BY position, page) AS rn FROM {agg('query, page', 28, 1)} WHERE impressions > 0) SELECT slug, target_query, b.page AS existing_page, b.page IS NOT NULL AS reject FROM d LEFT JOIN b ON b.query = d.target_query AND b.rn = 1",
        "source_gate": f"""WITH x AS (SELECT c.slug, c.name, c.url, s.status, regexp_replace(lower(regexp_extract(c.url, '^https?://([^/?#]+)', 1)), '[^a-z0-9]', '', 'g') AS h, regexp_replace(lower(c.name), '[^a-z0-9]', '', 'g') AS n FROM ({CITED_SOURCES}) c LEFT JOIN ({URL_STATUS}) s USING (url)),
 y AS (SELECT slug, name, url, coalesce(status IN (200, 301, 302), false) AS resolves, coalesce(n <> '' AND contains(h, n), false) AS named FROM x) SELECT *, NOT resolves OR NOT named AS reject FROM y""",
        "contradictions": f"SELECT entity, metric, count(DISTINCT value) AS stated, count(DISTINCT slug) AS posts, min(value) AS least, max(value) AS most FROM ({STATED_FACTS}) f GROUP BY entity, metric HAVING count(DISTINCT value) > 1",
        "weekly_minimums": f"""{D}, w AS (SELECT channel, date_trunc('week', date) AS week, format FROM d), r AS (SELECT col0 AS format, cast(col1 AS bigint) AS least FROM {values([*WEEKLY_MINIMUM.items()])} v),
 x AS (SELECT k.channel, k.week, r.format, r.least, (SELECT count(*) FROM w WHERE w.channel IS NOT DISTINCT FROM k.channel AND w.week = k.week AND w.format = r.format) AS posts FROM (SELECT DISTINCT channel, week FROM w) k, r) SELECT channel, cast(cast(week AS date) AS varchar) AS week, format, posts, least FROM x WHERE posts < least""",
        "build_days": "SELECT cast(cast(ts AS date) AS varchar) AS day, count(*) AS builds FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) > 60",
        "build_decision": f"{D} SELECT slug AS id, CASE WHEN contains(subject, '[nobuild]') THEN false WHEN contains(subject, '[deploy-tick]') THEN true ELSE files IS NULL OR len(list_filter(string_split(files, ','), lambda f: NOT regexp_matches(f, {q(CONTENT_FILES)}))) > 0 END AS build FROM d",
        "og_images": f"SELECT o.url, o.url AS image, s.status FROM ({OG_PAGES}) o LEFT JOIN ({URL_STATUS}) s USING (url) WHERE coalesce(s.status, 0) <> 200",
        "dead_pages": f"{U} SELECT DISTINCT su.url, st.status FROM su JOIN st USING (url) WHERE st.status = 404 OR st.status >= 500",
        "old_news": f"{P} SELECT slug, cast(published_at AS varchar) AS published_at FROM p WHERE published_at <= TIMESTAMP '2024-01-29 00:00:00'",
        "slug_collisions": f"{D}, r AS ({REDIRECTS}) SELECT d.slug, r.source, r.target FROM d JOIN r ON r.source = '/blog/' || d.slug",
        "refresh_plan": f"""{SA_C}, {AUDIT}, {FILES}, x AS (SELECT fl.path, d.content_type, a.bucket, a.impressions, {DAYS} AS days, coalesce(v.col1, 30) AS stale_days FROM fl JOIN ({DRAFTS}) d USING (slug) JOIN a ON a.path = fl.path LEFT JOIN {values([*STALE_DAYS.items()])} v ON v.col0 = d.content_type),
 y AS (SELECT path, content_type, stale_days, coalesce(days >= stale_days, false) AS stale, CASE WHEN bucket = 'KILL' THEN 'delete' WHEN bucket = 'MERGE' THEN 'merge first' WHEN impressions < 50 THEN 'too few impressions' END AS skip FROM x) SELECT *, stale AND skip IS NULL AS refresh FROM y""",
        "aeo_pages": f"WITH e AS ({corpus['factual_density']}), i AS (SELECT path, list(type) AS ts FROM ({ITEMS} SELECT path, type FROM k) z GROUP BY path), x AS (SELECT e.path, density_per_1k >= 3 AS dense, coalesce(ts, []) AS ts FROM e LEFT JOIN i USING (path)), y AS (SELECT path, dense, substr({missing}, 2) AS missing_types FROM x) SELECT *, dense AND missing_types = '' AS ready FROM y",
        "aeo_site": f"WITH r AS ({CITED} SELECT cast(floor(cast(count(*) FILTER (cited) AS double) / count(*) * 1e2 + 0.5e0) AS bigint) AS citation_rate FROM f) SELECT citation_rate, citation_rate > 30 AS on_target FROM r",
        "scorecard": f"""WITH f AS (SELECT path, word_count AS words, external_links AS external FROM ({corpus['content_features']}) z), t AS (SELECT path, doc_id, {TITLE} AS title FROM ({CONTENT}) c), n AS (SELECT title, count(*) AS n FROM t GROUP BY title),
 e AS (SELECT path, density_per_1k AS density FROM ({DENSITY.replace('word_count >= 50', 'word_count >= 1')} SELECT * FROM e) z), i AS (SELECT path, bool_or(type = 'Article') AS article, bool_or(type = 'FAQPage') AS faq FROM ({ITEMS} SELECT path, type FROM k) z GROUP BY path),
 r AS ({SA_C}, {FILES} SELECT path, {DAYS} AS days FROM fl),
 x AS (SELECT f.path, words, external, links AS internal, density, coalesce(article, false) AS article, coalesce(faq, false) AS faq, days, n, string_split('acme topic ' || cast(doc_id % 40 AS varchar), ' ') AS asked, string_split_regex(lower(title), '[^a-z0-9]+') AS named
 FROM f JOIN t USING (path) JOIN n USING (title) LEFT JOIN e ON e.path = f.path LEFT JOIN i ON i.path = f.path LEFT JOIN r ON r.path = f.path JOIN {links} l ON l.path = f.path),
 y AS (SELECT path, {', '.join(f'{m} AS {k}_mark' for k, m in marks.items())} FROM x) SELECT *, {' + '.join(f'{k}_mark' for k in marks)} AS total FROM y""",
        "redirect_plan": f"""{SA_C}, {AUDIT}, {FILES}, x AS (SELECT CASE WHEN a.slug LIKE '%7' THEN '/docs/v2/' || a.slug ELSE a.path END AS path, a.word_count AS words, a.impressions, {DAYS} AS days FROM a LEFT JOIN fl ON fl.path = a.path),
 y AS (SELECT path, CASE WHEN words < 400 AND days > 180 AND impressions < 50 THEN 'remove' WHEN regexp_matches(path, '[-/]v[0-9]+(?:[-./]|$)') THEN 'drop the version' END AS action FROM x) SELECT * FROM y WHERE action IS NOT NULL""",
        "answer_overview": f"SELECT query, contains(coalesce(html, ''), 'ai-overview') OR contains(coalesce(html, ''), 'AI Overview') AS has_overview FROM ({OVERVIEWS}) o",
        "submission_summary": "WITH b AS (SELECT page_id FROM pages WHERE url IS NOT NULL ORDER BY page_id LIMIT 200) SELECT count(*) FILTER (page_id % 7 <> 3) AS submitted, count(*) FILTER (page_id % 7 = 3) AS failed, 200 - count(*) FILTER (page_id % 7 <> 3) AS remaining FROM b",
        "content_links": f"SELECT * FROM {content_links} l",
        "external_links": f"SELECT * FROM {content_links} l WHERE NOT internal",
        "jsonld_sitemap_issues": f"{ISSUES} SELECT path, type, severity, replace(message, 'duplicate FAQPage triggers Google penalty suppressing ALL rich results', 'triggers rich result suppression') AS message FROM x WHERE message LIKE 'Duplicate%'",
        "broken_link_sources": f"SELECT p.url, l.status, p.path FROM {places} p JOIN {content_links} l ON l.url = p.url WHERE l.class = 'broken'",
        "dir_urls": f"SELECT 'https://site.example/' || regexp_replace(regexp_replace(path, '^/content/?', ''), '\\.(mdx|md|tsx|jsx)$', '') AS url FROM ({CONTENT}) c WHERE ext IN ('.md', '.tsx')",
        "page_urls": f"{D} SELECT slug, CASE WHEN channel < 'src5' THEN 'https://site.example/blog/' || slug ELSE 'https://other.example/' || slug END AS url FROM d",
        "answer_requests": f"SELECT query, 'https://answers.example/search?q=' || replace(query, ' ', '%20') AS url FROM ({ANSWERS}) a",
        "news_xml": f"""WITH n AS ({oracles()['news_window']}) SELECT n.slug, '<url><loc>' || loc || '</loc><news:news><news:publication><news:name>Acme &amp; Co</news:name><news:language>en</news:language></news:publication><news:publication_date>' || strftime(p.published_at, '%Y-%m-%dT%H:%M:%SZ') || '</news:publication_date><news:title>' || n.title || '</news:title><news:keywords>' || p.tag1 || ', ' || p.tag2 || '</news:keywords></news:news></url>' AS xml FROM n JOIN ({POSTS}) p ON p.slug = n.slug""",
        "cannibal_totals": f"WITH c AS ({gap['cannibal_clusters']}) SELECT count(*) AS clusters, cast(coalesce(sum(wasted_impressions), 0) AS bigint) AS total_wasted FROM c",
        "striking_totals": f"WITH s AS ({gap['striking_distance']}) SELECT count(*) AS pages, cast(coalesce(sum(click_gain), 0) AS bigint) AS total_click_gain FROM s",
        "topic_words": f"WITH {topics} SELECT w AS word FROM t",
        "query_gaps_without_pages": f"""{SA}, {topics}, g AS ({gap['rows']}), k AS (SELECT *, list_filter(string_split_regex(lower(query), '\\s+'), lambda w: length(w) > 3) AS ws FROM g),
 m AS (SELECT k.*, len(list_filter(ws, lambda w: list_contains(known, w))) AS hits FROM k, (SELECT list(w) AS known FROM t) v) SELECT query, clicks, impressions, ctr_pct, position, type, score FROM m WHERE NOT (len(ws) > 0 AND hits >= len(ws) * 0.8) ORDER BY score DESC, clicks DESC, impressions DESC, query LIMIT 25""",
        "gsc_page_queries": f"{page_fact} SELECT query, clicks, impressions, floor(ctr * 1e4 + 0.5e0) / 1e2 AS ctr_pct, floor(position * 1e1 + 0.5e0) / 1e1 AS position FROM {agg('query', 28, 1)} ORDER BY clicks DESC, impressions DESC, query LIMIT 20 OFFSET 5",
        "analyzer_findings": f"""{SA}, x AS (SELECT n.page, n.impressions, concat_ws(',', CASE WHEN n.impressions >= 1000 AND n.ctr < 0.02e0 THEN 'low_ctr' END, CASE WHEN n.position BETWEEN 4 AND 10 THEN 'quick_win' END, CASE WHEN n.position - b.position > 3 THEN 'declining' END, CASE WHEN n.impressions > 0 AND n.clicks = 0 THEN 'zero_click' END) AS findings FROM {agg('page', 14, 1)} n LEFT JOIN {agg('page', 28, 15)} b USING (page)) SELECT * FROM x WHERE findings <> ''""",
        "insert_links": f"SELECT path, sha256({linked}) AS linked_sha256 FROM ({CONTENT}) c",
    }
