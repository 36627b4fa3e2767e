"""The driver tables as the relations the operators read; the same SQL in Spark and in DuckDB."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

AS_OF = date(2024, 1, 31)

SEARCH_ANALYTICS = r"""
SELECT cast(ts AS date) AS date,
 'https://site.example/blog/post-' || cast(user_id % 40 AS varchar(20)) AS page,
 CASE k % 10
  WHEN 0 THEN 'best tools ' || cast(k AS varchar(20))
  WHEN 1 THEN 'how to measure growth ' || cast(k AS varchar(20))
  WHEN 2 THEN 'alpha vs beta ' || cast(k AS varchar(20))
  WHEN 3 THEN 'pricing cost ' || cast(k AS varchar(20))
  WHEN 4 THEN 'acme login ' || cast(k AS varchar(20))
  WHEN 5 THEN 'july 28 2026 is the acme ipo still happening yes or no latest'
  WHEN 6 THEN 'acme valuation 2026 ' || cast(k AS varchar(20))
  WHEN 7 THEN 'acme revenue report ' || cast(k AS varchar(20))
  WHEN 8 THEN 'from 2024 to 2026 acme ' || cast(k AS varchar(20)) || ' latest'
  ELSE 'acme corp ' || cast(k AS varchar(20)) END AS query,
 CASE WHEN user_id % 40 % 8 = 1 AND ts >= TIMESTAMP '2024-01-17 00:00:00' THEN 0 WHEN event_type = 'click' AND k % 4 = 0 THEN
  1 WHEN event_type = 'purchase' AND k % 2 = 0 THEN 2 ELSE 0 END AS clicks,
 cast((1 + floor(value * 4 / CASE WHEN user_id % 40 % 9 = 4 THEN 60 ELSE 1 END)) * CASE WHEN k % 11 = 3 AND ts >= TIMESTAMP
  '2024-01-24 00:00:00' THEN 9 ELSE 1 END AS bigint) AS impressions,
 cast(CASE WHEN k % 10 = 9 THEN 10 + k % 20
      WHEN k % 10 IN (6, 7) THEN 160 + (k * 3) % 90 + event_id % 5
      ELSE 10 + (k * 13) % 60 + ((user_id % 40) * (user_id % 40) * 5) % 160 + CASE WHEN user_id % 40 % 13 = 7 THEN 250 ELSE
  0 END + event_id % 5 END AS bigint) AS position_x10
FROM (SELECT e.*, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events e) x
"""

CONTENT = r"""
SELECT doc_id, 'post-' || cast(doc_id AS varchar(20)) AS slug,
 CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.html' ELSE '.tsx' END AS ext,
 '/content/post-' || cast(doc_id AS varchar(20)) || CASE doc_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.html' ELSE '.tsx' END AS path,
 '---' || chr(10) || 'title: "Acme topic ' || cast(doc_id % 50 AS varchar(20)) || ' explained"' || chr(10)
 || CASE WHEN doc_id % 4 <> 3 THEN 'lastUpdated: 2023-' || lpad(cast(1 + doc_id % 12 AS varchar(20)), 2, '0') || '-15' ||
  chr(10) ELSE 'date: 2024-01-' || lpad(cast(1 + doc_id % 28 AS varchar(20)), 2, '0') || chr(10) END
 || '---' || chr(10) || chr(10) || text || chr(10) || chr(10)
 || CASE doc_id % 7 WHEN 0 THEN 'It''s worth noting that revenue grew 42% to $1.5B in Q1 2026, a 3.5x move. Only time will tell.'
     WHEN 1 THEN 'The bottom line: 4,620,000 users joined by January 15, 2026 after a Series B at a 3:1 ratio on the NYSE.'
     WHEN 2 THEN 'Let''s dive into the rapidly evolving landscape of 14 million teams and the Acme Holdings Inc filing.'
     ELSE 'Nothing further was announced by the people who were asked about it today.' END || chr(10) || chr(10)
 || '<a href="/blog/post-' || cast((doc_id * 7) % 40 AS varchar(20)) || '">more</a> [ref](https://ext.example/' || cast(doc_id % 9 AS varchar(20)) || ')'
 || CASE WHEN doc_id % 5 = 0 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"H'
  || cast(doc_id AS varchar(20)) || '","author":{"name":"A"}}</script>'
     WHEN doc_id % 5 = 1 THEN '<script type="application/ld+json">{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[{"name":"Q1","acceptedAnswer":{"text":"short answer"}}]}</script><script type="application/ld+json">{"@type":"FAQPage"}</script>'
     WHEN doc_id % 5 = 2 THEN '<script type="application/ld+json">{bad json</script>' ELSE '' END AS raw
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, page, query, clicks, impressions, position_x10) from events."""
    return spark.sql(SEARCH_ANALYTICS.replace("FROM events e", "FROM {events} e"), events=table(spark, sf_dir, "events"))


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, slug, ext, path, raw) from documents."""
    return spark.sql(CONTENT.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {documents}"), documents=table(spark, sf_dir, "documents"))


#: Crawl snapshots and posts for the network and gate operators; the same SQL in both engines.
URL_STATUS = """
SELECT url, status, CASE WHEN status = 301 THEN 'https://final.example/' || cast(page_id % 7 AS varchar(20)) WHEN status =
  302 THEN 'https://hop.example/' || cast(page_id % 5 AS varchar(20)) END AS location,
 page_id % 6 = 5 AND status = 200 AS redirected, CASE WHEN page_id % 6 = 5 THEN url || '/final' END AS final_url, CASE WHEN
  status = 0 THEN 'TIMEOUT' END AS error
FROM (SELECT page_id, url, CASE page_id % 9 WHEN 1 THEN 404 WHEN 2 THEN 301 WHEN 3 THEN 0 WHEN 4 THEN 302 WHEN 5 THEN 500
  ELSE 200 END AS status FROM (SELECT min(page_id) AS page_id, url FROM pages WHERE url IS NOT NULL GROUP BY url) u) s
"""

SITEMAPS = """
SELECT 'https://site.example/sitemap-' || cast(page_id % 10 AS varchar(20)) || '.xml' AS sitemap_url, '<urlset><url><loc>'
  || url || '</loc></url><url><loc>https://site.example/p/' || cast(page_id % 50 AS varchar(20)) || '</loc></url></urlset>'
  AS xml FROM pages WHERE url IS NOT NULL
"""

HOPS = """
SELECT 'https://r.example/' || cast(page_id AS varchar(20)) AS url, CASE WHEN page_id % 4 = 3 THEN 200 ELSE 301 END AS status,
  'https://r.example/' || cast(page_id + 1 AS varchar(20)) AS location FROM pages
"""

ANSWERS = """
SELECT 'query ' || cast(page_id AS varchar(20)) AS query, CASE WHEN page_id % 3 = 0 THEN html || '<a href="https://site.example/x">s</a>'
  WHEN page_id % 3 = 1 THEN 'site.example is named' END AS html FROM pages
"""

POSTS = """
SELECT 'post-' || cast(doc_id AS varchar(20)) AS slug, source AS channel, doc_id AS ord, 'Acme & <topic> "' || cast(doc_id % 50 AS varchar(20)) || '"' AS title,
 CASE doc_id % 6 WHEN 0 THEN '42% of teams — Acme' WHEN 1 THEN '$347B in Q1 — Acme' WHEN 2 THEN '14 tools — the ultimate guide'
  WHEN 3 THEN '20x return — Acme' WHEN 4 THEN 'A closer look at Acme' ELSE 'Acme 2026 ' || lang || ' and many more words that make this title longer than sixty letters'
  END AS headline,
 cast(timestamp '2024-01-01 00:00:00' AS timestamp) + (doc_id * 37 % 720) * interval '1' hour AS published_at, DATE '2024-01-01'
  + cast(doc_id % 30 AS int) AS date, CASE WHEN doc_id % 4 = 0 THEN DATE '2024-01-20' + cast(doc_id % 9 AS int) END AS last_updated,
 'g' || cast(cast(floor(doc_id / 10) AS bigint) AS varchar(20)) AS tag1, 'h' || cast(cast(floor(doc_id / 4) AS bigint) AS varchar(20)) AS tag2,
 CASE WHEN doc_id % 5 < 3 THEN 'only time will tell' ELSE 'closer ' || cast(doc_id % 3 AS varchar(20)) END AS closer, CASE
  WHEN doc_id % 3 = 0 THEN 'explainer' ELSE 'ranked-list' END AS format
FROM documents
"""

#: Drafts, commits, redirects, cited sources, stated facts and statuses of links for the rules; the same SQL in both engines.
DRAFTS = """
SELECT 'post-' || cast(doc_id AS varchar(20)) AS slug, source AS channel, DATE '2024-01-01' + cast(doc_id % 30 AS int) AS date, text,
 CASE doc_id % 6 WHEN 0 THEN 'deep-explainer' WHEN 1 THEN 'news-analysis' WHEN 2 THEN 'ranked-list' WHEN 3 THEN 'question-led'
  WHEN 4 THEN 'contrarian-take' ELSE 'other' END AS format,
 CASE doc_id % 4 WHEN 0 THEN 'best tools ' WHEN 1 THEN 'acme corp ' ELSE 'unheard of ' END || cast(doc_id % 100 AS varchar(20)) AS target_query,
 CASE doc_id % 5 WHEN 0 THEN 'newsContent' WHEN 1 THEN 'dataPages' WHEN 2 THEN 'companyProfiles' WHEN 3 THEN 'evergreenGuides' ELSE 'other' END AS content_type,
 CASE doc_id % 7 WHEN 0 THEN 'update post [nobuild]' WHEN 1 THEN 'ship [deploy-tick]' ELSE 'update post ' || cast(doc_id AS varchar(20)) END AS subject,
 CASE doc_id % 5 WHEN 0 THEN 'posts/a.md,data/b.json' WHEN 1 THEN 'app/page.tsx,posts/a.md' WHEN 2 THEN '_posts/x.tsx' WHEN 3 THEN 'notes.csv' END AS files
FROM documents
"""

REDIRECTS = """
SELECT '/blog/post-' || cast(page_id * 3 AS varchar(20)) AS source, '/blog/post-' || cast(page_id AS varchar(20)) AS target FROM pages WHERE page_id % 4 = 1
"""

CITED_SOURCES = """
SELECT 'post-' || cast(page_id AS varchar(20)) AS slug, CASE page_id % 3 WHEN 0 THEN 'Bloomberg' ELSE regexp_extract(url,
  '^https?://([^/?#]+)', 1) END AS name, url FROM pages WHERE url IS NOT NULL
"""

STATED_FACTS = """
SELECT 'post-' || cast(p_partkey AS varchar(20)) AS slug, p_brand || ' ' || p_type AS entity, CASE p_partkey % 2 WHEN 0 THEN
  'size' ELSE 'price' END AS metric, cast(p_size AS bigint) AS value FROM part
"""

LINK_STATUS = """
SELECT url, CASE n % 7 WHEN 1 THEN 404 WHEN 2 THEN 500 WHEN 3 THEN 0 ELSE 200 END AS status, n % 7 = 4 AS redirected, CASE
  WHEN n % 7 = 4 THEN url || '/new' END AS final_url, CASE WHEN n % 7 = 3 THEN 'TIMEOUT' END AS error
FROM (SELECT DISTINCT 'https://site.example/blog/post-' || cast((doc_id * 7) % 40 AS varchar(20)) AS url, (doc_id * 7) % 40
  AS n FROM documents UNION ALL SELECT DISTINCT 'https://ext.example/' || cast(doc_id % 9 AS varchar(20)) AS url, doc_id %
  9 AS n FROM documents) u
"""

OG_PAGES = """
SELECT url, '<html><head><meta property="og:image" content="' || url || '"></head></html>' AS html FROM pages WHERE url IS NOT NULL AND page_id % 2 = 0
"""

OVERVIEWS = """
SELECT 'query ' || cast(page_id AS varchar(20)) AS query, CASE page_id % 4 WHEN 0 THEN html || '<div id="ai-overview">' WHEN
  1 THEN '<h2>AI Overview</h2>' WHEN 2 THEN html END AS html FROM pages
"""


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    """One of the views above over the table `name`, wherever it stands in it."""
    escaped = sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", "FROM {source}")
    return spark.sql(escaped, source=table(spark, sf_dir, name))
