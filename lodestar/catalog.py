"""All queries of the analytics operators over the driver tables, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.num import ctr_pct, pos1
from .operators import corpus, gates, jsonld, network, rules, search
from .plans import corpus_sql, rules_sql, search_sql
from .sources import derived
from .sources.derived import AS_OF, content, search_analytics, table

Query = Callable[[SparkSession, str], DataFrame]


def _fact(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(search_analytics(spark, sf_dir))


def _impact(f: DataFrame) -> DataFrame:
    halves = [search.shown(search.metrics(search.window(f, AS_OF, a, b), "page"), "page") for a, b in ((28, 15), (14, 1))]
    return search.rewrite_impact(*halves)


SEARCH: dict[str, Query] = {
    "gsc_page_metrics": _fact(lambda f: search.baseline(f, AS_OF)),
    "gsc_query_metrics": _fact(lambda f: search.shown(search.metrics(search.window(f, AS_OF, 28, 1), "query"), "query")),
    "gsc_sitewide_weeks": _fact(lambda f: search.weekly_summary(f, AS_OF)),
    "weekly_top_pages": _fact(lambda f: search.shown(search.weekly_top_pages(f, AS_OF), "page")),
    "weekly_trending": _fact(lambda f: search.weekly_trending(f, AS_OF)),
    "weekly_dropping": _fact(lambda f: search.weekly_dropping(f, AS_OF)),
    "weekly_ctr_triage": _fact(lambda f: search.weekly_ctr_triage(f, AS_OF)),
    "weekly_monopolies": _fact(lambda f: search.weekly_monopolies(f, AS_OF)),
    "query_intent_counts": _fact(
        lambda f: search.query_intents(f).groupBy("intent").agg(F.count("*").alias("queries"), F.count_if("machine").alias("machine"))
    ),
    "rewrite_candidates": _fact(lambda f: search.rewrite_candidates(f, AS_OF)),
    "cannibal_clusters": _fact(lambda f: search.cannibal_clusters(f, AS_OF)),
    "cannibal_losers": _fact(lambda f: search.cannibal_losers(f, AS_OF)),
    "striking_distance": _fact(lambda f: search.striking_distance(f, AS_OF).drop("actions")),
    "striking_actions": _fact(lambda f: search.striking_distance(f, AS_OF).select("page", "actions")),
    "query_gaps": _fact(lambda f: search.query_gaps(f, None, AS_OF)),
    "query_gaps_by_type": _fact(lambda f: search.query_gaps(f, None, AS_OF).groupBy("type").agg(F.count("*").alias("gaps"))),
    "query_gaps_without_pages": lambda s, d: search.query_gaps(search_analytics(s, d), search.topic_words(content(s, d)), AS_OF),
    "topic_words": lambda s, d: search.topic_words(content(s, d)),
    "gsc_page_queries": _fact(
        lambda f: search.shown(
            search.scan(f, AS_OF - timedelta(28), AS_OF - timedelta(1), "query", page="https://site.example/blog/post-3", rows=20, start=5),
            "query"
        )
    ),
    "cannibal_totals": _fact(lambda f: search.cannibal_totals(search.cannibal_clusters(f, AS_OF))),
    "striking_totals": _fact(lambda f: search.striking_totals(search.striking_distance(f, AS_OF))),
    "analyzer_findings": _fact(
        lambda f: rules.analyzer(search.metrics(search.window(f, AS_OF, 14, 1), "page"), search.metrics(search.window(f, AS_OF, 28, 15), "page"))
    ),
    "rewrite_impact": _fact(_impact),
    "rewrite_impact_summary": _fact(lambda f: search.impact_summary(_impact(f))),
}


def _docs(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(content(spark, sf_dir))


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = search.metrics(search.window(search_analytics(spark, sf_dir), AS_OF, 28, 1), "page")
    return corpus.content_audit(corpus.content_features(content(spark, sf_dir)), pages)


def _refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = corpus.file_dates(content(spark, sf_dir).withColumn("file_ord", F.col("doc_id")), AS_OF)
    return corpus.refresh_status(
        search.baseline(search_analytics(spark, sf_dir), AS_OF), files
    ).withColumn("last_updated", F.col("last_updated").cast("string"))


CORPUS: dict[str, Query] = {
    "content_features": _docs(corpus.content_features),
    "content_audit": lambda s, d: _audit(s, d).select(
        "path", "slug", "bucket", "clicks", "impressions", ctr_pct(F.col("ctr")).alias("ctr_pct"),
        pos1(F.col("position")).alias("position"), "word_count", "template_count"
    ),
    "content_audit_reasons": lambda s, d: _audit(s, d).select("path", "bucket", F.array_join("reasons", " | ").alias("reasons")),
    "audit_bucket_counts": lambda s, d: _audit(s, d).groupBy("bucket").agg(F.count("*").alias("files")),
    "refresh_candidates": _refresh,
    "template_pattern_hits": _docs(lambda c: corpus.pattern_hits(corpus.extracted(c))),
    "template_summary": _docs(lambda c: corpus.template_summary(corpus.extracted(c))),
    "repeated_ngrams": _docs(lambda c: corpus.repeated_ngrams(corpus.extracted(c))),
    "shared_closers": _docs(lambda c: corpus.shared_closers(corpus.extracted(c))),
    "factual_density": _docs(corpus.factual_density),
    "density_grades": _docs(lambda c: corpus.density_summary(corpus.factual_density(c))),
    "link_edges": _docs(corpus.link_edges),
    "link_degrees": _docs(corpus.link_degrees),
    "orphan_pages": _docs(lambda c: corpus.link_degrees(c).where("class = 'orphan'").select("slug", "outbound")),
    "link_summary": _docs(lambda c: corpus.link_summary(corpus.link_degrees(c))),
    "outbound_links": _docs(corpus.outbound_links),
    "insert_links": _docs(lambda c: corpus.insert_links(c, LINK_TARGETS).select("path", F.sha2(F.col("linked").cast("binary"), 256).alias("linked_sha256"))),
}
#: Targets of the insert_links query: phrases in order, and the url.
LINK_TARGETS = [(["revenue", "filing"], "/blog/revenue"), (["users", "teams"], "/blog/users"), (["people"], "/blog/people")]


def _posts(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(derived.view(spark, sf_dir, derived.POSTS, "documents"))


def _pages(sql: str) -> Query:
    return lambda spark, sf_dir: derived.view(spark, sf_dir, sql, "pages")


_status, _sitemaps, _hops, _answers = map(_pages, (derived.URL_STATUS, derived.SITEMAPS, derived.HOPS, derived.ANSWERS))


def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.redirect_report(network.sitemap_urls(_sitemaps(spark, sf_dir)).select("url").distinct(), _status(spark, sf_dir))


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("files"))
    return network.broken_links(links, _status(spark, sf_dir), base_url="https://")


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = _answers(spark, sf_dir)
    return network.citations(answers.select("query"), answers, "site.example")


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns = spark.createDataFrame([(p,) for p in ("{company} IPO", "{company} IPO date {year}", "{company} revenue {year}")], "pattern string")
    return gates.expand_keywords(patterns, table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity")), [2025, 2026])


_view = derived.view


def _drafts(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(_view(spark, sf_dir, derived.DRAFTS, "documents"))


def _content_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.outbound_links(content(spark, sf_dir)).select("url", "files")


def _broken_link_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each broken url with each file that names it, one row each: such lists have no bound."""
    broken = network.broken_links(
        _content_links(spark, sf_dir), _view(spark, sf_dir, derived.LINK_STATUS, "documents"), base_url="https://site.example"
    ).where("class = 'broken'")
    return corpus.link_places(content(spark, sf_dir)).distinct().join(broken.select("url", "status"), "url").select("url", "status", "path")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.file_dates(content(spark, sf_dir), AS_OF)


def _refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _view(spark, sf_dir, derived.DRAFTS, "documents").select("slug", "content_type")
    audit = _audit(spark, sf_dir).select("path", "bucket", "impressions")
    return rules.refresh_plan(_dated(spark, sf_dir).join(types, "slug").join(audit, "path"))


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = content(spark, sf_dir)
    types = jsonld.items(c).groupBy("path").agg(F.max(F.col("type") == "Article").alias("has_article"), F.max(F.col("type") == "FAQPage").alias("has_faq"))
    density = corpus.factual_density(c, min_words=1).select("path", F.col("density_per_1k").alias("density"))
    title = c.select("path", "slug", F.regexp_extract("raw", "(?m)title:\\s*['\"]?(.*?)['\"]?\\s*$", 1).alias("title"), "doc_id")
    same = title.groupBy("title").agg(F.count("*").alias("n"))
    days = _dated(spark, sf_dir).select("path", F.col("days_since_update").alias("days"))
    x = corpus.content_features(c).select("path", F.col("word_count").alias("words"), F.col("external_links").alias("external"))
    x = x.join(title, "path").join(same, "title").join(density, "path", "left").join(types, "path", "left").join(days, "path", "left")
    x = x.join(rules.internal_link_gate(c, corpus.link_edges(c)).select("path", F.col("links").alias("internal")), "path")
    overlap = F.when(F.col("n") == 1, 0).when(F.col("n") < 20, 1).otherwise(2)
    asked = F.concat(F.lit("acme topic "), (F.col("doc_id") % 40).cast("string"))
    no = F.lit(False)
    return rules.scorecard(
        x.select(
            "path", "words", "density", "internal", "external", F.coalesce("has_article", no).alias("has_article"),
            F.coalesce("has_faq", no).alias("has_faq"), asked.alias("target_query"), "title", "days", overlap.alias("overlap")
        )
    )


def _redirect_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _dated(spark, sf_dir).select("path", F.col("days_since_update").alias("days"))
    x = _audit(spark, sf_dir).select("path", "slug", F.col("word_count").alias("words"), "impressions").join(days, "path", "left")
    versioned = F.when(F.col("slug").endswith("7"), F.concat(F.lit("/docs/v2/"), "slug")).otherwise(F.col("path"))
    return rules.redirect_plan(x.select(versioned.alias("path"), "words", "days", "impressions"))


RULES: dict[str, Query] = {
    "jsonld_items": _docs(lambda c: jsonld.items(c).drop("v")),
    "jsonld_issues": _docs(lambda c: jsonld.issues(jsonld.items(c))),
    "jsonld_summary": _docs(jsonld.summary),
    "sitemap_urls": lambda s, d: network.sitemap_urls(_sitemaps(s, d)),
    "redirect_report": _redirects,
    "redirect_histogram": lambda s, d: network.status_histogram(_redirects(s, d)),
    "broken_links": _broken,
    "broken_link_histogram": lambda s, d: _broken(s, d).groupBy("class").agg(F.count("*").alias("urls")),
    "citations": _cited,
    "citation_rate": lambda s, d: network.citation_rate(_cited(s, d)),
    "submission_batch": lambda s, d: network.submission_batch(table(s, d, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("ord"), "url")),
    "redirect_chains": lambda s, d: network.redirect_chains(_hops(s, d)),
    "blocklist_hits": _docs(gates.blocklist_hits),
    "closer_gate": _posts(gates.closer_gate),
    "format_gate": _posts(gates.format_gate),
    "health_checks": _docs(gates.health_checks),
    "title_rules": _posts(lambda p: gates.title_rules(p.select("slug", F.col("headline").alias("title")))),
    "keyword_expansion": _keywords,
    "slug_jitter": _posts(gates.slug_jitter),
    "position_drop": _fact(lambda f: gates.position_drop(f, AS_OF)),
    "publish_gaps": _posts(gates.publish_gaps),
    "hourly_budget": _posts(gates.hourly_budget),
    "sitemap_entries": _posts(
        lambda p: gates.sitemap_entries(p, "https://example.com", AS_OF).withColumn("last_modified", F.col("last_modified").cast("string"))
    ),
    "news_window": _posts(lambda p: gates.news_window(p, datetime(2024, 1, 31))),
    "word_range_gate": _drafts(lambda p: rules.word_range_gate(p.select("slug", "format", F.size(T.words(F.col("text"))).cast("long").alias("word_count")))),
    "internal_link_gate": _docs(lambda c: rules.internal_link_gate(c, corpus.link_edges(c))),
    "topic_gate": lambda s, d: rules.topic_gate(
        _view(s, d, derived.DRAFTS, "documents"), search.metrics(search.window(search_analytics(s, d), AS_OF, 28, 1), "query", "page")
    ),
    "source_gate": lambda s, d: rules.source_gate(_view(s, d, derived.CITED_SOURCES, "pages"), _status(s, d)),
    "contradictions": lambda s, d: rules.contradictions(_view(s, d, derived.STATED_FACTS, "part")),
    "weekly_minimums": _drafts(lambda p: rules.weekly_minimums(p).withColumn("week", F.col("week").cast("string"))),
    "build_days": lambda s, d: rules.build_days(table(s, d, "events").where("event_type = 'error'"), most=60).withColumn("day", F.col("day").cast("string")),
    "build_decision": _drafts(lambda p: rules.build_decision(p.select(F.col("slug").alias("id"), "subject", F.split("files", ",").alias("files")))),
    "og_images": lambda s, d: rules.og_images(_view(s, d, derived.OG_PAGES, "pages"), _status(s, d)),
    "dead_pages": lambda s, d: rules.dead_pages(network.sitemap_urls(_sitemaps(s, d)), _status(s, d)),
    "old_news": _posts(lambda p: rules.old_news(p, datetime(2024, 1, 31))),
    "slug_collisions": lambda s, d: rules.slug_collisions(_view(s, d, derived.DRAFTS, "documents"), _view(s, d, derived.REDIRECTS, "pages")),
    "refresh_plan": _refresh_plan,
    "aeo_pages": _docs(lambda c: rules.aeo_pages(corpus.factual_density(c), jsonld.items(c))),
    "aeo_site": lambda s, d: rules.aeo_site(network.citation_rate(_cited(s, d))),
    "scorecard": _scorecard,
    "redirect_plan": _redirect_plan,
    "answer_overview": lambda s, d: rules.answer_overview(_view(s, d, derived.OVERVIEWS, "pages")),
    "submission_summary": lambda s, d: rules.submission_summary(
        network.submission_batch(
            table(s, d, "pages").where("url IS NOT NULL").select(F.col("page_id").alias("ord"), "url")
        ).select("url", F.when(F.col("ord") % 7 == 3, "FAIL").otherwise("OK").alias("status"))
    ),
    "content_links": lambda s, d: network.broken_links(_content_links(s, d), _view(s, d, derived.LINK_STATUS, "documents"), base_url="https://site.example"),
    "external_links": lambda s, d: network.broken_links(
        _content_links(s, d), _view(s, d, derived.LINK_STATUS, "documents"), base_url="https://site.example", only="external"
    ),
    "jsonld_sitemap_issues": _docs(lambda c: jsonld.issues(jsonld.items(c), sitemap=True).where("message LIKE 'Duplicate%'")),
    "broken_link_sources": _broken_link_sources,
    "dir_urls": _docs(lambda c: network.dir_urls(c, "https://site.example")),
    "page_urls": _drafts(
        lambda p: p.select(
            "slug",
            T.page_url(
                F.when(F.col("channel") < "src5", F.concat(F.lit("/blog/"), "slug")).otherwise(F.concat(F.lit("https://other.example/"), "slug")),
                "sc-domain:site.example"
            ).alias("url")
        )
    ),
    "answer_requests": lambda s, d: network.answer_requests(_answers(s, d), "https://answers.example/search?q="),
    "news_xml": _posts(lambda p: gates.news_xml(gates.news_window(p.withColumn("keywords", F.array("tag1", "tag2")), datetime(2024, 1, 31)), "Acme & Co")),
    "related_posts": _posts(lambda p: corpus.related_posts(p.select("slug", "date", F.array("tag1", "tag2").alias("tags")))),
}


def queries() -> dict[str, Query]:
    return SEARCH | CORPUS | RULES


def oracle_sql() -> dict[str, str]:
    return search_sql.oracles() | corpus_sql.oracles() | rules_sql.oracles() | rules_sql.rule_oracles()
