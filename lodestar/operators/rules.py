"""Rules of publishing, refreshing and auditing that the configuration states as numbers and lists; each is a plan over rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a post by format, least and most; W7: posts of a format in a week at least (fixed values).
WORD_RANGES = {
    "deep-explainer": (1200, 1700), "news-analysis": (900, 1200), "ranked-list": (850, 1200), "question-led": (850, 1100),
    "contrarian-take": (900, 1400)
}
WEEKLY_MINIMUM = {"ranked-list": 2, "question-led": 2, "deep-explainer": 1}
#: Days after which a page of a kind is stale (fixed values).
STALE_DAYS = {"newsContent": 7, "dataPages": 14, "companyProfiles": 30, "evergreenGuides": 60}
STALE_DEFAULT = 30
#: Types that a page needs, data points in 1,000 words at least, share of cited queries in percent to exceed (fixed values).
AEO_TYPES = ("Article", "FAQPage", "BreadcrumbList")
AEO_DENSITY, AEO_CITED = 3.0, 30
#: Names of changed files that need no build, and tags in a commit's subject that skip or force one (fixed values).
CONTENT_FILES = "\\.(md|mdx|json|txt|csv)$|^_posts/"
SKIP_TAG, BUILD_TAG = "[nobuild]", "[deploy-tick]"


def lookup(key: Column, values: dict) -> Column:
    """The value of a small rule table, NULL for keys that it lacks."""
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), key)


# Gates


def word_range_gate(posts: DataFrame) -> DataFrame:
    """Posts (slug, format, word_count) and whether their length lies outside their format's range; unknown formats have none."""
    low, high = (lookup(F.col("format"), {k: v[i] for k, v in WORD_RANGES.items()}) for i in (0, 1))
    n = F.col("word_count")
    verdict = F.when(low.isNull(), "no rule").when(n < low, "short").when(n > high, "long").otherwise("ok")
    return posts.select("slug", "format", "word_count", verdict.alias("verdict"), verdict.isin("short", "long").alias("reject"))


def internal_link_gate(content: DataFrame, edges: DataFrame, *, least: int = 2) -> DataFrame:
    """Files (path) with the number of existing pages that they link to (edges: src_path), and a warning under `least`."""
    n = edges.groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("n"))
    return content.select("path").join(n, "path", "left").select(
        "path", F.coalesce("n", F.lit(0)).alias("links"), (F.coalesce("n", F.lit(0)) < least).alias("warn")
    )


def topic_gate(drafts: DataFrame, ranking: DataFrame) -> DataFrame:
    """Drafts (slug, target_query) and the best ranking page for the query: reject where there is one, update that page instead.

    ranking is (query, page, position, impressions).
    """
    best = ranking.where("impressions > 0").groupBy("query").agg(F.min(F.struct("position", "page")).alias("b"))
    x = drafts.join(best.withColumnRenamed("query", "target_query"), "target_query", "left")
    return x.select("slug", "target_query", F.col("b.page").alias("existing_page"), F.col("b").isNotNull().alias("reject"))


def source_gate(sources: DataFrame, status: DataFrame) -> DataFrame:
    """Cited sources (slug, name, url): whether the url resolves (200, 301, 302) and the name is part of its host."""
    host = F.lower(F.regexp_extract("url", "^https?://([^/?#]+)", 1))
    name = F.regexp_replace(F.lower("name"), "[^a-z0-9]", "")
    x = sources.join(status.select("url", "status"), "url", "left")
    resolves = F.coalesce(F.col("status").isin(200, 301, 302), F.lit(False))
    named = F.coalesce((name != "") & F.contains(F.regexp_replace(host, "[^a-z0-9]", ""), name), F.lit(False))
    return x.select("slug", "name", "url", resolves.alias("resolves"), named.alias("named"), (~resolves | ~named).alias("reject"))


def contradictions(facts: DataFrame) -> DataFrame:
    """(entity, metric) for which posts state several values; facts is (slug, entity, metric, value)."""
    g = facts.groupBy("entity", "metric").agg(
        F.countDistinct("value").alias("stated"), F.countDistinct("slug").alias("posts"), F.min("value").alias("least"),
        F.max("value").alias("most")
    )
    return g.where("stated > 1")


def weekly_minimums(posts: DataFrame) -> DataFrame:
    """Weeks of a channel with fewer posts of a format than the rule asks for; posts is (channel, format, date)."""
    weeks = posts.select("channel", F.to_date(F.date_trunc("week", "date")).alias("week"), "format")
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.lit(v).cast("long").alias("least")) for k, v in WEEKLY_MINIMUM.items()])).alias("r")
    n = weeks.groupBy("channel", "week", "format").agg(F.count("*").alias("posts"))
    wanted = weeks.select("channel", "week").distinct().select("channel", "week", rules).select("channel", "week", "r.*")
    x = wanted.join(n, ["channel", "week", "format"], "left").withColumn("posts", F.coalesce("posts", F.lit(0).cast("long")))
    return x.where("posts < least").select("channel", "week", "format", "posts", "least")


def build_days(builds: DataFrame, *, most: int = 8) -> DataFrame:
    """Days with more than `most` builds; builds is (ts)."""
    return builds.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("builds")).where(F.col("builds") > most)


def build_decision(commits: DataFrame) -> DataFrame:
    """Whether a commit (id, subject, files: array, NULL where unknown) calls for a build."""
    code = F.exists("files", lambda f: ~f.rlike(CONTENT_FILES))
    decision = F.when(
        F.contains("subject", F.lit(SKIP_TAG)), False
    ).when(F.contains("subject", F.lit(BUILD_TAG)), True).otherwise(F.coalesce(code, F.lit(True)))
    return commits.select("id", decision.alias("build"))


# Health


def og_images(pages: DataFrame, status: DataFrame) -> DataFrame:
    """H2: pages (url, html) whose og:image is not found as 200; images whose status is unknown count as broken."""
    image = F.regexp_extract("html", "<meta property=[\"']og:image[\"'] content=[\"']([^\"']+)[\"']", 1)
    x = pages.select("url", F.nullif(image, F.lit("")).alias("image")).where("image is not null")
    s = status.select(F.col("url").alias("image"), "status")
    return x.join(s, "image", "left").where("coalesce(status, 0) <> 200").select("url", "image", "status")


def dead_pages(urls: DataFrame, status: DataFrame) -> DataFrame:
    """H4, O2: urls of sitemaps that answer 404 or 5xx."""
    return urls.select("url").distinct().join(status.select("url", "status"), "url").where("status = 404 or status >= 500")


def old_news(stories: DataFrame, as_of: datetime, *, hours: int = 48) -> DataFrame:
    """H4, O2: entries of a news sitemap (slug, published_at) older than `hours`."""
    return stories.where(
        F.col("published_at") <= F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz")
    ).select("slug", F.col("published_at").cast("string").alias("published_at"))


def slug_collisions(posts: DataFrame, redirects: DataFrame, *, prefix: str = "/blog/") -> DataFrame:
    """O2: posts (slug) at whose path a redirect (source, target) stands."""
    return posts.select("slug", F.concat(F.lit(prefix), F.col("slug")).alias("source")).join(redirects, "source").select("slug", "source", "target")


# Refreshing


def refresh_plan(files: DataFrame) -> DataFrame:
    """Files (path, content_type, bucket, impressions, days_since_update), stale by the days of their type, and whether to refresh.

    Pages to delete or to merge and pages of fewer than 50 impressions are not refreshed; without a date a page is not stale.
    """
    days = F.coalesce(lookup(F.col("content_type"), STALE_DAYS), F.lit(STALE_DEFAULT))
    stale = F.coalesce(F.col("days_since_update") >= days, F.lit(False))
    skip = F.when(F.col("bucket") == "KILL", "delete").when(F.col("bucket") == "MERGE", "merge first").when(F.col("impressions") < 50, "too few impressions")
    return files.select("path", "content_type", days.alias("stale_days"), stale.alias("stale"), skip.alias("skip"), (stale & skip.isNull()).alias("refresh"))


# Audits


def aeo_pages(density: DataFrame, items: DataFrame) -> DataFrame:
    """Pages (path, density_per_1k) that lack data points or types; items is (path, type)."""
    has = items.where(F.col("type").isin(*AEO_TYPES)).groupBy("path").agg(F.collect_set("type").alias("_has"))
    x = density.select("path", "density_per_1k").join(has, "path", "left")
    missing = F.array_join(F.filter(F.array(*map(F.lit, AEO_TYPES)), lambda t: ~F.array_contains(F.coalesce("_has", F.array().cast("array<string>")), t)), ",")
    x = x.select("path", (F.col("density_per_1k") >= AEO_DENSITY).alias("dense"), missing.alias("missing_types"))
    return x.withColumn("ready", F.col("dense") & (F.col("missing_types") == ""))


def aeo_site(rate: DataFrame) -> DataFrame:
    """Whether enough queries cite the site (a row with citation_rate)."""
    return rate.select("citation_rate", F.coalesce(F.col("citation_rate") > AEO_CITED, F.lit(False)).alias("on_target"))


def scorecard(pages: DataFrame) -> DataFrame:
    """L1: each page's marks from 1 to 3 in eight dimensions, and their total of 24.

    pages is (path, words, density, internal, external, has_article, has_faq, target_query, title, days, overlap): density in
    data points a 1,000 words, overlap 0 for a unique target, 1 for a partial and 2 for a direct duplicate.
    """
    c = F.col
    mark = lambda high, middle: F.when(high, 3).when(middle, 2).otherwise(1)
    asked = F.filter(F.split(F.lower("target_query"), "\\s+"), lambda w: w != "")
    found = F.size(F.filter(asked, lambda w: F.array_contains(F.split(F.lower("title"), "[^a-z0-9]+"), w)))
    marks = {
        "words": mark(c("words") >= 800, c("words") >= 400), "density": mark(c("density") >= 3, c("density") >= 1), "internal": mark(
            c("internal") >= 2, c("internal") == 1
        ),
        "external": mark(c("external") >= 2, c("external") == 1), "schema": mark(c("has_article") & c("has_faq"), c("has_article")),
        "keyword": mark(
            (found == F.size(asked)) & (found > 0), found > 0
        ), "freshness": mark(c("days") < 90, c("days") <= 180), "unique": mark(c("overlap") == 0, c("overlap") == 1),
    }
    x = pages.select("path", *[m.alias(f"{k}_mark") for k, m in marks.items()])
    return x.withColumn("total", sum((F.col(f"{k}_mark") for k in list(marks)[1:]), F.col("words_mark")))


def analyzer(now: DataFrame, before: DataFrame, *, min_impressions: int = 1000) -> DataFrame:
    """L2: pages (page, clicks, impressions, ctr, position) with the findings that hold: low_ctr, quick_win, declining, zero_click."""
    x = now.join(before.select("page", F.col("position").alias("_was")), "page", "left")
    c = F.col
    holds = [
        ((c("impressions") >= min_impressions) & (c("ctr") < 0.02), "low_ctr"), (c("position").between(4, 10), "quick_win"),
        (c("position") - c("_was") > 3, "declining"), ((c("impressions") > 0) & (c("clicks") == 0), "zero_click"),
    ]
    return x.select(
        "page", "impressions", F.array_join(F.array_compact(F.array(*[F.when(k, v) for k, v in holds])), ",").alias("findings")
    ).where("findings <> ''")


def redirect_plan(pages: DataFrame) -> DataFrame:
    """L3: pages (path, words, days, impressions) to remove, and paths with a version number in them to rename."""
    c = F.col
    action = F.when(
        (c("words") < 400) & (c("days") > 180) & (c("impressions") < 50), "remove"
    ).when(c("path").rlike("[-/]v[0-9]+(?:[-./]|$)"), "drop the version")
    return pages.select("path", action.alias("action")).where("action is not null")


def answer_overview(answers: DataFrame) -> DataFrame:
    """Whether the page of results for a query (query, html) shows an AI overview; a failed fetch shows none."""
    html = F.coalesce(F.col("html"), F.lit(""))
    return answers.select("query", (F.contains(html, F.lit("ai-overview")) | F.contains(html, F.lit("AI Overview"))).alias("has_overview"))


def submission_summary(results: DataFrame, *, quota: int = 200) -> DataFrame:
    """Submissions that went well and failed, and what is left of the day's quota; results is (url, status)."""
    ok = F.count_if(F.col("status") == "OK")
    return results.agg(ok.alias("submitted"), F.count_if(F.col("status") == "FAIL").alias("failed"), (F.lit(quota) - ok).alias("remaining"))


def age(as_of: date, then: Column) -> Column:
    return F.datediff(F.lit(as_of), then)
