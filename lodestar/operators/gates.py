"""Publishing gates, health checks and schedules: deterministic rules of the configuration."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: G1: blocked phrases by category; G2: phrases that reject; H3: parts of injected links; D1: words that titles avoid (fixed values).
BLOCKED = {
    "hedging": [
        "it's worth noting", "it's worth mentioning", "it's important to note", "it's crucial to understand", "it remains to be seen",
        "only time will tell", "there's no denying", "while it's too early to say", "whether this will succeed remains unclear"
    ],
    "templateOpeners": [
        "the short answer is", "the quick answer is", "that's the short answer", "the longer answer is more interesting", "let's dive in",
        "let's dig in", "let's unpack this", "let's break this down", "in this article, we'll explore", "in today's post",
        "if you've been following"
    ],
    "templateClosers": ["what to watch:", "the bottom line:", "the takeaway here is", "looking ahead,", "looking forward,"],
    "filler": [
        "in an era of", "in a world where", "in today's landscape", "the rapidly evolving landscape", "the shifting landscape",
        "at the intersection of", "at the crossroads of", "represents a significant shift", "marks a pivotal moment",
        "signals a major milestone"
    ],
    "metaCommentary": [
        "in this article", "in this post", "in this piece", "we'll explore", "we'll examine", "we'll look at", "as we discussed",
        "as mentioned earlier"
    ],
}
REJECTED = [
    "the longer answer is more interesting", "that's the short answer", "let's dive in", "it's worth noting", "only time will tell",
    "it remains to be seen", "in this article, we'll explore"
]
INJECTED = ["_bhiiv=", "_bhlid=", "bhcl_id=", "ref.getviktor", "advertising.roku"]
BANNED = ["guide", "ultimate", "complete", "comprehensive", "definitive", "everything you need to know", "beginner's guide", "deep dive", "a closer look"]


def blocklist_hits(content: DataFrame, blocked: dict[str, list[str]] = BLOCKED) -> DataFrame:
    """G1: files by category and phrase."""
    low = F.lower("raw")
    hits = F.array(
        *[
            F.struct(F.lit(k).alias("category"), F.lit(p).alias("phrase"), F.contains(F.col("_l"), F.lit(p)).alias("hit")) for k,
            ps in blocked.items() for p in ps
        ]
    )
    rows = content.withColumn("_l", low).select("path", F.explode(F.filter(hits, lambda h: h["hit"])).alias("h"))
    return rows.groupBy("h.category", "h.phrase").agg(F.count("*").alias("files"))


#: Posts (by `ord`) and seconds of one bucket of a channel.
ORD_BUCKET, TIME_BUCKET = 10_000, 30 * 86_400


def before(posts: DataFrame, order: list[str], bucket: Column, value: str, n: int) -> DataFrame:
    """posts with `_before`: the values of up to n posts before each in its channel, in order. `bucket` rises with `order`.

    A channel is cut into buckets, each with a task of its own; the last n posts of each bucket are all that is looked at
    across them, so that no task holds a whole channel.
    """
    x = posts.withColumn("_b", bucket)
    back = F.row_number().over(Window.partitionBy("channel", "_b").orderBy(*[F.desc(c) for c in order]))
    tails = x.withColumn("_r", back).where(F.col("_r") <= n)
    upto = F.collect_list(value).over(Window.partitionBy("channel").orderBy(*order).rowsBetween(1 - n, 0))
    ends = tails.withColumn("_upto", upto).where("_r = 1").select("channel", "_b", "_upto")
    carried = ends.select(
        F.col("channel").alias("_c"), F.col("_b").alias("_k"),
        F.lag("_upto").over(Window.partitionBy("channel").orderBy("_b")).alias("_carried")
    ).where("_carried is not null")
    own = F.collect_list(value).over(Window.partitionBy("channel", "_b").orderBy(*order).rowsBetween(-n, -1))
    x = x.withColumn("_own", own).join(carried, F.col("channel").eqNullSafe(F.col("_c")) & F.col("_b").eqNullSafe(F.col("_k")), "left")
    both = F.concat(F.coalesce("_carried", F.slice("_own", 1, 0)), F.col("_own"))
    last = F.slice(both, F.greatest(F.size(both) - n + 1, F.lit(1)), F.lit(n))
    return x.withColumn("_before", last).drop("_b", "_c", "_k", "_own", "_carried")


def closer_gate(posts: DataFrame, *, lookback: int = 20, share: float = 0.4, bucket: int = ORD_BUCKET) -> DataFrame:
    """Posts (channel, slug, ord, closer) whose closer more than `share` of the posts just before have."""
    x = before(posts, ["ord"], F.floor(F.col("ord") / bucket), "closer", lookback)
    same = F.size(F.filter("_before", lambda c: c == F.col("closer")))
    part = F.when(F.size("_before") == 0, F.lit(0.0)).otherwise(same.cast("double") / F.size("_before"))
    return x.select("channel", "slug", same.cast("long").alias("same"), F.size("_before").cast("long").alias("looked_at"), (part > share).alias("reject"))


def format_gate(posts: DataFrame, *, bucket: int = ORD_BUCKET) -> DataFrame:
    """Posts (channel, slug, ord, format) of the same format as the one before."""
    x = before(posts.withColumn("_f", F.struct("format")), ["ord"], F.floor(F.col("ord") / bucket), "_f", 1)
    last = F.try_element_at("_before", F.lit(1))["format"]
    return x.select("channel", "slug", "format", F.coalesce(last == F.col("format"), F.lit(False)).alias("repeats"))


def health_checks(content: DataFrame, *, thin: int = 300) -> DataFrame:
    """Checks of each file, true where it fails."""
    visible = F.regexp_replace("raw", "<[^>]+>", " ")
    any_of = lambda x, ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.contains(x, p))
    return content.select(
        "path", visible.rlike("\\$\\{[A-Za-z_]+\\}|\\[object Object\\]").alias("variable_leak"), any_of(F.col("raw"), INJECTED).alias("injected_link"),
        F.col("raw").rlike("<p></p>|<p><p>").alias("empty_paragraph"), (~F.contains("raw", F.lit("application/ld+json"))).alias("missing_schema"),
        (F.size(T.words(T.audit_text(F.col("raw")), 2)) < thin).alias("thin"), any_of(F.lower("raw"), REJECTED).alias("template_phrase"),
    )


def title_rules(titles: DataFrame) -> DataFrame:
    """Rules that each title (slug, title) meets."""
    low, first = F.lower("title"), F.regexp_extract("title", "^[^ ]+", 0)
    hook = F.when(first.contains("$"), "dollar").when(first.contains("%"), "percentage").when(
        first.rlike("[0-9]x\\z"), "multiplier"
    ).when(first.rlike("^[0-9]"), "count")
    banned = F.exists(F.array(*map(F.lit, BANNED)), lambda p: F.contains(low, p))
    return titles.select(
        "slug", "title", (F.length("title") <= 60).alias("short"), F.col("title").rlike("^[$]?[0-9]").alias("number_first"),
        F.contains("title", F.lit(" — ")).alias("separated"), banned.alias("banned_word"), hook.alias("hook")
    )


def expand_keywords(patterns: DataFrame, entities: DataFrame, years: list[int]) -> DataFrame:
    """Q1: patterns x entities x years; three small rule tables, so a cross product is the feature."""
    y = patterns.select(
        "pattern",
        F.explode(F.when(F.contains("pattern", F.lit("{year}")), F.array(*map(F.lit, years))).otherwise(F.array(F.lit(years[0])))).alias("year")
    )
    k = y.crossJoin(entities)
    return k.select(
        "pattern", "entity",
        F.replace(F.replace("pattern", F.lit("{company}"), F.col("entity")), F.lit("{year}"), F.col("year").cast("string")).alias("keyword")
    )


def slug_jitter(slugs: DataFrame) -> DataFrame:
    """O1: 1 to 14 minutes from the SHA-1 of a slug, as a number of 160 bits modulo 14."""
    digits = F.filter(F.split(F.sha1(F.col("slug").cast("binary")), ""), lambda h: h != "")
    fold = F.aggregate(digits, F.lit(0), lambda a, h: (a * 16 + F.conv(h, 16, 10).cast("int")) % 14)
    return slugs.select("slug", (fold + 1).cast("long").alias("minutes_back"))


def position_drop(fact: DataFrame, as_of: date, *, days: int = 7) -> DataFrame:
    """Pages whose position crossed from 10 or better to worse between the last `days` days and those before."""
    from .search import metrics, window

    now = metrics(window(fact, as_of, days, 1), "page").select("page", F.col("position").alias("now"))
    before = metrics(window(fact, as_of, 2 * days, days + 1), "page").select("page", F.col("position").alias("before"))
    r = lambda c: F.floor(F.col(c) * 10.0 + 0.5) / 10.0
    return now.join(before, "page").where("before <= 10 AND now > 10").select("page", r("before").alias("before"), r("now").alias("now"))


def publish_gaps(posts: DataFrame, *, hours: float = 20, bucket: int = TIME_BUCKET) -> DataFrame:
    """Publications (channel, slug, published_at) more than `hours` after the one before."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    x = before(posts.withColumn("_at", at), ["published_at", "slug"], F.floor(at / (bucket * 1_000_000)), "_at", 1)
    gap = (F.col("_at") - F.try_element_at("_before", F.lit(1))) / 3_600_000_000.0
    return x.withColumn("gap_hours", F.floor(gap * 10.0 + 0.5) / 10.0).where(F.col("gap_hours") > hours).select("channel", "slug", "gap_hours")


def hourly_budget(posts: DataFrame, *, most: int = 2) -> DataFrame:
    """Hours of a channel with more than `most` publications: a tumbling window."""
    hour = F.date_trunc("hour", F.col("published_at").cast("timestamp"))
    return posts.groupBy("channel", F.date_format(hour, "yyyy-MM-dd HH:mm").alias("hour")).agg(F.count("*").alias("posts")).where(F.col("posts") > most)


def sitemap_entries(posts: DataFrame, base_url: str, as_of: date) -> DataFrame:
    """K5: (url, last_modified, change_frequency, priority) of fixed pages and posts (slug, date, last_updated)."""
    spark = posts.sparkSession
    fixed = spark.createDataFrame(
        [(base_url, 1.0), (f"{base_url}/blog", 0.9), (f"{base_url}/blog/all", 0.8)], "url string, priority double"
    ).select("url", F.lit(as_of).alias("last_modified"), F.lit("daily").alias("change_frequency"), "priority")
    own = posts.select(
        F.concat(F.lit(f"{base_url}/blog/"), F.col("slug")).alias("url"), F.coalesce("last_updated", "date").alias("last_modified"),
        F.lit("weekly").alias("change_frequency"), F.lit(0.7).alias("priority")
    )
    return fixed.unionByName(own)


def news_window(stories: DataFrame, as_of: datetime, *, hours: int = 48) -> DataFrame:
    """Stories (slug, title, published_at and, where there, keywords) younger than `hours`, escaped for XML."""
    recent = stories.where(F.col("published_at") > F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz"))
    more = [T.escape_xml(F.array_join("keywords", ", ")).alias("keywords"), "published_at"] if "keywords" in stories.columns else []
    return recent.select("slug", T.escape_xml(F.col("title")).alias("title"), F.concat(F.lit("https://example.com/news/"), F.col("slug")).alias("loc"), *more)


def news_xml(entries: DataFrame, publication: str, *, language: str = "en") -> DataFrame:
    """K6: (slug, xml): one <url> element of the news sitemap for each entry of news_window with keywords."""
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    paper = tag("news:publication", F.concat(tag("news:name", T.escape_xml(F.lit(publication))), tag("news:language", F.lit(language))))
    when = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    news = tag("news:news", F.concat(paper, tag("news:publication_date", when), tag("news:title", F.col("title")), tag("news:keywords", F.col("keywords"))))
    return entries.select("slug", tag("url", F.concat(tag("loc", F.col("loc")), news)).alias("xml"))
