"""Corpus analytics over content (path, slug, ext, raw, ...)."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.num import jsround, pos1

# Content audit


def content_features(content: DataFrame, *, thin: int = 300, own_host: str = "example\\.com") -> DataFrame:
    """T6, T8a, T9, T14, T18-T20."""
    c = content.withColumn("_t", T.audit_text(F.col("raw")))
    return c.select(
        "path", "slug", F.size(T.words(F.col("_t"), 2)).cast("long").alias("word_count"), (F.size(T.words(F.col("_t"), 2)) < thin).alias("is_thin"),
        T.count_all(F.col("_t"), tuple(f"(?i){p}" for p in T.AUDIT_PHRASES)).cast("long").alias("template_count"),
        F.regexp_count("raw", F.lit(f'href="https?://(?!{own_host})[^"]+"')).cast("long").alias("external_links"),
        F.col("raw").rlike(
            "application/ld\\+json|jsonLd|articleSchema|faqSchema"
        ).alias("has_schema"), F.regexp_count("raw", F.lit("<img |<Image |next/image")).cast("long").alias("image_count"),
    )


def content_audit(features: DataFrame, pages: DataFrame) -> DataFrame:
    """Features joined to page metrics (page, clicks, impressions, ctr, position) by slug, a bucket and its reasons.

    Of several pages with one slug the last by page counts.
    """
    by_slug = pages.withColumn("slug", T.url_slug(F.col("page"))).groupBy("slug").agg(
        F.max_by(F.struct("clicks", "impressions", "ctr", "position"), "page").alias("m")
    ).select("slug", "m.*")
    x = features.join(by_slug, "slug", "left").na.fill(0, ["clicks", "impressions", "ctr", "position"])
    c = F.col
    bucket = (
        F.when(c("is_thin") & (c("clicks") == 0) & (c("impressions") < 50), "KILL")
        .when((c("template_count") >= 3) & (c("clicks") == 0), "KILL")
        .when((c("impressions") > 100) & (c("impressions") < 500) & (c("ctr") < 0.005), "MERGE")
        .when((c("impressions") >= 1000) & (c("ctr") < 0.02) & c("position").between(4, 20), "UPDATE")
        .when((c("clicks") >= 10) & (c("ctr") >= 0.01), "PROMOTE")
        .otherwise("KEEP")
    )
    s = lambda x: x.cast("string")
    x = x.withColumn("bucket", bucket)
    # Messages (fixed values).
    reasons = F.array_compact(F.array(
        F.when(c("is_thin"), F.concat(F.lit("Thin content: "), s(c("word_count")), F.lit(" words"))), F.when(
            c("template_count") >= 2, F.concat(s(c("template_count")), F.lit(" template phrases detected"))
        ),
        F.when(
            c("external_links") == 0, "No external links (citation gap)"
        ), F.when(~c("has_schema"), "Missing structured data / schema"), F.when(c("image_count") == 0, "No images"),
        F.when((c("clicks") == 0) & (c("impressions") > 0), F.concat(s(c("impressions")), F.lit(" impressions, 0 clicks"))),
        F.when(
            c("bucket") == "UPDATE",
            F.concat(F.lit("Title rewrite candidate: pos "), _number(pos1(c("position"))), F.lit(", "), _number(jsround(c("ctr") * 100.0, 2)), F.lit("% CTR"))
        ),
        F.when(c("bucket") == "PROMOTE", F.concat(F.lit("High performer: "), s(c("clicks")), F.lit(" clicks. Boost with internal links."))),
    ))
    return x.withColumn("reasons", reasons)


def _number(x: Column) -> Column:
    """A double as reports write it: without a fraction of zero."""
    return F.regexp_replace(x.cast("string"), "\\.0\\z", "")


# Refresh tracking


def file_dates(content: DataFrame, as_of: date) -> DataFrame:
    """The date that a file states, else its modification date where content has `mtime`. A date that does not exist counts as none."""
    d = [F.try_to_date(F.nullif(F.regexp_extract("raw", f"{k}:\\s*['\"]?(\\d{{4}}-\\d{{2}}-\\d{{2}})['\"]?", 1), F.lit(""))) for k in ("lastUpdated", "date")]
    if "mtime" in content.columns:
        d.append(F.to_date("mtime"))
    out = content.where(F.col("ext").isin(".md", ".mdx", ".tsx", ".jsx")).withColumn("last_updated", F.coalesce(*d))
    return out.withColumn("days_since_update", F.datediff(F.lit(as_of), "last_updated"))


def refresh_status(pages: DataFrame, files: DataFrame, *, stale_days: int = 30, min_impressions: int = 100) -> DataFrame:
    """Each page with the first file (by file_ord) whose slug stands anywhere in its url, as in its last segment.

    pages (page, clicks, impressions, ctr_pct, position). A url's pieces of the lengths that slugs have are joined to the
    slugs, so that the work grows with pages and files, not with their product.
    """
    p = pages.where(F.col("impressions") >= min_impressions)
    slugs = files.where("slug is not null").groupBy("slug").agg(F.min(F.struct("file_ord", "path", "last_updated", "days_since_update")).alias("f"))
    # One row: the lengths of slugs, a few dozen numbers.
    lengths = files.agg(F.collect_set(F.length("slug")).alias("lengths"))
    starts = lambda n: F.when(n <= F.length("page"), F.sequence(F.lit(1), F.length("page") - n + 1)).otherwise(F.array().cast("array<int>"))
    cut = F.array_distinct(F.flatten(F.transform("lengths", lambda n: F.transform(starts(n), lambda i: F.substr(F.col("page"), i, n)))))
    piece = p.select("page").crossJoin(F.broadcast(lengths)).select("page", F.explode(cut).alias("slug"))
    first = piece.join(slugs, "slug").groupBy("page").agg(F.min("f").alias("f")).select("page", "f.*")
    x = p.join(first, "page", "left")
    c = F.col
    days = c("days_since_update")
    status = F.when(c("path").isNull(), "UNMATCHED").when(days >= stale_days, "STALE").otherwise("HEALTHY")
    # Messages (fixed values).
    reasons = F.array_compact(F.array(
        F.when(days >= 60, "Content is significantly outdated — Google may be deprioritizing for freshness"),
        F.when((c("impressions") > 5000) & (c("ctr_pct") < 0.5), "High impressions but very low CTR — title may need refreshing alongside content"),
        F.when(c("position").between(4, 10), "Ranking on page 1 — a refresh could push to top 3"),
        F.when((c("position") > 10) & (c("position") <= 20), "Page 2 — a content refresh with updated data could break back to page 1"),
    ))
    reason = F.when(F.size(reasons) == 0, "Page is stale and still getting traffic — refresh to maintain ranking").otherwise(F.array_join(reasons, ". "))
    x = x.withColumn("status", status)
    stale = c("status") == "STALE"
    return x.select(
        "page", "path", "impressions", "clicks", "ctr_pct", "position", "last_updated", days.cast("long").alias("days_since_update"),
        "status", F.when(stale, F.when(days >= 2 * stale_days, "CRITICAL").otherwise("HIGH")).alias("urgency"),
        F.when(stale, reason).alias("reason")
    )


# Template fingerprints


def extracted(content: DataFrame) -> DataFrame:
    return content.select("path", T.file_text(F.col("raw"), F.col("ext")).alias("text"))


def _template_hits(texts: DataFrame) -> DataFrame:
    """(path, pattern, n): matches of each known pattern in each text. A pattern is looked for where plain parts of it stand."""
    needed = {p: T.needs(p) for p in T.TEMPLATES}
    every = tuple(dict.fromkeys(x for parts in needed.values() for x in parts))
    both = F.transform(F.array("text"), lambda t: F.struct(t.alias("t"), F.lower(t).alias("low")))
    t = texts.select("path", F.explode(F.filter(both, lambda s: T.holds(s["low"], every))).alias("s")).select("path", "s.*")
    one = lambda p: F.when(T.holds(F.col("low"), needed[p]), F.regexp_count("t", F.lit(f"(?i){p}"))).otherwise(F.lit(0))
    counts = F.array(*[F.struct(F.lit(p).alias("pattern"), one(p).alias("n")) for p in T.TEMPLATES])
    return t.select("path", F.explode(F.filter(counts, lambda x: x["n"] > 0)).alias("h")).select("path", "h.*")


def pattern_hits(texts: DataFrame, *, threshold: int = 3) -> DataFrame:
    """Matches and files of each known pattern with at least `threshold` matches. One narrow pass counts all patterns."""
    return _template_hits(texts).groupBy("pattern").agg(
        F.sum("n").cast("long").alias("matches"), F.countDistinct("path").alias("files")
    ).where(F.col("matches") >= threshold)


def template_summary(texts: DataFrame, *, threshold: int = 3) -> DataFrame:
    """Files with any pattern that reaches the threshold."""
    hits = _template_hits(texts)
    often = hits.groupBy("pattern").agg(F.sum("n").alias("m")).where(F.col("m") >= threshold).select("pattern")
    files = hits.join(often, "pattern", "left_semi").agg(F.countDistinct("path").alias("files_with_hits"))
    pct = F.floor(F.col("files_with_hits").cast("double") / F.nullif(F.col("files_scanned"), F.lit(0)) * 100.0 + 0.5).cast("long")
    return texts.agg(F.count("*").alias("files_scanned")).crossJoin(files).withColumn("pct_affected", pct)


def repeated_ngrams(texts: DataFrame, *, n: int = 5, threshold: int = 3) -> DataFrame:
    """Word n-grams of sentences in at least `threshold` files (one row each); distinct within a row, then summed map-side."""
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    words = F.transform(T.sentences(F.col("text")), lambda s: F.split(s, "\\s+"))
    each = texts.select(F.explode(F.array_distinct(F.flatten(F.transform(words, grams)))).alias("ngram"))
    return each.groupBy("ngram").agg(F.count("*").alias("files")).where(F.col("files") >= threshold)


def shared_closers(texts: DataFrame, *, threshold: int = 3) -> DataFrame:
    """T11, T12, A9."""
    last = F.try_element_at(T.paragraphs(F.col("text"), 30), F.lit(-1))
    closer = texts.withColumn("_l", last).where("_l is not null").select("path", T.trim_all(F.lower(F.expr("right(_l, 60)"))).alias("closer"))
    return closer.groupBy("closer").agg(F.count("*").alias("files")).where(F.col("files") >= threshold)


# Factual density


def factual_density(content: DataFrame, *, threshold: float = 3, min_words: int = 50) -> DataFrame:
    """T15-T17, C13, P9."""
    scored = F.transform(
        F.array(T.file_text(F.col("raw"), F.col("ext"), fences=True)),
        lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"), F.size(T.words(t)).cast("long").alias("n"))
    )
    x = content.select(
        "path", F.explode(F.filter(scored, lambda s: s["n"] >= min_words)).alias("s")
    ).select("path", F.col("s.n").alias("word_count"), F.col("s.t").alias("_t"), F.col("s.low").alias("_low"))
    t, low = F.col("_t"), F.col("_low")
    x = x.withColumn("fact_count", T.count_all(t, T.FACTS, low, T.FACT_NEEDS).cast("long"))
    x = x.withColumn("entity_count", T.count_all(t, T.ENTITIES, low, T.ENTITY_NEEDS).cast("long"))
    x = x.withColumn("_p", T.paragraphs(F.col("_t"), 50)).withColumn("total_paragraphs", F.size("_p").cast("long"))
    # A text without facts has no paragraph with any.
    each = F.transform("_p", lambda p: F.struct(p.alias("p"), F.lower(p).alias("low")))
    without = F.size(F.filter(each, lambda s: ~T.finds_any(s["p"], s["low"], T.FACTS, T.FACT_NEEDS)))
    x = x.withColumn("paragraphs_without_facts", F.when(F.col("fact_count") == 0, F.size("_p")).otherwise(without).cast("long"))
    x = x.withColumn("density_per_1k", F.floor(F.col("fact_count").cast("double") / F.col("word_count") * 10000.0 + 0.5) / 10.0)
    d = F.col("density_per_1k")
    grade = F.when(d >= threshold * 2, "A").when(d >= threshold, "B").when(d >= threshold * 0.5, "C").when(d > 0, "D").otherwise("F")
    return x.select("path", "word_count", "fact_count", "entity_count", "density_per_1k", grade.alias("grade"), "paragraphs_without_facts", "total_paragraphs")


def density_summary(density: DataFrame, *, threshold: float = 3) -> DataFrame:
    """Sums of tenths are integers, so the mean does not depend on the order."""
    tenths = F.sum((F.col("density_per_1k") * 10 + 0.5).cast("long"))
    mean = F.floor(tenths.cast("double") / 10.0 / F.nullif(F.count("*"), F.lit(0)) * 10.0 + 0.5) / 10.0
    return density.agg(
        F.count("*").alias("files_scored"), mean.alias("avg_density"),
        F.count_if(F.col("density_per_1k") < threshold).alias("below_threshold"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    )


# Link graph


def internal_links(raw: Column, base: str = "") -> Column:
    """Slugs that a file links to."""
    hrefs = F.regexp_extract_all(raw, F.lit("href=[\"']([^\"']+)[\"']"), F.lit(1))
    if base:
        hrefs = F.transform(hrefs, lambda u: F.when(F.startswith(u, F.lit(base)), F.substr(u, F.lit(len(base) + 1))).otherwise(u))
    slugs = F.transform(F.filter(hrefs, lambda u: F.startswith(u, F.lit("/")) & ~F.startswith(u, F.lit("//"))), T.url_slug)
    slugs = F.filter(slugs, lambda s: s.isNotNull() & ~F.contains(s, F.lit(".")) & ~F.startswith(s, F.lit("#")))
    quoted = F.filter(
        F.regexp_extract_all(raw, F.lit("['\"]([a-z0-9](?:[a-z0-9-]*[a-z0-9]))['\"]"), F.lit(1)),
        lambda s: (F.length(s) > 5) & F.contains(s, F.lit("-"))
    )
    return F.array_union(slugs, quoted)


def link_edges(content: DataFrame, base: str = "") -> DataFrame:
    """(src_path, src_slug, dst_slug), distinct for each file, to known slugs other than its own."""
    edges = content.select(
        F.col("path").alias("src_path"), F.col("slug").alias("src_slug"), F.explode(internal_links(F.col("raw"), base)).alias("dst_slug")
    ).where("dst_slug <> src_slug")
    return edges.join(content.select(F.col("slug").alias("dst_slug")).distinct(), "dst_slug", "left_semi").select("src_path", "src_slug", "dst_slug")


def link_degrees(content: DataFrame, base: str = "") -> DataFrame:
    """Inbound files and outbound links of each slug. Of several files with one slug the last by path counts outbound."""
    edges = link_edges(content, base)
    inbound = edges.groupBy(F.col("dst_slug").alias("slug")).agg(F.count("*").alias("inbound"))
    out = edges.groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("n"))
    outbound = content.select("slug", "path").join(out, "path", "left").groupBy("slug").agg(F.max_by(F.coalesce("n", F.lit(0)), "path").alias("outbound"))
    x = outbound.join(inbound, "slug", "left").select("slug", F.coalesce("inbound", F.lit(0)).alias("inbound"), "outbound")
    return x.withColumn(
        "class", F.when(F.col("inbound") == 0, "orphan").when(F.col("inbound") == 1, "low").otherwise("linked")
    ).withColumn("dead_end", F.col("outbound") == 0)


def link_summary(degrees: DataFrame) -> DataFrame:
    return degrees.agg(
        F.count("*").alias("pages"), F.count_if(F.col("class") == "orphan").alias("orphans"),
        F.count_if(F.col("class") == "low").alias("low_link"), F.count_if(F.col("class") == "linked").alias("well_linked"),
        F.count_if("dead_end").alias("dead_ends"), F.coalesce(F.sum("inbound"), F.lit(0)).alias("links")
    )


def link_places(content: DataFrame) -> DataFrame:
    """(path, url) of each place that names a url; other schemes than those of pages are left out."""
    href = F.regexp_extract_all("raw", F.lit("href=[\"']([^\"'#]+?)[\"']"), F.lit(1))
    md = F.regexp_extract_all("raw", F.lit("\\[.*?\\]\\(([^)#]+?)\\)"), F.lit(1))
    return content.select("path", F.explode(F.concat(href, md)).alias("url")).where(~F.col("url").rlike("^(mailto:|tel:|javascript:)"))


def outbound_links(content: DataFrame) -> DataFrame:
    """Url and the number of files and places that name it."""
    return link_places(content).groupBy("url").agg(F.count("*").alias("places"), F.countDistinct("path").alias("files"), F.min("path").alias("first_file"))


# Posts


def related_posts(posts: DataFrame, n: int = 4) -> DataFrame:
    """Posts (slug, date, tags) that share tags, best first: by tags shared, then the newest, then by slug.

    Posts with the same tags are alike but for date and slug, so sets of tags are compared, not posts: each set offers its
    first n + 1 posts, and each set takes the first n + 1 that all offer it. Spark keeps only those before it shuffles.
    """
    tagged = posts.select("slug", "date", F.array_sort("tags").alias("tags"))
    newest = F.row_number().over(Window.partitionBy("tags").orderBy(F.desc("date"), "slug"))
    offered = tagged.withColumn("r", newest).where(F.col("r") <= n + 1).drop("r")
    tags = tagged.select("tags").distinct().select("tags", F.explode("tags").alias("tag"))
    other = tags.select(F.col("tags").alias("theirs"), "tag")
    score = tags.join(other, "tag").groupBy("tags", "theirs").agg(F.count("*").alias("score"))
    best = F.row_number().over(Window.partitionBy("tags").orderBy(F.desc("score"), F.desc("related_date"), "related"))
    offers = score.join(offered.select(F.col("tags").alias("theirs"), F.col("slug").alias("related"), F.col("date").alias("related_date")), "theirs")
    offers = offers.withColumn("r", best).where(F.col("r") <= n + 1).drop("r", "theirs")
    rank = F.row_number().over(Window.partitionBy("slug").orderBy(F.desc("score"), F.desc("related_date"), "related"))
    return tagged.drop("date").join(offers, "tags").where("slug <> related").withColumn("rank", rank).where(F.col("rank") <= n).select(
        "slug", "rank", "related", "score"
    )


def insert_links(content: DataFrame, targets: list[tuple[list[str], str]], *, text: str = "raw", most: int = 5) -> DataFrame:
    """Content with `linked`: the first phrase of each target that stands in the text becomes a link, `most` at most.

    A phrase counts as a word of its own, in any case, and not next to a bracket. Targets change the text in order, so each is
    a step of its own that works on the one before.
    """
    x = content.withColumn("linked", F.col(text)).withColumn("_done", F.lit(0))
    for phrases, url in targets:
        t, hit = F.col("linked"), F.lit(None).cast("string")
        for p in reversed(phrases):
            own = f"(?<![A-Za-z0-9_\\[<])({re.escape(p)})(?![A-Za-z0-9_\\]>])"
            to = re.sub(r"([\\$])", r"\\\1", url)
            hit = F.when(t.rlike(f"(?i){own}"), F.regexp_replace(t, f"(?is)\\A(.*?){own}", f"$1[$2]({to})")).otherwise(hit)
        x = x.withColumn("_new", F.when(F.col("_done") < most, hit))
        x = x.withColumn("linked", F.coalesce("_new", "linked")).withColumn("_done", F.col("_done") + F.col("_new").isNotNull().cast("int"))
    return x.drop("_new", "_done")
