"""Search analytics over a fact (date, page, query, clicks, impressions, position_x10).

Every operator is a plan over its inputs, its parameters and `as_of`; none runs a job. A "row limit" ranks rows by clicks,
impressions (both descending) and key before any filter, as the source of such rows does.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.num import ctr_pct, jsround, pct_change, pos1, to_long
from ..functions.text import file_basename

#: Expected click-through rate by position, in percent (fixed values).
EXPECTED_CTR = {
    3: 8.0, 4: 5.0, 5: 3.5, 6: 2.5, 7: 2.0, 8: 1.5, 9: 1.2, 10: 1.0, 11: 0.8, 12: 0.6, 13: 0.5, 14: 0.4, 15: 0.3, 16: 0.25, 17: 0.2,
    18: 0.18, 19: 0.15, 20: 0.12
}
#: Queries that are never gaps (fixed values).
EXCLUDED = "(?i)near me|jailbreak|login|sign ?in"
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def window(fact: DataFrame, as_of: date, first: int, last: int) -> DataFrame:
    """Rows of the days from `first` to `last` days before as_of, both inclusive; prunes a fact partitioned by date."""
    return fact.where(F.col("date").between(F.lit(as_of - timedelta(first)), F.lit(as_of - timedelta(last))))


def metrics(fact: DataFrame, *dims: str) -> DataFrame:
    """Clicks, impressions, ctr (a fraction) and impression-weighted position of each key; sums are exact integers."""
    sums = fact.groupBy(*dims).agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
        F.sum(F.col("impressions") * F.col("position_x10")).alias("_w")
    )
    ctr = F.col("clicks").cast("double") / F.nullif(F.col("impressions").cast("double"), F.lit(0.0))
    position = F.col("_w").cast("double") / F.nullif(F.col("impressions").cast("double") * 10.0, F.lit(0.0))
    return sums.select(*dims, "clicks", "impressions", ctr.alias("ctr"), position.alias("position"))


def scan(fact: DataFrame, first: date, last: date, *dims: str, page: str | None = None, rows: int = 1000, start: int = 0, final: bool = False) -> DataFrame:
    """The rows `start` to `start + rows` of a query of the search-analytics source, days `first` to `last` inclusive.

    `page` keeps one page. `final` keeps the rows that the fact marks as final (column `final`), else fresh ones count too.
    """
    own = fact.where(F.col("date").between(F.lit(first), F.lit(last)))
    if page is not None:
        own = own.where(F.col("page") == page)
    if final:
        own = own.where("final")
    return metrics(own, *dims).orderBy(F.desc("clicks"), F.desc("impressions"), *dims).offset(start).limit(rows)


def row_limit(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first n rows by clicks, impressions and key: a distributed top-k."""
    return rows.orderBy(F.desc("clicks"), F.desc("impressions"), *keys).limit(n)


def shown(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, "clicks", "impressions", ctr_pct(F.col("ctr")).alias("ctr_pct"), pos1(F.col("position")).alias("position"))


# Weekly report


def weekly_summary(fact: DataFrame, as_of: date) -> DataFrame:
    """A3, C17: this and last week's totals and percent changes, one row from one pass."""
    this = F.col("date") >= F.lit(as_of - timedelta(7))
    both = window(fact, as_of, 14, 1)
    sums = both.agg(
        *[
            F.coalesce(F.sum(F.when(w, v)), F.lit(0)).alias(f"{n}_{k}") for n, w in (("this", this), ("last", ~this)) for k,
            v in (("clicks", F.col("clicks")), ("impressions", F.col("impressions")), ("w", F.col("impressions") * F.col("position_x10")))
        ]
    )
    over = lambda a, b: F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    c = F.col
    return sums.select(
        *[
            x for n in ("this", "last") for x in (
                c(f"{n}_clicks"), c(f"{n}_impressions"), ctr_pct(over(c(f"{n}_clicks"), c(f"{n}_impressions"))).alias(f"{n}_ctr_pct"),
                pos1(over(c(f"{n}_w"), c(f"{n}_impressions") * 10)).alias(f"{n}_position")
            )
        ],
        pct_change(c("last_clicks"), c("this_clicks")).alias("clicks_change"), pct_change(
            c("last_impressions"), c("this_impressions")
        ).alias("impressions_change"),
        pct_change(over(c("last_clicks"), c("last_impressions")), over(c("this_clicks"), c("this_impressions"))).alias("ctr_change"),
    )


def weekly_top_pages(fact: DataFrame, as_of: date, n: int = 50) -> DataFrame:
    return row_limit(metrics(window(fact, as_of, 28, 1), "page"), n, "page")


def weekly_trending(fact: DataFrame, as_of: date, *, rows: int = 500, least: int = 50, n: int = 20) -> DataFrame:
    """Queries that more than doubled against a third of the three weeks before; unseen ones grow without bound."""
    now = row_limit(metrics(window(fact, as_of, 7, 1), "query"), rows, "query").where(F.col("impressions") >= least)
    before = row_limit(metrics(window(fact, as_of, 28, 8), "query"), rows, "query").select("query", F.col("impressions").alias("_p"))
    prior = F.coalesce(F.col("_p").cast("double") / 3.0, F.lit(0.0))
    growth = F.when(prior > 0, (F.col("impressions") - prior) / prior).otherwise(F.lit(float("inf")))
    both = now.join(before, "query", "left").withColumn("growth", growth).withColumn("prior_avg_impr", to_long(prior)).where("growth > 1")
    return both.select(
        "query", "clicks", "impressions", "ctr", "position", "prior_avg_impr", "growth"
    ).orderBy(F.desc("growth"), F.desc("clicks"), F.desc("impressions"), "query").limit(n)


def weekly_dropping(fact: DataFrame, as_of: date, *, rows: int = 200, least: int = 5, drop: int = 30, n: int = 15) -> DataFrame:
    """Pages that lost `drop` percent (after rounding) of their clicks between the halves of four weeks."""
    first = row_limit(metrics(window(fact, as_of, 28, 15), "page"), rows, "page").where(F.col("clicks") >= least)
    second = row_limit(metrics(window(fact, as_of, 14, 1), "page"), rows, "page").select("page", F.col("clicks").alias("_r"))
    both = first.join(second, "page", "left").select(
        "page", F.col("clicks").alias("prior_clicks"), F.coalesce("_r", F.lit(0)).alias("recent_clicks"), "impressions"
    )
    pct = to_long((F.col("prior_clicks") - F.col("recent_clicks")).cast("double") / F.col("prior_clicks") * 100.0)
    return both.withColumn("drop_pct", pct).where(F.col("drop_pct") >= drop).orderBy(
        F.desc("drop_pct"), F.desc("prior_clicks"), F.desc("impressions"), "page"
    ).limit(n).drop("impressions")


def weekly_ctr_triage(fact: DataFrame, as_of: date, n: int = 15) -> DataFrame:
    """Within the top pages, many impressions, a low rate and a position from 3 to 20."""
    low = weekly_top_pages(fact, as_of).where("impressions >= 1000 and ctr < 0.02D and position between 3 and 20")
    return shown(low.orderBy(F.desc("impressions"), F.desc("clicks"), "page").limit(n), "page")


def weekly_monopolies(fact: DataFrame, as_of: date, *, rows: int = 500, n: int = 20) -> DataFrame:
    """Queries at positions 1 to 3."""
    top = row_limit(metrics(window(fact, as_of, 7, 1), "query"), rows, "query").where("position <= 3 and impressions >= 100")
    return shown(top.orderBy(F.desc("impressions"), F.desc("clicks"), "query").limit(n), "query")


# Title rewrites


def is_machine_query(q: Column) -> Column:
    """Two signs or more of a machine-phrased query."""
    signs = [
        q.rlike(r"^\w{3,} \d{1,2} \d{4} "), q.rlike("(?i)latest\\z"), q.rlike(f"(?i){B}(yes|no|true|false){E}"),
        F.size(F.split(q, " ")) > 12, q.rlike(r"\d{4}.*\d{4}")
    ]
    return sum((s.cast("int") for s in signs[1:]), signs[0].cast("int")) >= 2


def intent(q: Column) -> Column:
    """The first class that fits."""
    low = F.lower(q)
    return (
        F.when(is_machine_query(low), "ai_grounding")
        .when(low.rlike(f"{B}vs{E}|compare|best|top \\d|ranked|alternative"), "comparison")
        .when(low.rlike(f"{B}buy{E}|pricing|cost|how to get|sign up|free trial"), "transactional")
        .when(low.rlike(f"{B}(?:(?:what|how|why|when){E}|(?:is|are|does) (?=[A-Za-z0-9_]))"), "informational")
        .otherwise("navigational")
    )


INTENTS = ("informational", "comparison", "transactional", "navigational", "ai_grounding")


def rewrite_candidates(
    fact: DataFrame, as_of: date, *, days: int = 28, min_impressions: int = 1000, max_ctr: float = 0.02, min_position: float = 4,
    max_position: float = 20, rows: int = 5000, queries: int = 20
) -> DataFrame:
    """Pages with a low rate, their top queries' intents, a score and a diagnosis."""
    recent = window(fact, as_of, days, 1)
    pages = row_limit(metrics(recent, "page"), rows, "page").where(
        (F.col("impressions") >= min_impressions) & (F.col("ctr") <= max_ctr) & F.col("position").between(min_position, max_position)
    )
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("clicks"), F.desc("impressions"), "query"))
    top = metrics(recent, "page", "query").join(pages.select("page"), "page", "left_semi").withColumn("r", rank).where(F.col("r") <= queries)
    found = top.groupBy("page").agg(
        F.count("*").alias("n_queries"), *[F.count_if(intent(F.col("query")) == i).alias(i) for i in INTENTS],
        F.count_if(is_machine_query(F.col("query"))).alias("n_ai")
    )
    p = pages.join(found, "page", "left").na.fill(0, ["n_queries", "n_ai", *INTENTS])
    ratio = F.coalesce(F.col("n_ai").cast("double") / F.nullif(F.col("n_queries"), F.lit(0)), F.lit(0.0))
    score = F.log10("impressions") * 20.0 + F.when(F.col("position") <= 10, 30.0).when(F.col("position") <= 15, 15.0).otherwise(0.0)
    score = score + F.when(F.col("ctr") < 0.005, 20.0).when(F.col("ctr") < 0.01, 10.0).otherwise(0.0) - F.when(ratio > 0.5, 40.0).otherwise(0.0)
    total = sum((F.col(i) for i in INTENTS[1:]), F.col(INTENTS[0]))
    share = F.col("ai_grounding").cast("double") / F.nullif(total, F.lit(0))
    # Messages and thresholds (fixed values).
    diagnosis = (
        F.when(total == 0, None)
        .when(
            share > 0.5,
            F.concat(F.lit("⚠ "), to_long(share * 100.0).cast("string"), F.lit("% AI-grounding queries — title rewrite unlikely to help. This is GEO traffic."))
        )
        .when(F.col("comparison") > F.col("informational"), 'Comparison intent dominant — consider adding "[X] vs [Y]" or "Best [X]" to the title.')
        .when(
            (F.col("ctr") == 0) & (F.col("impressions") > 50000),
            "Zero clicks at 50K+ impressions — likely AI Overview or featured snippet fully answering the query."
        )
        .when((F.col("position") <= 5) & (F.col("ctr") < 0.01), "Top-5 position but <1% CTR — title may be answering the query. Tease, don't tell.")
    )
    return p.select(
        "page", "clicks", "impressions", ctr_pct(F.col("ctr")).alias("ctr_pct"), pos1(F.col("position")).alias("position"),
        to_long(score).alias("rewrite_score"), "n_queries", *INTENTS, diagnosis.alias("diagnosis")
    )


def query_intents(fact: DataFrame) -> DataFrame:
    """C1, C2 for each query of the fact."""
    return fact.select("query").distinct().select("query", is_machine_query(F.col("query")).alias("machine"), intent(F.col("query")).alias("intent"))


# Cannibalization


def shorten(url: Column) -> Column:
    """A url without scheme and host."""
    return F.regexp_replace(url, "^https?://[^/]+", "")


def _cannibal_rows(fact: DataFrame, as_of: date, days: int, least: int) -> DataFrame:
    rows = metrics(window(fact, as_of, days, 1), "query", "page").where(F.col("impressions") >= least)
    return rows.withColumn("position", pos1(F.col("position")))


def cannibal_clusters(fact: DataFrame, as_of: date, *, days: int = 28, min_impressions: int = 100) -> DataFrame:
    """Queries with two pages or more; the page at the best position wins, the others' impressions are wasted."""
    rows = _cannibal_rows(fact, as_of, days, min_impressions)
    group = rows.groupBy("query").agg(
        F.count("*").alias("page_count"), F.sum("impressions").alias("total_impressions"), F.sum("clicks").alias("total_clicks"),
        F.min(F.struct("position", (-F.col("clicks")).alias("c"), (-F.col("impressions")).alias("i"), "page")).alias("w"),
        F.max(F.struct("position", (-F.col("clicks")).alias("c"), (-F.col("impressions")).alias("i"), "page")).alias("l")
    ).where("page_count >= 2")
    text = F.when(F.col("page_count") == 2, F.concat(F.lit("Consolidate: 301 "), shorten(F.col("l.page")), F.lit(" → "), shorten(F.col("w.page")), F.lit(", merge best content."))).otherwise(
        F.concat(
            F.lit("Consolidate "), (F.col("page_count") - 1).cast("string"), F.lit(" pages: 301 all losers → "), shorten(F.col("w.page")),
            F.lit(", merge best content from each.")
        )
    )
    return group.select(
        "query", "page_count", "total_impressions", "total_clicks", (F.col("total_impressions") + F.col("w.i")).alias("wasted_impressions"),
        F.col("w.page").alias("winner_page"), F.col("w.position").alias("winner_position"), text.alias("recommendation")
    )


def cannibal_losers(fact: DataFrame, as_of: date, *, days: int = 28, min_impressions: int = 100) -> DataFrame:
    """A1: every losing page of a cluster with its rank."""
    w = Window.partitionBy("query").orderBy("position", F.desc("clicks"), F.desc("impressions"), "page")
    rows = _cannibal_rows(fact, as_of, days, min_impressions).withColumn("loser_rank", F.row_number().over(w) - 1)
    return rows.where("loser_rank >= 1").select("query", "loser_rank", "page", "position", "clicks", "impressions")


def cannibal_totals(clusters: DataFrame) -> DataFrame:
    """Clusters and their wasted impressions."""
    return clusters.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("wasted_impressions"), F.lit(0)).alias("total_wasted"))


# Striking distance


def _expected(position: Column, default: float) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in EXPECTED_CTR.items() for x in (float(k), v)])
    return F.coalesce(F.try_element_at(table, position), F.lit(default))


def striking_distance(
    fact: DataFrame, as_of: date, *, days: int = 28, min_position: float = 5, max_position: float = 20, min_impressions: int = 200,
    rows: int = 10000
) -> DataFrame:
    """Pages just short of good positions, the clicks a move would gain, and what to do."""
    all_rows = row_limit(metrics(window(fact, as_of, days, 1), "page", "query"), rows, "page", "query")
    near = all_rows.withColumn("ctr_pct", ctr_pct(F.col("ctr"))).withColumn("position", pos1(F.col("position"))).where(
        F.col("position").between(min_position, max_position) & (F.col("impressions") >= min_impressions)
    )
    best = F.min(F.struct((-F.col("impressions")).alias("i"), (-F.col("clicks")).alias("c"), "query", "position", "ctr_pct")).alias("b")
    g = near.groupBy("page").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.count("*").alias("query_count"), best)
    g = g.select(
        "page", F.col("b.query").alias("top_query"), F.col("b.position").alias("position"), F.col("b.ctr_pct").alias("ctr_pct"),
        "impressions", "clicks", "query_count"
    )
    target = F.when(F.col("position") > 10, 8.0).otherwise(F.greatest(F.lit(3.0), F.col("position") - 2.0))
    now = F.col("impressions") * (_expected(jsround(F.col("position")), 0.5) / 100.0)
    then = F.col("impressions") * (_expected(F.col("target_position"), 5.0) / 100.0)
    g = g.withColumn("target_position", target)
    g = g.select("*", to_long(now).alias("current_est_clicks"), to_long(then).alias("projected_clicks"), to_long(then - now).alias("click_gain"))
    # Messages (fixed values).
    actions = F.array_compact(
        F.array(
            F.when(F.col("position") > 10, "Add depth: expand the section that matches this query, add data/examples"),
            F.when(F.col("position") > 10, "Build internal links: point 3-5 related pages to this one"),
            F.when(F.col("position").between(5, 10), "Add an FAQ section answering related questions"),
            F.when(F.col("position").between(5, 10), "Update with fresh data — trigger lastmod freshness signal"),
            F.when(F.col("ctr_pct") < _expected(jsround(F.col("position")), 1.0), "Rewrite title to better match this query's intent")
        )
    )
    return g.withColumn("actions", F.array_join(actions, " | "))


def striking_totals(pages: DataFrame) -> DataFrame:
    """Pages and the clicks that their moves would gain."""
    return pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum("click_gain"), F.lit(0)).alias("total_click_gain"))


# Query gaps


def gap_type(q: Column) -> Column:
    """C8."""
    return (
        F.when(q.rlike(r"\d{4}"), "TIME-SENSITIVE")
        .when(q.rlike(f"(?i)^(what|how|why|when|where|who|is|are|can|do|does){E}"), "QUESTION")
        .when(q.rlike(f"(?i){B}vs{E}|versus|compared?{E}|comparison"), "COMPARISON")
        .when(q.rlike(f"(?i){B}best{E}|top{E}|ranking|rated"), "RANKING")
        .when(q.rlike(f"(?i){B}price|cost|salary|worth|valuation|revenue"), "DATA-DRIVEN")
        .otherwise("INFORMATIONAL")
    )


def query_gaps(
    fact: DataFrame, topics: DataFrame | None, as_of: date, *, days: int = 60, min_impressions: int = 80, min_position: float = 15,
    top: int | None = 25
) -> DataFrame:
    """Queries that rank badly and have no page. topics (word) is the vocabulary, one bag."""
    q = metrics(window(fact, as_of, days, 1), "query").withColumn("ctr_pct", ctr_pct(F.col("ctr"))).withColumn("position", pos1(F.col("position")))
    q = q.where((F.col("impressions") >= min_impressions) & (F.col("position") >= min_position) & ~F.col("query").rlike(EXCLUDED))
    if topics is not None:
        words = q.select("query", F.explode(F.filter(F.split(F.lower("query"), "\\s+"), lambda w: F.length(w) > 3)).alias("word"))
        hits = words.join(
            topics.select("word", F.lit(1).alias("hit")).distinct(), "word", "left"
        ).groupBy("query").agg(F.count("*").alias("n"), F.count("hit").alias("m"))
        served = hits.where(F.col("m") >= F.col("n") * 0.8).select("query")
        q = q.join(served, "query", "left_anti")
    q = q.select(
        "query", "clicks", "impressions", "ctr_pct", "position", gap_type(F.col("query")).alias("type"),
        to_long(F.col("impressions") * (F.lit(1.0) / F.col("position")) * 100.0).alias("score")
    )
    return q if top is None else q.orderBy(F.desc("score"), F.desc("clicks"), F.desc("impressions"), "query").limit(top)


def topic_words(content: DataFrame) -> DataFrame:
    """Distinct words of slugs and titles of markdown and JSX files."""
    files = content.where(F.col("ext").isin(".md", ".mdx", ".tsx", ".jsx"))
    slug = F.filter(F.transform(F.split(file_basename(F.col("path")), "[-_]"), F.lower), lambda w: F.length(w) > 2)
    title = F.regexp_extract("raw", "(?m)title:\\s*['\"]?(.*?)['\"]?\\s*$", 1)
    words = F.filter(F.split(F.lower(title), "\\s+"), lambda w: F.length(w) > 3)
    return files.select(F.explode(F.array_union(slug, words)).alias("word")).distinct()


# Rewrite impact


def baseline(fact: DataFrame, as_of: date, days: int = 28) -> DataFrame:
    return shown(metrics(window(fact, as_of, days, 1), "page"), "page")


def rewrite_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two snapshots of pages (clicks, impressions, ctr_pct, position) compared."""
    b = before.select("page", *[F.col(c).alias(f"before_{c}") for c in ("clicks", "impressions", "ctr_pct", "position")])
    a = after.select("page", *[F.col(c).alias(f"after_{c}") for c in ("clicks", "impressions", "ctr_pct", "position")])
    x = a.join(b, "page")
    ctr = F.col("after_ctr_pct") - F.col("before_ctr_pct")
    clicks = F.col("after_clicks") - F.col("before_clicks")
    impressions = F.when(
        F.col("before_impressions") > 0,
        to_long((F.col("after_impressions") - F.col("before_impressions")).cast("double") / F.col("before_impressions") * 100.0)
    ).otherwise(0)
    verdict = F.when((ctr > 0.5) & (clicks > 0), "WIN").when(ctr > 0.2, "SLIGHT WIN").when(ctr < -0.5, "REGRESSED").otherwise("NEUTRAL")
    return x.select(
        "*", impressions.alias("impressions_change_pct"), clicks.alias("clicks_change"), jsround(ctr, 2).alias("ctr_change"),
        jsround(F.col("before_position") - F.col("after_position"), 1).alias("position_change"), verdict.alias("verdict")
    )


def impact_summary(impact: DataFrame) -> DataFrame:
    """A18."""
    return impact.agg(
        F.count("*").alias("total"), F.count_if(F.col("verdict").isin("WIN", "SLIGHT WIN")).alias("wins"),
        F.count_if(F.col("verdict") == "REGRESSED").alias("regressed"), F.coalesce(F.sum("clicks_change"), F.lit(0)).alias("net_clicks")
    )
