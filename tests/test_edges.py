"""Boundaries of rules, on inline rows."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.functions.num import jsround, pct_change
from lodestar.operators import corpus, gates, jsonld, network, rules, search


def col(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expr(F.col("x"))).collect()]


def test_rounding_goes_up_at_halves(spark):
    assert col(spark, [-2.5, 2.5, 0.5, -0.5], jsround, "double") == [-2.0, 3.0, 1.0, 0.0]
    assert col(spark, [0.285], lambda x: jsround(x, 2), "double") == [0.28]


def test_pct_change_without_old_value(spark):
    rows = spark.createDataFrame([(0, 5), (None, 5), (200, 219)], "o long, n long").select(pct_change(F.col("o"), F.col("n"))).collect()
    assert [r[0] for r in rows] == [None, None, 9.5]


def test_slugs(spark):
    assert col(spark, ["https://a.b/c/d/", "https://a.b", "/x?q=1"], T.url_slug) == ["d", "a.b", "x?q=1"]
    assert col(spark, ["/c/post-1.md", "/c/about/page.tsx"], T.file_slug) == ["post-1", "about"]
    assert col(spark, ["/c/post-1.md", "/c/about/page.tsx", "x.html"], T.file_basename) == ["post-1", "page", "x.html"]
    assert col(spark, ["/a", "https://x/a"], lambda c: T.page_url(c, "sc-domain:s.example")) == ["https://s.example/a", "https://x/a"]
    assert col(spark, ["a b&c"], T.url_encode) == ["a%20b%26c"]


def test_machine_queries(spark):
    q = ["july 28 2026 is it yes or no", "the latest", "yes the latest", "yes the latest\n", "2024 to 2026 latest"]
    assert col(spark, q, search.is_machine_query) == [True, False, True, False, True]


def test_intents(spark):
    q = ["best tools", "a vs b", "laptop pricing", "what now", "this is", "this is it", "acme"]
    assert col(spark, q, search.intent) == ["comparison", "comparison", "transactional", "informational", "navigational", "informational", "navigational"]


def test_edges_of_words_are_ascii(spark):
    assert col(spark, ["é2024", "in 2024."], lambda x: T.count_all(x, T.FACTS)) == [1, 1]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["$1.5B ", "42% ", "3.5x ", "4,620,000 ", "14 million ", "Q1 2026 ", "January 15, 2026 ", "3:1 ", "Series B ", "word ", ", "]), max_size=12))
def test_facts_never_repeat(parts):
    """The sum over patterns equals the number of distinct (place, text) pairs."""
    text = "".join(parts)
    patterns = [re.compile(T.edges(p), re.A) for p in T.FACTS]
    found = [(m.start(), m.group()) for p in patterns for m in p.finditer(text)]
    assert len(found) == len(set(found))


def test_front_matter_is_cut_once(spark):
    raw = "---\na: 1\n---\nBody [l](http://x) **b**\n---\nc\n---\n"
    df = spark.createDataFrame([(raw, ".md")], "raw string, ext string").select(T.file_text(F.col("raw"), F.col("ext")))
    assert df.first()[0] == "\nBody l b\n---\nc\n---\n"


def test_striking_distance_fractional_target(spark):
    import datetime

    day = datetime.date(2024, 1, 20)
    rows = [(day, "p", "q", 0, 1000, 75), (day, "r", "q", 0, 1000, 70), (day, "s", "q", 0, 1000, 120)]
    fact = spark.createDataFrame(rows, "date date, page string, query string, clicks long, impressions long, position_x10 long")
    got = {r.page: (r.target_position, r.projected_clicks) for r in search.striking_distance(fact, datetime.date(2024, 1, 31)).collect()}
    assert got == {"p": (5.5, 50), "r": (5.0, 35), "s": (8.0, 15)}


def test_jsonld(spark):
    def block(x):
        return f'<script type="application/ld+json">{x}</script>'

    rows = [
        ("graph", block('{"@graph":[{"@type":"Person"},{"@type":["Article","X"],"@context":"c","headline":"h","author":"A","datePublished":"d"}]}')),
        ("list", block('[{"@type":"Organization","@context":"c","name":"","url":0}]')),
        ("null", block("null") + block("[null]") + block('{"@graph":{"a":1}}')),
        ("none", "no schema"),
    ]
    df = spark.createDataFrame([(p, r) for p, r in rows], "path string, raw string")
    items = sorted((r.path, r.type) for r in jsonld.items(df).collect())
    assert items == [("graph", "Article"), ("graph", "Person"), ("list", "Organization"), ("null", "ParseError"), ("null", "ParseError"), ("null", "ParseError")]
    issues = sorted((r.path, r.message) for r in jsonld.issues(jsonld.items(df)).where("path <> 'null'").collect())
    assert issues == [
        ("graph", "Article author missing sameAs/url (weakens E-E-A-T entity)"), ("graph", "Missing @context on Person schema"), ("graph", "Person missing required field: name"),
        ("list", "Organization missing required field: name"), ("list", "Organization missing required field: url"),
    ]


def test_slug_jitter_is_the_whole_number(spark):
    import hashlib

    got = gates.slug_jitter(spark.createDataFrame([("post-1",), ("",)], "slug string")).collect()
    assert [r.minutes_back for r in got] == [int(hashlib.sha1(s.encode()).hexdigest(), 16) % 14 + 1 for s in ("post-1", "")]


def test_insert_links_in_order(spark):
    df = spark.createDataFrame([("Acme and acme beta",), (None,)], "raw string")
    got = [r.linked for r in corpus.insert_links(df, [(["acme"], "/a"), (["gamma", "beta"], "/b")]).collect()]
    assert got == ["[Acme](/a) and acme [beta](/b)", None]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_made_once_in_a_plan(spark):
    from lodestar import catalog

    for name, mark in (("factual_density", "(?s)```"), ("template_pattern_hits", "^import"), ("repeated_ngrams", "^import")):
        assert plan(catalog.queries()[name](spark, "/root/testdata/sf0.001"))[0].count(mark) == 1, name


def test_refresh_has_no_nested_loop_over_files(spark):
    from lodestar import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "CartesianProduct" not in plan(catalog.queries()["refresh_candidates"](spark, "/root/testdata/sf0.001"))[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_refresh_matches_slugs_anywhere(spark):
    import datetime

    day = datetime.date(2024, 1, 1)
    pages = spark.createDataFrame([(u, 1, 500, 0.2, 5.0) for u in ("https://s/blog/abc", "https://s/abcd/x", "https://s/zz/", "q")], "page string, clicks long, impressions long, ctr_pct double, position double")
    files = spark.createDataFrame([("zz", 3, "c", day, 30), ("abc", 2, "b", day, 30), ("bcd", 1, "a", day, 30), (None, 0, "n", day, 30), ("a longer slug than any url that there is here", 0, "l", day, 9)], "slug string, file_ord long, path string, last_updated date, days_since_update int")
    assert {r.page: r.path for r in corpus.refresh_status(pages, files).collect()} == {"https://s/blog/abc": "b", "https://s/abcd/x": "a", "https://s/zz/": "c", "q": None}
    assert corpus.refresh_status(pages, files.limit(0)).where("status = 'UNMATCHED'").count() == 4


def test_related_posts_against_pairs(spark):
    import random

    rng = random.Random(3)
    rows = [(f"p{i:03}", i % 7, rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)) + ["hot"] * (i % 2)) for i in range(90)]
    got = {}
    for r in corpus.related_posts(spark.createDataFrame(rows, "slug string, date int, tags array<string>")).orderBy("rank").collect():
        got.setdefault(r.slug, []).append((r.related, r.score))
    for slug, _, tags in rows:
        best = sorted((-len(set(tags) & set(t)), -d, s) for s, d, t in rows if s != slug and set(tags) & set(t))[:4]
        assert got.get(slug, []) == [(s, -n) for n, _, s in best], slug


def test_insert_links_against_single_texts(spark):
    rng = __import__("random").Random(4)
    targets = [(["acme corp", "acme"], "/a$1"), (["beta"], "/b"), (["(x)"], "/x"), (["été"], "/e"), (["q"], "/q"), (["zed"], "/z")]
    texts = [" ".join(rng.choices(["Acme", "acme corp", "BETA", "[beta]", "<acme>", "beta,", "(x)", "Été", "q", "q_", "zed", "\n", "éacme"], k=rng.randint(0, 12))) for _ in range(80)]

    def linked(t, most):
        done = 0
        for phrases, url in targets:
            for p in phrases if done < most else ():
                if m := re.search(rf"(?<![A-Za-z0-9_\[<])({re.escape(p)})(?![A-Za-z0-9_\]>])", t, re.I | re.A):
                    t, done = f"{t[: m.start()]}[{m[1]}]({url}){t[m.end() :]}", done + 1
                    break
        return t

    for most in (5, 2):
        got = corpus.insert_links(spark.createDataFrame([(t,) for t in texts], "raw string"), targets, most=most)
        assert [r.linked for r in got.collect()] == [linked(t, most) for t in texts]
        assert "Python" not in plan(got)[1]


def test_jsonld_limits(spark):
    def page(name, x):
        return (name, f'<script type="application/ld+json">{x}</script>')

    words = " ".join(["w"] * 121)
    question = '{"@type":"Question","name":"n","acceptedAnswer":{"@type":"Answer","text":"%s"}}'
    rows = [
        page("faq", '{"@context":"c","@type":"FAQPage","mainEntity":[%s]}' % ",".join([question % words] * 6)),
        page("headline", '{"@context":"c","@type":"Article","headline":"%s","author":{"name":"a","url":"u"},"datePublished":"d"}' % ("h" * 111)),
        page("data", '{"@context":"c","@type":"Dataset","name":"n","description":"d"}'),
    ]
    got = {}
    for r in jsonld.issues(jsonld.items(spark.createDataFrame(rows, "path string, raw string"))).collect():
        got.setdefault(r.path, []).append(r.message)
    assert any("121 words" in m for m in got["faq"]) and any("temporalCoverage" in m for m in got["data"]) and any("variableMeasured" in m for m in got["data"])
    assert any("eadline" in m for m in got["headline"]), got


def test_rules(spark):
    rows = spark.createDataFrame([("a", "ranked-list", 849), ("b", "ranked-list", 850), ("c", "ranked-list", 1201), ("d", "poem", 1)], "slug string, format string, word_count long")
    assert {r.slug: r.verdict for r in rules.word_range_gate(rows).collect()} == {"a": "short", "b": "ok", "c": "long", "d": "no rule"}
    commits = spark.createDataFrame([(1, "x [nobuild] [deploy-tick]", ["a.ts"]), (2, "x [deploy-tick]", ["a.md"]), (3, "x", ["a.md", "_posts/b.ts"]), (4, "x", ["a.md", "b.ts"]), (5, "x", None), (6, "x", [])], "id int, subject string, files array<string>")
    assert {r.id: r.build for r in rules.build_decision(commits).collect()} == {1: False, 2: True, 3: False, 4: True, 5: True, 6: False}
    plan_ = spark.createDataFrame([("n", "newsContent", "KEEP", 60, 7), ("m", "newsContent", "MERGE", 60, 7), ("f", "other", "KEEP", 49, 30), ("y", "evergreenGuides", "KEEP", 60, 59), ("z", "other", "KEEP", 60, None)], "path string, content_type string, bucket string, impressions long, days_since_update int")
    assert {r.path: (r.stale, r.refresh) for r in rules.refresh_plan(plan_).collect()} == {"n": (True, True), "m": (True, False), "f": (True, False), "y": (False, False), "z": (False, False)}
    facts = spark.createDataFrame([("p", "acme", "value", 1), ("q", "acme", "value", 2), ("p", "acme", "age", 3), ("q", "acme", "age", 3)], "slug string, entity string, metric string, value long")
    assert [(r.entity, r.metric, r.stated, r.posts) for r in rules.contradictions(facts).collect()] == [("acme", "value", 2, 2)]


def test_posts_before_across_buckets(spark):
    import random

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i * rng.choice([1, 3]) + 1000 * (i // 40), rng.choice("xyz"), f"s{i:03}") for i in range(120)]
    rows = list({(c, o): (c, o, v, s) for c, o, v, s in rows}.values())
    df = spark.createDataFrame(rows, "channel string, ord long, closer string, slug string")
    for n, bucket in ((3, 7), (1, 10**6), (20, 5)):
        want = {}
        for c, o, _, s in rows:
            want[s] = [v for _, v in sorted((o2, v) for c2, o2, v, _ in rows if c2 == c and o2 < o)][-n:]
        got = gates.before(df, ["ord"], F.floor(F.col("ord") / bucket), "closer", n).collect()
        assert {r.slug: r._before for r in got} == want and len(got) == len(rows)


def test_every_template_pattern_is_found(spark):
    """Texts made from the patterns themselves, against Python's engine; some stand in capitals or across a text."""
    said = [
        "the short answer is", "the longer answer is more interesting", "let's dive", "in this post", "if you've been following", "it's worth noting", "here's the kicker", "the bigger story", "what does this mean for",
        "to put this in context", "what to watch:", "the bottom line:", "only time will tell", "it remains to be seen", "the takeaway here", "looking ahead, we", "it's crucial to note", "while it's too early to say", "there's no denying",
        "whether any of this will ever pay off remains unclear", "in an era of", "the rapidly evolving landscape", "at the crossroads of", "marks a pivotal moment",
    ]
    texts = [("all", ". ".join(said).upper()), ("twice", " ".join([said[0], said[0]])), ("none", "plain text"), *[(f"t{i}", x) for i, x in enumerate(said)]]
    got = {r.pattern: (r.matches, r.files) for r in corpus.pattern_hits(spark.createDataFrame(texts, "path string, text string"), threshold=1).collect()}
    want = {}
    for p in T.TEMPLATES:
        n = [len(re.findall(p, t, re.I)) for _, t in texts]
        want[p] = (sum(n), sum(map(bool, n)))
    assert got == want and len(got) == 24


def test_internal_links_with_a_base(spark):
    raw = '<a href="https://s.example/blog/one"> <a href="/two/"> <a href="//cdn/x"> <a href="https://other/three"> <a href="#a"> "some-slug"'
    got = spark.createDataFrame([(raw,)], "raw string").select(corpus.internal_links(F.col("raw"), "https://s.example")).first()[0]
    assert sorted(got) == ["one", "some-slug", "two"]


def test_list_file(spark):
    df = spark.createDataFrame([(" a ",), ("# c",), ("",), ("b",)], "value string")
    assert [r.item for r in network.list_items(df).collect()] == ["a", "b"]


def test_submit_is_dry_by_default(spark):
    df = spark.createDataFrame([("u", "URL_UPDATED")], "url string, type string")
    assert network.submit(df, lambda u, t: {"status": "SENT"}).first().status == "DRY_RUN"


def test_top_k_is_distributed(spark):
    from lodestar.sources.derived import AS_OF, search_analytics

    plan = search.weekly_top_pages(search_analytics(spark, "/root/testdata/sf0.001"), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
