"""JSON-LD validation on VARIANT values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Required fields by type, and the types that a site should have (fixed values).
REQUIRED = {
    "Article": ("headline", "author", "datePublished"),
    "NewsArticle": ("headline", "author", "datePublished"),
    "FAQPage": ("mainEntity",),
    "Dataset": ("name", "description"),
    "Organization": ("name", "url"),
    "WebSite": ("name", "url"),
    "BreadcrumbList": ("itemListElement",),
    "ItemList": ("itemListElement",),
    "Person": ("name",),
}
SITE_TYPES = ("FAQPage", "Article", "BreadcrumbList", "Organization", "WebSite")
SCRIPT = "(?is)<script[^>]*type=[\"']application/ld\\+json[\"'][^>]*>(.*?)</script>"


def _get(item: str, field: str, kind: str = "variant") -> str:
    return f"""try_variant_get({item}, '$["{field}"]', '{kind}')"""


def _truthy(v: str) -> str:
    """Whether a value is there and is not null, false, 0 or an empty text; empty lists and objects are there."""
    s, kind = f"try_variant_get({v}, '$', 'string')", f"schema_of_variant({v})"
    return f"({v} IS NOT NULL AND {kind} <> 'VOID' AND NOT ({kind} = 'STRING' AND {s} = '') AND NOT ({kind} = 'BOOLEAN' AND {s} = 'false') AND NOT ({kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' AND coalesce(try_variant_get({v}, '$', 'double'), 1) = 0))"


def items(content: DataFrame) -> DataFrame:
    """V1-V3: (path, block, item, v, type): one row for each schema of each file; a block that does not parse is a ParseError."""
    blocks = content.select("path", F.posexplode(F.regexp_extract_all("raw", F.lit(SCRIPT), F.lit(1))).alias("block", "body"))
    v = F.expr("try_parse_json(body)")
    graph = _get("_v", "@graph")
    parts = F.expr(
        f"CASE WHEN _v IS NULL OR is_variant_null(_v) THEN array(cast(NULL AS variant)) WHEN try_variant_get(_v, '$', 'array<variant>') IS NOT NULL THEN try_variant_get(_v, '$', 'array<variant>') WHEN {_truthy(graph)} THEN coalesce({
            _get('_v', '@graph', 'array<variant>')
        }, array(cast(NULL AS variant))) ELSE array(_v) END"
    )
    each = blocks.withColumn("_v", v).select("path", "block", F.posexplode(parts).alias("item", "v"))
    kind = F.expr("""coalesce(nullif(coalesce(try_variant_get(v, '$["@type"][0]', 'string'), try_variant_get(v, '$["@type"]', 'string')), ''), 'Unknown')""")
    return each.withColumn("type", F.when(F.expr("v IS NULL OR is_variant_null(v)"), "ParseError").otherwise(kind))


def _issue(when: str | Column, severity: str, message: str | Column) -> Column:
    when = F.expr(when) if isinstance(when, str) else when
    message = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(severity).alias("severity"), message.alias("message")))


def issues(found: DataFrame, *, sitemap: bool = False) -> DataFrame:
    """(path, type, severity, message), one row for each issue of each schema, and for types that a file repeats.

    `sitemap` words repeated types as the check of a sitemap's pages does.
    """
    kind = F.col("type")
    no = lambda f: f"NOT {_truthy(_get('v', f))}"
    # Messages and bounds (fixed values).
    rules = [_issue(F.expr(no("@context")), "warn", F.concat(F.lit("Missing @context on "), kind, F.lit(" schema")))]
    for t, fields in REQUIRED.items():
        rules += [_issue((kind == t) & F.expr(no(f)), "error", f"{t} missing required field: {f}") for f in fields]
    article = kind.isin("Article", "NewsArticle")
    author = _get("v", "author")
    weak = F.expr(f"{_truthy(author)} AND NOT {_truthy(_get(author, 'sameAs'))} AND NOT {_truthy(_get(author, 'url'))}")
    headline = F.expr(_get("v", "headline", "string"))
    rules += [
        _issue(article & weak, "warn", F.concat(kind, F.lit(" author missing sameAs/url (weakens E-E-A-T entity)"))),
        _issue(
            article & (F.length(headline) > 110), "warn",
            F.concat(kind, F.lit(" headline too long ("), F.length(headline).cast("string"), F.lit(" chars, Google truncates at ~110)"))
        ),
        _issue((kind == "Dataset") & F.expr(no("temporalCoverage")), "warn", "Dataset missing temporalCoverage (helps Google Dataset Search)"),
        _issue((kind == "Dataset") & F.expr(no("variableMeasured")), "warn", "Dataset missing variableMeasured"),
    ]
    questions = F.expr(
        f"CASE WHEN type = 'FAQPage' AND {_truthy(_get('v', 'mainEntity'))} THEN coalesce({
            _get('v', 'mainEntity', 'array<variant>')
        }, array({_get('v', 'mainEntity')})) ELSE array() END"
    )
    x = found.withColumn("_q", questions)
    rules.append(
        _issue(
            F.size("_q") > 5, "warn",
            F.concat(F.lit("FAQPage has "), F.size("_q").cast("string"), F.lit(" questions (max 5 — extras get ignored by Google's parser)"))
        )
    )
    answer = """coalesce(try_variant_get(q, '$.acceptedAnswer.text', 'string'), '')"""
    n = f"size(filter(split({answer}, '\\\\s+'), w -> w <> ''))"
    none = "cast(NULL AS struct<severity: string, message: string>)"
    faq = F.expr(f"""flatten(transform(_q, q -> array(
        CASE WHEN NOT {_truthy(_get('q', 'name'))} THEN named_struct('severity', 'error', 'message', 'FAQ question missing name field') ELSE {none} END,
        CASE WHEN {n} < 30 THEN named_struct('severity', 'warn', 'message', concat('FAQ answer too short (', {n}, ' words, min 30)')) WHEN {n} > 120 THEN named_struct('severity', 'warn', 'message', concat('FAQ answer too long (', {n}, ' words, max 120)')) ELSE {none} END)))""")
    parse = F.array(F.struct(F.lit("error").alias("severity"), F.lit("Invalid JSON in schema block").alias("message")))
    every = F.when(kind == "ParseError", parse).otherwise(F.array_compact(F.concat(F.array(*rules), faq)))
    own = x.select("path", "type", F.explode(every).alias("i")).select("path", "type", "i.severity", "i.message")
    often = found.where("type <> 'ParseError'").groupBy("path", "type").agg(F.count("*").alias("n")).where("n > 1")
    why = " — triggers rich result suppression" if sitemap else " — duplicate FAQPage triggers Google penalty suppressing ALL rich results"
    extra = F.when(kind == "FAQPage", why).otherwise("")
    twice = often.select(
        "path", "type", F.when(kind == "FAQPage", "error").otherwise("warn").alias("severity"),
        F.concat(F.lit("Duplicate "), kind, F.lit(" schema (found "), F.col("n").cast("string"), F.lit(")"), extra).alias("message")
    )
    return own.unionByName(twice)


def summary(content: DataFrame) -> DataFrame:
    """One row. A cross product of three one-row aggregates."""
    found = items(content)
    i = issues(found).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warn").alias("warnings"))
    types = found.where("type <> 'ParseError'").agg(F.array_sort(F.collect_set("type")).alias("t"))
    missing = F.array_except(F.array(*map(F.lit, SITE_TYPES)), "t")
    scanned = content.agg(F.count("*").alias("total_scanned"))
    have = found.agg(F.countDistinct("path").alias("with_schemas"))
    return reduce(lambda a, b: a.crossJoin(b), (scanned, have, i, types)).select(
        "total_scanned", "with_schemas", "errors", "warnings", F.array_join("t", ",").alias("schema_types"),
        F.array_join(missing, ",").alias("missing_types")
    )
