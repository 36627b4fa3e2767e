"""Text, url and slug expressions, and the rule patterns (fixed values) that operators count."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word's edge, ASCII as in the rules' own dialect.
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"

#: Known template phrases (fixed values).
TEMPLATES = (
    "the (?:short|quick|simple) answer (?:is|here)",
    "(?:the )?longer answer is (?:more )?interesting",
    "let(?:'s| us) (?:dive|dig|break|unpack|explore)",
    "in (?:this|today's) (?:post|article|piece|guide)",
    "if you(?:'ve| have) been (?:following|watching|paying attention)",
    "it's worth (?:noting|mentioning|pointing out)",
    "(?:but )?here's (?:the thing|where it gets interesting|the kicker)",
    "the (?:real|bigger|more interesting) (?:question|story|picture)",
    "(?:but )?what does this (?:mean|look like|imply) (?:for|in practice)",
    "to (?:put|place) (?:this|that|it) in (?:context|perspective)",
    "what to watch(?::| for)",
    "(?:the )?bottom line(?::| is| here)",
    "only time will tell",
    "it remains to be seen",
    "(?:the )?takeaway(?::| is| here)",
    "looking (?:ahead|forward),? (?:the|we|it)",
    "it's (?:important|crucial|critical|essential|vital) to (?:note|remember|understand)",
    "(?:while|although) (?:it's|it is) (?:too early|difficult|hard) to (?:say|tell|know)",
    "there(?:'s| is) no (?:denying|question|doubt)",
    "whether .{10,40} remains (?:to be seen|unclear|an open question)",
    "in an? (?:era|world|landscape|environment) (?:where|of|defined by)",
    "(?:the )?(?:rapidly )?(?:evolving|shifting|changing) landscape",
    "at the (?:intersection|crossroads|confluence) of",
    "(?:represents|marks|signals) a (?:significant|major|important|pivotal|crucial) (?:shift|moment|milestone|turning point)",
)
#: Phrases of the content audit (fixed values).
AUDIT_PHRASES = (
    "the (?:short|quick) answer", "longer answer is (?:more )?interesting", "let's (?:dive|dig|break|unpack)", "it's worth noting",
    "what to watch:", "bottom line:", "only time will tell"
)
#: Facts, T16: entities (fixed values).
FACTS = (
    r"(?i)\$[\d,.]+\s*(?:billion|million|trillion|B|M|T|K)?",
    r"\d+\.?\d*%",
    r"(?i)[\d,.]+x\b",
    r"\b\d{1,3}(?:,\d{3})+\b",
    r"(?i)\b\d+\.?\d*\s+(?:billion|million|trillion|thousand|hundred)\b",
    r"\b(?:Q[1-4]\s+)?20[1-3]\d\b",
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}(?:,?\s+\d{4})?\b",
    r"\b\d+(?::\d+|-to-\d+)\b",
    r"(?i)\bSeries\s+[A-F]\b",
)
ENTITIES = (r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|Corp|Ltd|LLC|Co)\b", r"\b(?:NASDAQ|NYSE|S&P|SEC|IPO|SPAC)\b")


#: What a text in lower case must hold for each pattern of FACTS and ENTITIES to be found in it: one of some parts, or a
#: match of a pattern that starts at a digit and so is soon told. Edges of words are looked for at every place of a text.
FACT_NEEDS = (
    ("$",), ("%",), (), r"\d,\d\d\d", ("billion", "million", "trillion", "thousand", "hundred"), ("20",),
    ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"), r"\d(?::\d|-to-\d)", ("series",),
)
ENTITY_NEEDS = (("inc", "corp", "ltd", "llc", "co"), ("nasdaq", "nyse", "s&p", "sec", "ipo", "spac"))


def needs(pattern: str) -> tuple[str, ...]:
    """Parts of which a text in lower case must hold one for a pattern of TEMPLATES to be found in it: a run of plain letters
    or the choices of a group, whichever is longest at its shortest."""
    best: tuple[str, ...] = ()
    for m in re.finditer(r"\(\?:([^()]*)\)(\?)?|((?:[a-z' :,-](?!\?))+)", pattern):
        choices = tuple(m[1].split("|")) if m[1] and not m[2] else (m[3],) if m[3] else ()
        plain = choices and all(re.fullmatch("[a-z' :,-]+", c) for c in choices)
        if plain and min(map(len, choices)) >= min(map(len, best), default=0):
            best = choices
    return best


def holds(low: Column, parts: tuple[str, ...] | str) -> Column:
    """Whether a text in lower case holds any of the parts, or matches a pattern; true where nothing is asked for."""
    if isinstance(parts, str):
        return low.rlike(parts)
    return reduce(lambda a, b: a | b, (F.contains(low, F.lit(p)) for p in parts)) if parts else F.lit(True)


def edges(pattern: str) -> str:
    """The pattern with ASCII edges of words: Spark's engine takes letters like é for parts of words at \\b, though not in \\w.

    An edge at the start of the pattern, of a group or of an alternative opens a word, any other closes one.
    """
    return re.sub(r"(^|\(\?i\)|[(|:])\\b", lambda m: m[1] + B, pattern).replace("\\b", E)


def count_all(x: Column, patterns: tuple[str, ...], low: Column | None = None, asked: tuple = ()) -> Column:
    """Matches of each pattern, summed. Where `low` (x in lower case) lacks what is asked for, a pattern is not looked for."""
    counts = [F.regexp_count(x, F.lit(edges(p))) for p in patterns]
    if low is not None:
        counts = [F.when(holds(low, a), n).otherwise(F.lit(0)) for n, a in zip(counts, asked, strict=True)]
    return reduce(lambda a, b: a + b, counts)


def finds_any(x: Column, low: Column, patterns: tuple[str, ...], asked: tuple) -> Column:
    """Whether any pattern is found; `low` and `asked` as in count_all."""
    return reduce(lambda a, b: a | b, (holds(low, a) & x.rlike(edges(p)) for p, a in zip(patterns, asked, strict=True)))


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, "^\\s+|\\s+\\z", "")


def replaced(x: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, x)


def audit_text(raw: Column) -> Column:
    """Tags and braces gone; import and export drop the rest of their line wherever they stand."""
    return trim_all(replaced(raw, ("<[^>]+>", " "), ("\\{[^}]*\\}", " "), ("import\\s.+", ""), ("export\\s.+", ""), ("\\s+", " ")))


def file_text(raw: Column, ext: Column, *, fences: bool = False) -> Column:
    """Text by kind of file; HTML stays raw. `fences` also drops fenced code of markdown."""
    jsx = replaced(raw, ("(?m)^import\\s.+$", ""), ("(?m)^export\\s.+$", ""), ("<[^>]+>", " "), ("\\{[^}]*\\}", " "), ('className="[^"]*"', ""), ("\\s+", " "))
    drop = [("(?s)```.*?```", "")] if fences else []
    md = replaced(
        raw, ("(?ms)\\A(.*?)^---.*?---", "$1"), *drop, ("!\\[.*?\\]\\(.*?\\)", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "$1"), ("#{1,6}\\s", ""),
        ("[*_`~]", "")
    )
    return F.when(ext.isin(".tsx", ".jsx"), jsx).when(ext.isin(".md", ".mdx"), md).otherwise(raw)


def words(x: Column, least: int = 1) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda w: F.length(w) >= least)


def paragraphs(x: Column, longer_than: int) -> Column:
    """T11."""
    return F.filter(F.transform(F.split(x, "\n\n+"), trim_all), lambda p: F.length(p) > longer_than)


def sentences(x: Column) -> Column:
    """T10."""
    return F.filter(F.transform(F.split(x, "[.!?]+"), lambda s: F.lower(trim_all(s))), lambda s: F.length(s) > 20)


def url_slug(url: Column) -> Column:
    """The last segment that is not empty."""
    return F.try_element_at(F.filter(F.split(url, "/"), lambda s: s != ""), F.lit(-1))


def file_slug(path: Column) -> Column:
    """T4: a file's base name, or its folder's for page.*."""
    parts = F.split(path, "/")
    base = F.regexp_replace(F.element_at(parts, -1), "\\.[^.]+\\z", "")
    return F.when(base == "page", F.try_element_at(parts, F.lit(-2))).otherwise(base)


def file_basename(path: Column) -> Column:
    """T5: a file's name without its extension, page.* too."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.(mdx|md|tsx|jsx)\\z", "")


def page_url(page: Column, site: str) -> Column:
    """A page's absolute url; `site` may be a domain property."""
    return F.when(F.startswith(page, F.lit("http")), page).otherwise(F.concat(F.lit(f"https://{site.replace('sc-domain:', '')}"), page))


def escape_xml(x: Column) -> Column:
    """T30."""
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")), x)


def url_encode(x: Column) -> Column:
    """Spaces as %20."""
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
