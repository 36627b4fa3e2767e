"""Analysis of crawl snapshots, and the fetchers and sinks that make or follow them (opt-in; never part of a query)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import to_long
from ..functions.text import url_encode

URL_STATUS = "url string, status int, location string, redirected boolean, final_url string, error string"
#: Index submissions a day.
QUOTA = 200


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """Every <loc> of (sitemap_url, xml)."""
    return sitemaps.select("sitemap_url", F.explode(F.regexp_extract_all("xml", F.lit("<loc>(.*?)</loc>"), F.lit(1))).alias("url"))


def dir_urls(content: DataFrame, base_url: str, root: str = "/content") -> DataFrame:
    """Urls of files: path under root without extension and without a last /index."""
    rel = F.regexp_replace(F.regexp_replace("path", f"^{root}/?", ""), "\\.(mdx|md|tsx|jsx)\\z", "")
    return content.where(F.col("path").rlike("\\.(mdx|md|tsx|jsx)\\z")).select(
        F.concat(F.lit(base_url.rstrip("/") + "/"), F.regexp_replace(rel, "/index\\z", "")).alias("url")
    )


def list_items(lines: DataFrame) -> DataFrame:
    """One item a line (column value), trimmed, without empty lines and # comments."""
    item = F.regexp_replace("value", "^\\s+|\\s+\\z", "")
    return lines.select(item.alias("item")).where((F.col("item") != "") & ~F.startswith("item", F.lit("#")))


def redirect_report(urls: DataFrame, status: DataFrame) -> DataFrame:
    """Each url's class: ok, redirect (300-399), not_found (404), error (no status), other."""
    s = F.col("status")
    kind = F.when(s.between(300, 399), "redirect").when(s == 404, "not_found").when(
        F.coalesce(s, F.lit(0)) == 0, "error"
    ).when(s == 200, "ok").otherwise("other")
    return urls.join(status, "url", "left").select("url", "status", kind.alias("class"), F.when(kind == "redirect", F.col("location")).alias("target"))


def status_histogram(report: DataFrame) -> DataFrame:
    """A15."""
    return report.groupBy("class").agg(F.count("*").alias("urls"))


def broken_links(links: DataFrame, status: DataFrame, *, base_url: str, only: str | None = None) -> DataFrame:
    """Links (url, files) made absolute and joined to their status; `only` the internal or external ones."""
    if not base_url:
        raise ValueError("base_url is needed to tell internal links")
    full = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(F.concat(F.lit(base_url), F.col("url")))
    x = links.withColumn("full_url", full).withColumn("internal", F.startswith(F.col("full_url"), F.lit(base_url)))
    if only is not None:
        x = x.where(F.col("internal") if only == "internal" else ~F.col("internal"))
    s = status.select(F.col("url").alias("full_url"), "status", "redirected", "final_url", "error")
    kind = F.when(F.coalesce("status", F.lit(0)).between(200, 399), F.when(F.col("redirected"), "redirected").otherwise("ok")).otherwise("broken")
    return x.join(s, "full_url", "left").select("url", "full_url", "internal", "status", "final_url", "error", "files", kind.alias("class"))


def citations(queries: DataFrame, answers: DataFrame, domain: str) -> DataFrame:
    """Whether the answer page of each query names and links the domain; a failed fetch is neither."""
    html = F.coalesce("html", F.lit(""))
    cited = F.contains(html, F.lit(domain))
    return queries.join(answers, "query", "left").select("query", cited.alias("cited"), (cited & F.contains(html, F.lit("href"))).alias("linked"))


def citation_rate(found: DataFrame) -> DataFrame:
    """NULL without queries."""
    rate = to_long(F.col("cited").cast("double") / F.nullif(F.col("queries_tested"), F.lit(0)) * 100.0)
    return found.agg(
        F.count("*").alias("queries_tested"), F.count_if("cited").alias("cited"), F.count_if("linked").alias("linked")
    ).withColumn("citation_rate", rate)


def submission_batch(urls: DataFrame, *, quota: int = QUOTA) -> DataFrame:
    """The first `quota` urls of (ord, url)."""
    return urls.orderBy("ord").limit(quota).select("ord", "url", F.lit("URL_UPDATED").alias("type"))


def redirect_chains(status: DataFrame, *, most_hops: int = 10) -> DataFrame:
    """L3: where each redirecting url ends, and after how many hops; a loop ends at most_hops. One join a hop, of redirects only."""
    hop = status.where("status BETWEEN 300 AND 399 AND location IS NOT NULL").groupBy("url").agg(F.min("location").alias("location"))
    now = hop.select("url", F.col("location").alias("at"), F.lit(1).alias("hops"))
    step = hop.select(F.col("url").alias("at"), F.col("location").alias("to"))
    for _ in range(most_hops - 1):
        now = now.join(step, "at", "left").select(
            "url", F.coalesce("to", "at").alias("at"), (F.col("hops") + F.col("to").isNotNull().cast("int")).alias("hops")
        )
    return now.select("url", F.col("at").alias("final_url"), "hops")


def answer_requests(queries: DataFrame, base: str) -> DataFrame:
    """(query, url) of the page to fetch for each query."""
    return queries.select("query", F.concat(F.lit(base), url_encode(F.col("query"))).alias("url"))


#: What link checks and page fetches call themselves, and how long they wait, in seconds.
AGENT = {"User-Agent": "Mozilla/5.0 (compatible; lodestar)"}
TIMEOUT = 15.0


def request(
    url: str, *, method: str = "GET", follow: bool = True, timeout: float | None = TIMEOUT, body: bytes | None = None,
    headers: dict[str, str] | None = None
) -> dict:
    """One request as a row of URL_STATUS, with html for GET. Redirects are followed or reported; a request that takes
    too long has the error TIMEOUT, another that fails its message, and both no status."""
    import socket
    import urllib.error
    import urllib.request

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *a):
            return None

    opener = urllib.request.build_opener(*[] if follow else [Stay])
    try:
        r = opener.open(urllib.request.Request(url, data=body, method=method, headers=AGENT | (headers or {})), timeout=timeout)
    except urllib.error.HTTPError as e:
        r = e
    except (TimeoutError, socket.timeout):
        return {"status": None, "error": "TIMEOUT"}
    except (OSError, ValueError) as e:
        late = isinstance(getattr(e, "reason", None), TimeoutError)
        return {"status": None, "error": "TIMEOUT" if late else str(e)}
    with r:
        final = r.geturl()
        out = {"status": r.status, "location": r.headers.get("Location"), "redirected": final != url, "final_url": final, "error": None}
        if method == "GET":
            out["html"] = r.read().decode("utf-8", "replace")
        return out


def get_manual(url: str) -> dict:
    """GET without following redirects."""
    return request(url, follow=False, timeout=None)


def head(url: str) -> dict:
    """HEAD, redirects followed."""
    return request(url, method="HEAD")


def page(url: str) -> dict:
    """GET of a page's text."""
    return request(url)


def index_post(endpoint: str, token: str = "") -> Callable[[str, str], dict]:
    """K3: posts {url, type} to an index; its answer's status as text, or SUBMITTED."""
    import json

    def post(url: str, kind: str) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        r = request(endpoint, method="POST", body=json.dumps({"url": url, "type": kind}).encode(), headers=headers)
        ok = r.get("status") is not None and 200 <= r["status"] < 300
        return {"status": "OK" if ok else "FAIL", "error": None if ok else r.get("error") or f"HTTP {r.get('status')}"}

    return post


def hub_post(endpoint: str, *, timeout: float = 10.0) -> Callable[[str, str], dict]:
    """K4: posts hub.mode=publish and hub.url to a feed hub; any 2xx is well."""
    from urllib.parse import urlencode

    def post(url: str, kind: str = "publish") -> dict:
        body = urlencode({"hub.mode": "publish", "hub.url": url}).encode()
        r = request(endpoint, method="POST", timeout=timeout, body=body, headers={"Content-Type": "application/x-www-form-urlencoded"})
        ok = r.get("status") is not None and 200 <= r["status"] < 300
        return {"status": "OK" if ok else "FAIL", "error": None if ok else r.get("error") or f"HTTP {r.get('status')}"}

    return post


def fetch(urls: DataFrame, get: Callable[[str], dict], *, concurrency: int = 10, pause: float = 0.0, drop_failures: bool = False) -> DataFrame:
    """url_status rows with html of `get`, `concurrency` at a time in each task and `pause` seconds between such batches.

    `drop_failures` leaves out what has no status, as the fetch of pages for their schemas does. Nothing is fetched until
    the result is read; a task that is run again fetches again.
    """
    columns = ("status", "location", "redirected", "final_url", "error", "html")

    def run(batches: Iterator):
        import time
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for b in batches:
                got = []
                for i in range(0, len(b), concurrency):
                    if i and pause:
                        time.sleep(pause)
                    got += pool.map(get, b.url[i : i + concurrency])
                yield b.assign(**{c: [g.get(c) for g in got] for c in columns}).astype({"status": "Int32"})

    out = urls.select("url").mapInPandas(run, URL_STATUS + ", html string")
    return out.where("status is not null") if drop_failures else out


def submit(batch: DataFrame, post: Callable[[str, str], dict], *, dry_run: bool = True) -> DataFrame:
    """One post for each row of (url, type); nothing is sent unless dry_run is off."""

    def run(batches: Iterator):
        for b in batches:
            got = [{"status": "DRY_RUN"} if dry_run else post(u, t) for u, t in zip(b.url, b.type, strict=True)]
            yield b[["url", "type"]].assign(status=[g.get("status") for g in got], error=[g.get("error") for g in got])

    return batch.select("url", "type").mapInPandas(run, "url string, type string, status string, error string")
