"""Readers, report documents and the stream, on files of a temporary folder."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestar.operators import network, reports
from lodestar.sources import readers
from lodestar.streaming import daily


def test_files(spark, tmp_path):
    (tmp_path / "a" / "about").mkdir(parents=True)
    (tmp_path / ".x").mkdir()
    (tmp_path / "a" / "post-1.md").write_text("one\ntwo")
    (tmp_path / "a" / "about" / "page.tsx").write_text("x")
    (tmp_path / ".x" / "hidden.md").write_text("h")
    got = {r.slug: (r.ext, r.raw) for r in readers.files(spark, str(tmp_path), extensions=(".md", ".tsx"), skip_dot_folders=True).collect()}
    assert got == {"post-1": (".md", "one\ntwo"), "about": (".tsx", "x")}


def test_files_below_a_dot_folder(spark, tmp_path):
    root = tmp_path / ".site" / "a+b c"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "node_modules").mkdir()
    for name in ("top.md", "sub/in.md", ".hidden/x.md", "node_modules/y.md"):
        (root / name).write_text("t")
    got = readers.files(spark, str(root), extensions=(".md",), skip_dot_folders=True).where("mtime > timestamp '2000-01-01'")
    assert sorted(r.slug for r in got.collect()) == ["in", "top"]


@pytest.fixture
def site():
    """A local server: /ok, /moved to /ok, /gone, /slow; what was posted is kept."""
    posted = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow":
                time.sleep(1.5)
            code = {"/moved": 301, "/gone": 404}.get(self.path, 200)
            self.send_response(code)
            if code == 301:
                self.send_header("Location", "/ok")
            self.end_headers()
            if self.command == "GET":
                self.wfile.write(b"<p>text</p>")

        do_HEAD = do_GET

        def do_POST(self):
            posted.append((self.path, self.rfile.read(int(self.headers["Content-Length"])).decode(), self.headers["Content-Type"]))
            self.send_response(204 if self.path == "/hub" else 200)
            self.end_headers()

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", posted
    server.shutdown()


def test_requests(site):
    base, posted = site
    assert {k: v for k, v in network.get_manual(f"{base}/moved").items() if k in ("status", "location", "redirected")} == {"status": 301, "location": "/ok", "redirected": False}
    r = network.head(f"{base}/moved")
    assert (r["status"], r["redirected"], r["final_url"], "html" in r) == (200, True, f"{base}/ok", False)
    assert network.page(f"{base}/ok")["html"] == "<p>text</p>" and network.head(f"{base}/gone")["status"] == 404
    assert network.request(f"{base}/slow", timeout=0.3) == {"status": None, "error": "TIMEOUT"}
    assert network.head("http://127.0.0.1:9/")["status"] is None and network.head("nonsense")["error"]
    assert network.hub_post(f"{base}/hub")("http://f/feed") == {"status": "OK", "error": None}
    assert network.index_post(f"{base}/index", "t")("http://p", "URL_UPDATED")["status"] == "OK"
    assert posted == [("/hub", "hub.mode=publish&hub.url=http%3A%2F%2Ff%2Ffeed", "application/x-www-form-urlencoded"), ("/index", '{"url": "http://p", "type": "URL_UPDATED"}', "application/json")]


def test_fetch(spark, site):
    base, _ = site
    urls = spark.createDataFrame([(f"{base}/{x}",) for x in ("ok", "moved", "gone")] + [("http://127.0.0.1:9/",)], "url string").coalesce(1)
    began = time.time()
    got = {r.url.rsplit("/", 1)[1]: (r.status, r.html) for r in network.fetch(urls, network.page, concurrency=2, pause=0.5).collect()}
    assert got == {"ok": (200, "<p>text</p>"), "moved": (200, "<p>text</p>"), "gone": (404, "<p>text</p>"), "": (None, None)} and time.time() - began >= 0.5
    assert network.fetch(urls, network.page, drop_failures=True).count() == 3


def test_lists_sitemaps_and_baselines(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a\n# b\n\n c \n")
    assert [r.item for r in readers.list_file(spark, str(tmp_path / "list.txt")).collect()] == ["a", "c"]
    assert [r.item for r in readers.comma_list(spark, "a, b,,c").collect()] == ["a", "b", "c"]
    (tmp_path / "s.xml").write_text("<loc>u</loc>\n<loc>v</loc>")
    assert [r.url for r in readers.sitemap(spark, str(tmp_path / "s.xml")).collect()] == ["u", "v"]
    (tmp_path / "b.json").write_text(json.dumps({"created": "x", "site": "s", "window": {"days": 28}, "pages": [{"page": "p", "clicks": 1, "impressions": 2, "ctr": 50.0, "position": 3.5}]}, indent=1))
    assert readers.baseline(spark, str(tmp_path / "b.json")).first().ctr_pct == 50.0


def test_document(spark):
    df = spark.createDataFrame([("a", float("inf"), 2.0)], "k string, g double, n double")
    assert json.loads(reports.document({"rows": df}, site="s")) == {"site": "s", "rows": [{"k": "a", "g": None, "n": 2}]}
    with pytest.raises(ValueError, match="more than"):
        reports.document({"rows": spark.range(3)}, most=2)
    assert reports.console(df).splitlines()[0].split() == ["k", "g", "n"]


def test_stream(spark, tmp_path):
    rows = [("2024-01-05 00:00:00", "p", "q", 1, 10, 50), ("2024-01-05 00:00:00", "p", "q", 1, 10, 50), ("2024-01-06 00:00:00", "p", "q", 2, 30, 30)]
    df = spark.createDataFrame(rows, "ts string, page string, query string, clicks long, impressions long, position_x10 long").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = daily.weekly_windows(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("weeks").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and spark.table("weeks").columns == ["start", "page", "clicks", "impressions", "position"]
