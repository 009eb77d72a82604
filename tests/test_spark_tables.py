"""Sources, naming and state on DataFrames."""

import json
import time

from pyspark.sql import functions as F

from pageloom.functions import settings, text, urls
from pageloom.operators import dom, relational
from pageloom.plans.standard import extract_articles
from pageloom.sources import epub, inputs
from pageloom.streaming import jobs


def test_saved_files(spark, tmp_path):
    (tmp_path / "a.html").write_bytes(b"\xef\xbb\xbf<p>x")
    (tmp_path / "b.html").write_bytes(b"\xff\xfe")
    got = {r["path"][-6:]: (r["html"], r["error"]) for r in inputs.read_saved(spark, str(tmp_path)).collect()}
    assert got["a.html"] == ("<p>x", None) and got["b.html"][1] == "Saved input must be UTF-8."


def test_public_addresses(spark):
    cases = {"http://8.8.8.8/": True, "http://10.0.0.1/": False, "http://[::1]/": False, "http://bücher.de/": True, "https://a.com:99999/": False, "http://a.home.arpa/": False, "": False}
    rows = spark.createDataFrame([(u,) for u in cases] + [(None,)], "url string")
    got = {r[0]: r[1] for r in rows.select("url", urls.allowed_url("url")).collect()}
    assert got == cases | {None: False}


def test_long_and_late_list_entries_are_errors(spark):
    rows = [(n, f"http://h.com/{n}") for n in range(1002)] + [(2000, "x" * 9000)]
    got = inputs.url_list(spark.createDataFrame(rows, "line_no long, line string"))
    assert got.filter("error is not null").count() == 3


def test_empty_and_null_pages(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "http://h.com", ""), (None, "u", "<title>t</title>")], "page_id long, url string, html string")
    assert [r["error"] is not None for r in extract_articles(rows).collect()] == [True] * 3
    assert dom.nodes(rows.limit(0)).count() == 0


def test_colliding_names(spark):
    rows = spark.createDataFrame([(1, "T", "u", None), (2, "T", "u", None), (3, None, "u", "bad")], "page_id long, title string, source_url string, error string")
    names = [r["file_name"] for r in epub.file_names(rows).orderBy("page_id").collect()]
    assert names[1] == names[0].replace(".epub", "-2.epub") and len(names) == 2


def test_results_are_json(spark):
    page = f"<title>T</title><article><p>{'word ' * 40}</p></article>"
    found = extract_articles(spark.createDataFrame([(1, "http://h.com/", page)], "page_id long, url string, html string"))
    row = json.loads(epub.results(found, epub.file_names(found)).first()["json"])
    assert row["title"] == "T" and row["status"] == "ok" and row["publishedDate"] is None and row["output"].startswith("t-")


def test_common_ancestor_and_snapshots(spark):
    html = "<body><div><section><p>a</p></section><p>b</p><script>x</script><img src='i' onload='e'></div></body>"
    nodes = dom.nodes(spark.createDataFrame([(1, html)], "page_id long, html string"))
    root = relational.common_ancestor(nodes, nodes.filter("tag = 'p'")).first()["root"]
    assert nodes.filter(F.col("pre") == root).first()["tag"] == "div"
    left = relational.scrubbed(nodes)
    assert left.filter("tag = 'script' or text = 'x'").count() == 0
    assert left.filter("tag = 'img'").first()["attrs"] == {"data-source": "i"}


def test_nearby_skips_decided_blocks(spark):
    rows = spark.createDataFrame([(1, 1, "p", "a", False), (1, 2, "p", "b", True), (1, 3, "h2", "c", False)], "k long, i long, tag string, text string, fixed boolean")
    got = [r["nearby"] for r in relational.nearby(rows, "k", "i", "tag", "text", "fixed").orderBy("i").collect()]
    assert got == ["", "p: a h2: c", ""]


def test_names_and_excerpts(spark):
    row = spark.range(1).select(text.slug(F.lit("  Ünïcode -- Title! ")), text.slug(F.lit("!!")), text.download_name(F.lit("A b!")), text.excerpt(F.lit("x" * 200))).first()
    assert row[0] == "n-code-title" and row[1] == "article" and row[2] == "a-b.epub" and len(row[3]) == 178


def stop_after(run, done, seconds=90):
    """State with a timeout keeps a query running without data, so it is stopped once it has what it needs."""
    until = time.monotonic() + seconds
    while not done() and time.monotonic() < until and run.exception() is None:
        time.sleep(0.2)
    assert done(), run.exception()
    run.stop()


def test_job_stream(spark, tmp_path):
    events = [("a", "submit", 1.0, None, None, None, "html"), ("a", "start", 2.0, None, None, None, None), ("a", "finish", 3.0, None, None, "done", None), ("a", "progress", 4.0, 1, 2, "late", None), ("b", "submit", 1.0, None, None, None, "html")]
    schema = "job_id string, event string, at double, current long, total long, message string, payload string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    run = jobs.job_snapshots(stream).writeStream.outputMode("update").format("memory").queryName("snaps").option("checkpointLocation", str(tmp_path / "cp")).start()
    stop_after(run, lambda: spark.table("snaps").count() >= 2)
    got = {r["job_id"]: (r["status"], r["result"]) for r in spark.table("snaps").collect()}
    assert got == {"a": ("completed", "done"), "b": ("queued", None)}


def test_retention(spark):
    rows = [(n, float(n), n, n % 2 == 0) for n in range(60)]
    log = spark.createDataFrame(rows, "job_id long, finished_at double, inserted long, terminal boolean")
    got = {r["job_id"] for r in jobs.retained(log, F.lit(60.0)).collect()}
    assert got == {n for n in range(60) if n % 2} | {58}  # thirty wait, so one that ended stays
    assert {r["job_id"] for r in jobs.retained(log, F.lit(3630.5), capacity=100).collect()} == {n for n in range(60) if n % 2 or n > 30}


def test_read_once_stream(spark, tmp_path):
    schema = "key string, kind string, value string, read_id long, at double"
    batches = [[("a", "put", "x", None, 1.0), ("b", "read", None, 1, 1.0), ("c", "put", "old", None, 0.0)], [("a", "read", None, 2, 2.0), ("c", "read", None, 3, 4000.0)], [("a", "read", None, 4, 3.0), ("c", "put", "new", None, 4001.0), ("c", "read", None, 5, 4002.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run = jobs.read_once_stream(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
        stop_after(run, lambda n=n: any(p["batchId"] >= n and p["numInputRows"] for p in run.recentProgress))
    got = {r["read_id"]: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: "x", 3: None, 4: None, 5: "new"}


def test_links_without_python_are_those_of_the_rules(spark):
    links = ["/a", "/a/../b", "//h.com/x", "http://h.com/x", "HTTP://h.com", "x", "", None, "?q", "#f", "/a b", "/é", "mailto:x", "http://[::1]/x", "/.", "/a.html", "/a/./b", "https://h.com", "http://h.com:80/x?y#z", "/\\x"]
    rows = spark.createDataFrame([(x, b) for x in links for b in ("http://g.org/p/q?r", "https://g.org:8/", "", None)], "link string, base string")
    got = rows.select(urls.absolute_url("link", "base").alias("a"), urls.joined_url("link", "base").alias("b"), "link", "base").collect()
    assert [(r.link, r.base, r.a) for r in got] == [(r.link, r.base, r.b) for r in got]


def test_settings_of_odd_forms(spark):
    rows = [("h", "587", "a@x.org", "b@x.org", None), ("h h", "587", "a@x.org", "b@x.org", "host"), (None, "587", "a@x.org", "b@x.org", "host"), ("h", None, "a@x.org", "b@x.org", "whole"), ("h", "9" * 30, "a@x.org", "b@x.org", "between"), ("h", "0", None, None, "between"), ("h", "+25", "a@x.org", None, "recipient")]
    got = spark.createDataFrame(rows, "h string, p string, s string, r string, said string").select(settings.mail_error("h", "p", "s", "r").alias("error"), "said").collect()
    assert [(r.error is None) == (r.said is None) and (r.said or "") in (r.error or "") for r in got] == [True] * len(rows)


def test_edges_match_whole_values(spark):
    rows = [("k" * 32, "me@h", "http://localhost:1/v"), ("k" * 32 + "\n", "me@h\n", "http://localhost:1@h.com/"), ("k" * 31 + "é", "me@h@i", "http://localhost:65536"), (None, None, None), ("~" * 40, " ", "http://u:p@127.0.0.1:80?x")]
    got = spark.createDataFrame(rows, "t string, g string, e string").select(settings.valid_token("t"), settings.valid_target("g"), settings.loopback_endpoint("e")).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, True, False), (False, False, False), (False, True, False), (True, True, True)]
