"""Fetching with a stand-in for the network, settings, and the package sink."""

import email.message
import io
import sys

import pytest
from pyspark import cloudpickle

from pageloom.sources import fetch, requests

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import test modules


class Answer(io.BytesIO):
    def __init__(self, url, body, kind, length=None):
        super().__init__(body)
        self.url, self.headers = url, email.message.Message()
        self.headers["Content-Type"] = kind
        if length:
            self.headers["Content-Length"] = str(length)

    def geturl(self):
        return self.url


class Opener:
    pages = {
        "http://a.com/": ("http://a.com/", "<p>ä".encode(), "text/html", None),
        "http://b.com/": ("http://b.com/", b"<meta charset=latin-1>\xe4", "text/html; charset=x", None),
        "http://c.com/": ("http://10.0.0.1/", b"", "text/html", None),
        "http://d.com/": ("http://d.com/", b"%PDF", "application/pdf", None),
        "http://e.com/": ("http://e.com/", b"x", "text/html", 10**9),
    }

    def open(self, request, timeout):
        return Answer(*self.pages[request.full_url])


def resolve(host, port):
    if host == "gone.com":
        raise OSError
    return {"127.0.0.1"} if host == "inner.com" else {"93.184.216.34"}


def test_fetch(spark):
    urls = [*Opener.pages, "http://gone.com/", "http://inner.com/", "http://localhost/", None]
    got = {r["url"]: r for r in fetch.fetch_pages(spark.createDataFrame([(u,) for u in urls], "url string"), resolve=resolve, make_opener=Opener).collect()}
    assert got["http://a.com/"]["html"] == "<p>ä" and got["http://b.com/"]["html"].endswith("ä")
    said = {u: r["error"] for u, r in got.items() if r["error"]}
    assert set(said) == {*urls} - {"http://a.com/", "http://b.com/"}
    assert "text/html" in said["http://d.com/"] and "MB limit" in said["http://e.com/"] and "resolve only" in said["http://inner.com/"]


def test_undeclared_bytes():
    assert fetch.decoded(b"\xff\xfe\x00a") and fetch.decoded(b"\xe9t\xe9") == "été" and fetch.decoded(b"\xef\xbb\xbfa") == "a"


def test_settings():
    text = "# c\nA=1\n B = 'x y' \nbad-key=2\nC\nD=\"q\n"
    assert requests.settings(text, {"A": "9"}) == {"A": "9", "B": "x y", "D": '"q'}


def test_package_sink(spark, tmp_path):
    spark.dataSource.register(requests.PackageFiles)
    rows = spark.createDataFrame([("a.epub", bytearray(b"1")), ("b.epub", bytearray(b"2"))], "file_name string, epub binary")
    rows.write.format("packages").option("path", str(tmp_path / "out")).mode("append").save()
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.epub", "b.epub"]
    with pytest.raises(Exception, match="already exists"):
        rows.limit(1).write.format("packages").option("path", str(tmp_path / "out")).mode("append").save()
    rows.write.format("packages").option("path", str(tmp_path / "out")).mode("overwrite").save()
    assert len([*(tmp_path / "out").iterdir()]) == 2
