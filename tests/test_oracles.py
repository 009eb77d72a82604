"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    said = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(said(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", [n for n in OWN if n in entry.oracle_sql()])
def test_same_rows(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", [n for n in OWN if n not in entry.oracle_sql()])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 50


@pytest.fixture(scope="module")
def odd_pages(spark, tmp_path_factory):
    """Pages that end, or whose titles end, in the middle of something."""
    body = "This paragraph is the real body and it has more than enough words to count as one hundred characters of kept text."
    page = lambda h1, inner: f"<html><body><nav><a href='/x'>x</a></nav><article><h1>{h1}</h1>{inner}</article><footer>f</footer></body></html>"
    inner = [
        ("Of the&&& and&&&amp", f"<p>{body}</p>"),
        ("Said &quot", f"<p><b>{body} &quot;so&quot; &amp;amp; on&amp<br><p>Second.</p>"),
        ("A &am", f"<p>{body} &#38</p>"),
        ("Short", f"<p>{'x' * 96}&amp</p>"),  # 97 characters, or 100 as it stands
        ("Closed &amp; &quot;done&quot;", f"<p>{body}</p><p>{body}</p>"),
        ("Closed &amp; &quot;done&quot;", f"<p><b>{body}<br><p>Les.</p><p>Est.</p><p><b>Les.<br>"),
        ("Closed &amp; &quot;done&quot;", f"<p><b>{body}<br><p>Les.</p><p>Les.</p><p><b>Est.<br>"),
    ]
    folder = str(tmp_path_factory.mktemp("odd"))
    rows_ = [(i, f"http://h.com/{i // 2}", page(*given)) for i, given in enumerate(inner)]
    spark.createDataFrame(rows_, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["articles", "content_scores_A1", "few_workers_R4", "file_names_K2", "packages_K1", "repeated_blocks_T4", "source_order_text_T9", "short_articles_P5", "batch_report_A9"])
def test_same_rows_of_odd_pages(spark, odd_pages, name):
    folder, con = odd_pages
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.fixture(scope="module")
def any_ids(spark, tmp_path_factory):
    """Pages whose ids repeat or are missing, and a missing page."""
    body = "This paragraph is the real body and it has more than enough words to count as one hundred characters of kept text."
    page = lambda h1, inner: f"<html><body><article><h1>{h1}</h1><p>{inner}</p></article></body></html>"
    rows_ = [(1, "http://h.com/1", page("Same", body)), (1, "http://h.com/1", page("Same", body)), (1, "http://h.com/1", page("Same", "Short.")), (1, "http://h.com/2", page("Other", body))]
    rows_ += [(None, "http://h.com/3", page("None", body)), (None, "http://h.com/3", page("None", body)), (3, "http://h.com/3", page("None", body)), (4, "http://h.com/4", None)]
    folder = str(tmp_path_factory.mktemp("ids"))
    spark.createDataFrame(rows_, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    return folder, con


@pytest.mark.parametrize("name", ["few_workers_R4", "file_names_K2", "packages_K1"])
def test_same_rows_of_any_ids(spark, any_ids, name):
    folder, con = any_ids
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())
