"""Queries with SQL give DuckDB's rows; all queries run; the rest of the library imports nothing from here."""

import ast
import os
from pathlib import Path

import duckdb
import pytest

from pageloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    said = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v)
    return sorted(tuple(said(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    got, want = queries()[name](spark, SF), con.execute(oracle_sql()[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


@pytest.mark.parametrize("name", [n for n in queries() if n not in oracle_sql()])
def test_one_row_each(spark, name):
    source = "pages" if name.startswith("op1_") else "documents"
    assert queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_nothing_else_imports_this():
    for path in (ROOT / "pageloom").rglob("*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n for n in names), path


NATIVE = {"op1_": "url_filter", "op4_": "mixing", "op6_": "imatch"}


@pytest.mark.parametrize("start", list(NATIVE))
def test_native_plans_have_no_python(spark, start):
    name = next(n for n in queries() if n.startswith(start))
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "ExistingRDD"))
