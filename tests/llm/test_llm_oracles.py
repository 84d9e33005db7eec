"""Queries of the package that SQL can express, on another engine; and how the package is tied in."""

import ast
import pathlib

import duckdb
import pytest

from sentinel.llm.oracles import ORACLES
from sentinel.llm.queries import QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    answer = connection.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = [tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()]
    assert sorted(tuple(r[c] for c in columns) for r in result.collect()) == sorted(theirs)


def test_every_number_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_nothing_else_imports_the_package():
    for path in [*ROOT.glob("sentinel/**/*.py"), *ROOT.glob("registry/*.py"), ROOT / "bench.py"]:
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n for n in names), path


@pytest.mark.parametrize("name", ["op3_url_filters", "op6_source_mix", "op7_sharding", "op13_document_fingerprints"])
def test_native_queries_run_no_python(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
