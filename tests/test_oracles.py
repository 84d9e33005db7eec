"""Every registered query against its SQL on another engine."""

import duckdb
import pytest

from registry.oracles import ORACLES
from registry.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER",
         "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    connection.execute("SET TimeZone='UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, folder, duck, name):
    result = QUERIES[name](spark, folder)
    columns = sorted(result.columns)
    ours = [tuple(row[c] for c in columns) for row in result.collect()]
    answer = duck.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in answer.description}
    assert sorted(kinds) == columns
    assert {c: TYPES[result.schema[c].dataType.simpleString()] for c in columns} == kinds
    place = [[d[0] for d in answer.description].index(c) for c in columns]
    theirs = [tuple(row[i] for i in place) for row in answer.fetchall()]
    assert ours, "an empty result proves nothing"

    def order(row):
        return [(v is None, str(v)) for v in row]

    assert sorted(ours, key=order) == sorted(theirs, key=order)
