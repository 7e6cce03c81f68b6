"""The SQL of the operators' queries gives what the queries give."""

from pathlib import Path

import duckdb
import pytest

from corvane.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    return int(value) if isinstance(value, float) and value.is_integer() else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_and_query_agree(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    found = con.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    wanted = sorted(repr(tuple(plain(row[names.index(c)]) for c in sorted(names))) for row in found.fetchall())
    made = QUERIES[name](spark, str(DATA))
    assert sorted(made.columns) == sorted(names)
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in made.collect()) == wanted
