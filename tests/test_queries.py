"""Every query of the engine against its SQL in DuckDB, or, where there is none, against its own schema."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from evidentia.plans import registry as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, FOLDER)
    rows = found.collect()
    if name not in core.ORACLE:
        assert found.columns
        return
    wanted = duck.execute(core.ORACLE[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == sorted(found.columns)
    order = sorted(names)
    assert sorted(repr([r[c] for c in order]) for r in rows) == sorted(repr([dict(zip(names, r, strict=True))[c] for c in order]) for r in wanted.fetchall())
