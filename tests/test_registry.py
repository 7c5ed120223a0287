"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from contactgrid.plans.catalog import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
#: Callers need more contacts to find anything: their queries run on larger tables.
LARGER = {"c01_loops", "c02_loops_by_p", "c03_loop_scores", "c04_differential_loops", "c05_domains"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else v if isinstance(v, str) else round(float(v), 4)
    return sorted((tuple(map(plain, r)) for r in frame[columns].itertuples(index=False)), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF if name not in LARGER else SF.replace("0.001", "0.01")).toPandas()
    if name not in ORACLES:
        assert len(found) and list(found.columns)
        return
    told = db.execute(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    assert rows(found, sorted(told.columns)) == rows(told, sorted(told.columns))


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLES
