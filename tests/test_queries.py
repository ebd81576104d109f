"""Every query of the fact engine against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as engine
from factloom.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def text(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = str(frame[c].dtype)
        frame[c] = ["" if str(x) in ("None", "NaN", "nan", "<NA>", "NaT") else f"{float(x):.9g}" if kind.startswith(("int", "Int", "float")) else str(x).removesuffix(" 00:00:00") for x in frame[c]]
    return sorted(map(tuple, frame.to_numpy()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        want = duck.sql(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert text(got) == text(want)
    else:
        assert len(got)


def test_entry(spark):
    assert engine.entry(spark).count() > 0
    assert set(engine.oracle_sql()) <= set(engine.queries())
