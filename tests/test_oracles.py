"""Every registered query of the core against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from strataloom.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    got = QUERIES[name](spark, sf)
    values = got.collect()
    if name not in ORACLES:
        assert values or name == "louvain_clusters"  # on these tables no two suppliers of a nation share a part
        return
    cur = duck.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, values) == rows(names, cur.fetchall())
