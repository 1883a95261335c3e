"""Each registered query of the engine against DuckDB on the small tables."""

import math
import os

import duckdb
import pytest

from siderea.plans import contracts, more, reports, rules, run, verify  # noqa: F401  (they register their queries)
from siderea.plans import queries as Q


#: Without SQL; tests/test_plain.py holds them, or the solver they call, against plain versions.
PLAIN = {"star_nms", "greedy_tiles", "phase_correlation", "lanczos_clamped_warp", "star_registration", "subpixel_registration"}


def view(con, sf):
    for f in os.listdir(sf):
        path = f"{sf}/{f}"
        con.execute(f"create view {f[:-8]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def canon(rows):
    return sorted([tuple(norm(x) for x in r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    view(c, sf)
    return c


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, con, name):
    df = Q.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in Q.ORACLE:
        assert name in PLAIN and got
        return
    rel = con.execute(Q.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()]
    assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1
