"""Every registered query against its SQL in DuckDB, as bags of rows with rounded doubles."""

import datetime
import math
from collections import Counter

import pytest

import __spark_entry__ as entry

from .conftest import DATA

SF = "sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(name, spark, duck):
    df = entry.queries()[name](spark, f"{DATA}/{SF}")
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck(SF).execute(entry.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = Counter(tuple(plain(row[i]) for i in at) for row in cursor.fetchall())
    assert got == expected, (list((got - expected).items())[:3], list((expected - got).items())[:3])


def test_every_query_of_the_library_has_sql():
    from quadrille import registry

    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
