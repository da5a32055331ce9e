"""Every query against its SQL on the smallest tables."""

import pytest

from cadenza import plans

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(repr, r)) for r in df.select(*columns).collect())
    found = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(repr(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_entry_has_all(spark):
    import __spark_entry__ as entry

    assert set(plans.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
