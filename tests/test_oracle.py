"""Every query with SQL gives the same rows as its SQL, on the smallest tables."""

import pytest
from conftest import same

from siltstone.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, tiny, name):
    df = queries.QUERIES[name](spark, tiny)
    if name in oracle.SQL:
        same(df, duck.execute(oracle.SQL[name]))
    else:
        assert df.count() > 0


def test_names_agree():
    assert set(oracle.SQL) <= set(queries.QUERIES)


def test_entry_point(spark, tiny):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["query_id", "mmr_rank", "vec_id"]
