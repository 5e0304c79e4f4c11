"""Every query of the reference's operators against its DuckDB oracle."""

import pytest

from segspark.plans import catalog

from .conftest import SMALL, canonical


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck):
    df = catalog.QUERIES[name](spark, SMALL)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    assert got
    if name in catalog.ORACLES:
        rel = duck.sql(catalog.ORACLES[name])
        assert sorted(rel.columns) == sorted(df.columns)
        assert got == canonical(rel.fetchall(), rel.columns)
