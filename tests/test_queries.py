"""Every registered query against its SQL twin."""

import compare
import pytest

from linetrawl.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    rows, ok = compare.compare(spark, con, sf_dir, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok in (True, None), ok


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"fz_hits", "fz_segments", "fz_ratio"}
