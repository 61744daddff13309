"""Every registered query against its DuckDB oracle on the smallest tables
(the same compare the driver runs at sf0.01: sorted columns, row count and an
order-insensitive digest of the values)."""
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from oracle_check import digest  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from timefuse import registry  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

OWN = set(registry.QUERIES)
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in OWN}
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows, scols = df.collect(), df.columns
    cur = duck.execute(ORACLE[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(scols, srows)[0] == digest(dcols, drows)[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    first = df.schema
    assert df.count() > 0
    assert entry.entry(spark).schema == first
