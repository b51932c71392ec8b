"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from compare import check, connect
from conftest import SF
from lotwise.plans import load_all

REG = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REG))
def test_query(name, spark, con):
    status, text = check(REG[name], spark, con, SF)
    assert status != "FAIL", text


def test_only_iterative_ml_has_no_twin():
    assert sorted(n for n, q in REG.items() if q.sql is None) == ["logit_head", "logit_margins", "ml_baselines"]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())
