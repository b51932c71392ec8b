"""The same queries with limits so small that every group counts as oversized."""

import pytest

from compare import check, connect
from conftest import SF
from lotwise.functions import scale
from lotwise.plans import load_all

REG = load_all()
NAMES = ["component_filter", "touching_rule"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_with_small_limits(name, spark, con, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 40)
    monkeypatch.setattr(scale, "SPLIT_ROWS", 400)
    status, text = check(REG[name], spark, con, SF)
    assert status == "ok", text


def test_vectors_are_never_broadcast(spark):
    """An estimate takes an array for one element, so vectors of many times the limit pass for small: joins must not send them."""
    from pyspark.sql import functions as F

    from lotwise.operators import vectors as X

    df = spark.range(60).select("id", (F.col("id") % 3).alias("grp"), F.array(*[F.sin(F.col("id") % 20 * k) for k in range(1, 9)]).alias("vec"))
    kept = X.near_dup_keep(df, "id", "vec", "grp", 0.99)
    found = X.CosineCells(df.select("id", "vec"), 0.99).run(lambda a, b, sim: a[["id"]], "id long")
    for out in (kept, found):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
