"""The split forms give the same numbers as the plain ones, with one group holding most rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.functions import scale as S
from lotwise.operators import metrics as M
from lotwise.operators import splits as P


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(40)}", rng.choice([rng.gauss(0, 5), 1.0, -2.0]), i) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, v double, i long").repartition(4)


def by_key(rows):
    d = defaultdict(list)
    for k, v, _ in rows:
        d[k].append(v)
    return d


@pytest.mark.parametrize("limit", [10, 100, 10**6])
def test_exact_quantiles(skewed, limit):
    rows, df = skewed
    got = {r.k: r for r in S.exact_quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.937}, hot_rows=limit).collect()}
    want = by_key(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert (got[k].a, got[k].m, got[k].z) == pytest.approx(tuple(np.percentile(v, [10, 50, 93.7])))


def test_exact_quantiles_without_keys(skewed):
    rows, df = skewed
    v = [r[1] for r in rows]
    for limit in (10, 10**6):
        r = S.exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.99}, hot_rows=limit).first()
        assert (r.m, r.q) == pytest.approx(tuple(np.percentile(v, [50, 99])))


def test_exact_medians(skewed):
    rows, df = skewed
    x = df.withColumn("w", -F.col("v") * 2)
    for limit in (10, 10**6):
        got = {r.k: (r.v_med, r.w_med) for r in S.exact_medians(x, ["k"], ["v", "w"], hot_rows=limit).collect()}
        for k, v in by_key(rows).items():
            assert got[k] == pytest.approx((np.median(v), -2 * np.median(v)))


def test_prefix_sums(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aab"), float(x), rng.randrange(10)) for x in rng.sample(range(-500, 500), 600)]
    df = spark.createDataFrame(rows, "k string, o double, n long").dropDuplicates(["k", "o"])
    rows = [tuple(r) for r in df.collect()]
    for limit in (20, 10**6):
        got = {(r.k, r.o): r.cum_n for r in S.prefix_sums(df, ["k"], "o", ["n"], limit=limit).collect()}
        for k in "ab":
            run = 0
            for _, o, n in sorted(r for r in rows if r[0] == k):
                run += n
                assert got[(k, o)] == run
        assert len(got) == len(rows)


def test_dense_index(spark):
    vals = random.Random(2).sample(range(10**6), 700)
    df = spark.createDataFrame([(v,) for v in vals + vals[:50]], "v long")
    got = {r.v: r.idx for r in S.dense_index(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(vals))}


def test_hash_rank_and_caps(skewed):
    rows, df = skewed
    key = lambda i: hashlib.md5(f"s|{i}".encode()).hexdigest()
    order = defaultdict(list)
    for k, _, i in rows:
        order[k].append(i)
    for v in order.values():
        v.sort(key=key)
    for limit in (10, 300, 10**6):
        got = S.hash_rank(df.withColumn("h", P.seeded("i", "s")), ["k"], "h", limit=limit).collect()
        assert all(order[r.k][r.rn - 1] == r.i and r.rn_n == len(order[r.k]) for r in got) and len(got) == len(rows)
    for cap in (7, 1001):
        capped = P.cap_per_group(df, ["k"], "i", "s", cap).collect()
        assert {(r.k, r.i) for r in capped} == {(k, i) for k, v in order.items() for i in v[:cap]}


def test_first_k_is_limited_before_the_shuffle(skewed):
    _, df = skewed
    plan = P.first_k(df, ["k"], [F.col("i")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_attach(skewed, spark):
    rows, df = skewed
    stats = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = S.hot_groups(df, ["k"], 500)
    assert [r.k for r in hot.collect()] == ["hot"]
    got = S.attach(df, stats, ["k"], hot)
    n = {k: len(v) for k, v in by_key(rows).items()}
    assert got.count() == len(rows) and all(r.n == n[r.k] for r in got.collect())
    left = S.attach(df, stats.where("k <> 'hot'"), ["k"], hot, "left")
    assert left.where("n is null").count() == n["hot"]


def test_auroc_with_ties(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), float(rng.randrange(12)), rng.random() < 0.3) for _ in range(500)]
    got = {r.g: r.auroc for r in M.auroc(spark.createDataFrame(rows, "g string, s double, p boolean"), ["g"], "s", "p").collect()}
    for g in "ab":
        pos = np.array([s for k, s, p in rows if k == g and p])
        neg = np.array([s for k, s, p in rows if k == g and not p])
        want = ((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean()
        assert got[g] == pytest.approx(want)


def test_validation_split_rounding(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 10), ("b", 3), ("c", 25)) for i in range(n)], "k string, i int")
    floor = {r.k: r.n for r in P.validation_split(df, ["k"], "i", "s", 0.12).groupBy("k").agg(F.count_if("is_val").alias("n")).collect()}
    near = {r.k: r.n for r in P.validation_split(df, ["k"], "i", "s", 0.1, "round").groupBy("k").agg(F.count_if("is_val").alias("n")).collect()}
    assert floor == {"a": 1, "b": 1, "c": 3} and near == {"a": 1, "b": 1, "c": 2}


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_connected(spark, one_task):
    """A path of 60, a star, a ring, a pair given twice and from both ends, and a link to itself."""
    from lotwise.functions.graph import connected

    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 301), (301, 300), (300, 301), (400, 400)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    want = {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 30)} | {200 + i: 200 for i in range(1, 9)} | {301: 300}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long"), one_task=one_task).count() == 0


def test_t_two_sided(spark):
    """Against the closed forms of one, two and four degrees of freedom, and tabulated quantiles."""
    from lotwise.functions import core as fn

    p1 = lambda t: 1 - 2 / np.pi * np.arctan(t)
    p2 = lambda t: 1 - t / np.sqrt(2 + t * t)
    p4 = lambda t: 1 - (lambda s: 1.5 * (s - s**3 / 3))(t / np.sqrt(4 + t * t))
    rows = [(t, d, f(t)) for t in (0.0, 0.01, 0.7, 1.0, 3.0, 40.0) for d, f in ((1, p1), (2, p2), (4, p4))]
    rows += [(2.2281388519649385, 10, 0.05), (2.5758293035489, 10**7, 0.0100000), (-2.0422724563012373, 30, 0.05)]
    df = spark.createDataFrame([(float(t), d, float(p)) for t, d, p in rows], "t double, d long, p double")
    for r in df.select("t", "d", "p", fn.t_two_sided(F.col("t"), F.col("d")).alias("got")).collect():
        assert r.got == pytest.approx(r.p, abs=1e-9 if r.d < 10**6 else 1e-6), r
    assert df.select(fn.t_two_sided(F.col("t"), F.lit(0)).alias("x")).first().x is None
