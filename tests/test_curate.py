"""Dedupe, near duplicates and matching against plain sequential references."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotwise.operators import curate as U
from lotwise.operators import matching as J
from lotwise.operators import vectors as X


def sequential_dedupe(rows, ref_m, ref_c):
    seen_m, seen_c = set(ref_m), set(ref_c)
    out = {}
    for s in sorted({r[0] for r in rows}):
        own_m, own_c, owner = set(), set(), {}
        for _, pos, path, m, c in sorted(r for r in rows if r[0] == s):
            if m in seen_m:
                why = "src_cross"
            elif owner.get(m, path) != path:
                why = "src_within"
            elif c in seen_c:
                why = "crop_cross"
            elif c in own_c:
                why = "crop_within"
            else:
                why = ""
                own_m.add(m)
                own_c.add(c)
            owner.setdefault(m, path)
            out[pos] = why
        seen_m |= own_m
        seen_c |= own_c
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_precedence_dedupe(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(5), i, f"p{rng.randrange(60)}", f"m{rng.randrange(40)}", f"c{rng.randrange(35)}") for i in range(160)]
    ref = spark.createDataFrame([("m1", "c2"), ("m3", "x")], "m string, c string")
    df = spark.createDataFrame(rows, "s int, pos int, path string, m string, c string")
    got = {r.pos: r.reason for r in U.precedence_dedupe(df, ref, source="s", order="pos", path="path", src_hash="m", crop_hash="c").collect()}
    want = sequential_dedupe(rows, ["m1", "m3"], ["c2", "x"])
    assert got == want
    assert len(set(want.values())) == 5


def test_a_dropped_row_is_not_seen(spark):
    # (source, pos, path, m, c): row 1 loses by its crop hash, so its file hash must not count as seen in source 2
    rows = [(0, 0, "a", "m0", "c0"), (1, 1, "b", "m1", "c0"), (2, 2, "c", "m1", "c9")]
    df = spark.createDataFrame(rows, "s int, pos int, path string, m string, c string")
    r = U.precedence_dedupe(df, None, source="s", order="pos", path="path", src_hash="m", crop_hash="c").orderBy("pos").collect()
    assert [x.reason for x in r] == ["", "crop_cross", ""]
    assert r[1].dup_of == "0"


def greedy_near(ids, vecs, groups, t):
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    kept, out = [], {}
    for i in np.argsort(ids):
        hit = any(u[i] @ u[j] >= t and groups[i] != groups[j] for j in kept)
        out[int(ids[i])] = not hit
        if not hit:
            kept.append(i)
    return out


@pytest.mark.parametrize("seed,t,chunk,pack", [(0, 0.9, 16, 500), (1, 0.98, 8, 6), (2, 0.5, 50, 9)])
def test_near_dup_keep(spark, seed, t, chunk, pack):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 6))
    vecs = np.concatenate([base[rng.integers(0, 12, 70)] + rng.normal(0, 0.25, (70, 6)), np.repeat(base[:1], 30, 0)])  # the last 30 are copies
    groups = [f"g{x}" for x in rng.integers(0, 6, 100)]
    ids = rng.permutation(1000)[:100]
    df = spark.createDataFrame([(int(i), [float(x) for x in v], g) for i, v, g in zip(ids, vecs, groups)], "id long, v array<double>, g string")
    df = df.withColumnRenamed("id", "key")
    got = {r["key"]: r.keep for r in X.near_dup_keep(df, "key", "v", "g", t, pivots=5, chunk=chunk, pack=pack).collect()}
    assert got == greedy_near(ids, vecs, groups, t)


def test_near_dup_chain(spark):
    # a ~ b ~ c, a not ~ c: keep a and c
    ang = [0.0, 0.3, 0.6]
    df = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))], f"g{i}") for i, a in enumerate(ang)], "key int, v array<double>, g string")
    r = X.near_dup_keep(df, "key", "v", "g", float(np.cos(0.35)), pivots=2).orderBy("key").collect()
    assert [x.keep for x in r] == [True, False, True]


@pytest.mark.parametrize("t", [0.2, 0.95])
def test_near_dup_partners(spark, t):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 5))
    vecs = base[rng.integers(0, 8, 90)] + rng.normal(0, 0.1, (90, 5))
    g = rng.integers(0, 4, 90)
    df = spark.createDataFrame([(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(zip(vecs, g))], "key int, v array<double>, g int")
    got = {r.id: (r.partners, r.first_partner) for r in X.near_dup_partners(df, "key", "v", "g", t, pivots=6, chunk=11).collect()}
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    hit = (u @ u.T >= t) & (g[:, None] != g[None, :])
    want = {i: (int(h.sum()), int(np.flatnonzero(h)[0])) for i, h in enumerate(hit) if h.any()}
    assert got == want


def test_near_dup_exempt_and_zero(spark):
    """0 drops 1; 2 is exempt and stays; zero and null vectors have no direction and stay."""
    rows = [(0, [1.0, 0.0], "a"), (1, [2.0, 0.0], "b"), (2, [1.0, 0.0], "free"), (3, [0.0, 0.0], "a"), (4, [0.0, 0.0], "b"), (5, None, "b")]
    df = spark.createDataFrame(rows, "key int, v array<double>, g string")
    r = X.near_dup_keep(df, "key", "v", "g", 0.998, exempt=F.col("g") == "free").orderBy("key").collect()
    assert [x.keep for x in r] == [True, False, True, True, True, True]


def test_compared_pairs_grow_less_than_the_square(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(6400, 6))
    took = []
    for n in (400, 1600, 6400):
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vec": list(v[:n])}))
        took.append(X.CosineCells(df, 0.998, chunk=64).compared())
    assert took[0] < 400**2 / 4 and all(b < 8 * a for a, b in zip(took, took[1:])), took


def test_crowded_cell(spark, monkeypatch):
    """Cells over the limit meet their sizes by broadcast; the result is the same."""
    monkeypatch.setattr(X, "HOT_ROWS", 5)
    test_near_dup_partners(spark, 0.95)


def test_centred(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 5.0],)], "v array<double>")
    assert [r.vec for r in X.centred(df, "v").collect()] == [pytest.approx([-(0.5**0.5), 0.0, 0.5**0.5]), [0.0, 0.0, 0.0]]


def test_nearest_in_chunks(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(120, 4))
    g = ["hot" if i < 80 else f"g{i % 9}" for i in range(120)]
    df = spark.createDataFrame([(i, k, [float(x) for x in a]) for i, (a, k) in enumerate(zip(v, g))], "id long, grp string, vec array<double>")
    got = {r.qid: r.distance for r in X.knn_distance(df, df, 3, by=["grp"], chunk=7).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(120):
        d = sorted(1 - u[i] @ u[j] for j in range(120) if j != i and g[j] == g[i])
        assert got[i] == pytest.approx(np.mean(d[:3]))


def plain_nearest(ids, u, k, groups=None, tags=None):
    out = set()
    for i in range(len(ids)):
        sims = u @ u[i]
        fine = [j for j in range(len(ids)) if j != i and (groups is None or groups[j] == groups[i]) and (tags is None or tags[j] != tags[i])]
        out |= {(ids[i], ids[j]) for j in sorted(fine, key=lambda j: (-round(sims[j], 9), ids[j]))[:k]}
    return out


@pytest.mark.parametrize("by,tag", [(False, False), (False, True), (True, False), (True, True)])
def test_nearest_by_pruned_cells(spark, by, tag):
    """One group holds most rows, copies tie by id, one tag holds nearly all rows near it, one vector is zero."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(9, 5))
    v = base[rng.integers(0, 9, 300)] + rng.normal(0, 0.05, (300, 5))
    v[40:60] = v[40]
    v[70] = 0
    groups, tags = np.where(rng.random(300) < 0.7, "hot", rng.choice(["a", "b"], 300)), np.where(v[:, 0] > 0, "x", "y")
    ids = rng.permutation(900)[:300]
    df = spark.createDataFrame([(int(i), str(g), str(t), [float(x) for x in a]) for i, g, t, a in zip(ids, groups, tags, v)], "id long, grp string, tag string, vec array<double>")
    got = X.nearest(df, df, 3, by=["grp"] if by else None, tag="tag" if tag else None, chunk=50).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    zero = int(ids[70])
    want = plain_nearest([int(i) for i in ids], u, 3, groups if by else None, tags if tag else None)
    assert {(r.qid, r.bid) for r in got if r.qid != zero} == {p for p in want if p[0] != zero}
    assert len(got) == len(want)


def test_pruned_pairs_grow_less_than_the_square(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6400, 8))
    took = []
    for n in (400, 1600, 6400):  # clusters of about 40
        v = base[rng.integers(0, n // 40, n)] + rng.normal(0, 0.03, (n, 8))
        df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vec": list(v)}))
        bank = X.PrunedBank(df, 5)
        assert bank.nearest(df).count() == 5 * n
        took.append(bank.compared())
    assert took[0] < 400**2 / 2 and all(b < 10 * a for a, b in zip(took, took[1:])), took


def test_nearest_of_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vec array<double>")
    assert X.PrunedBank(df, 9).nearest(df).count() == 20  # every other row
    assert X.PrunedBank(df.limit(0), 3).nearest(df).count() == 0


@pytest.mark.parametrize("pack", [3, 50, 5000])
def test_near_dup_keep_long_chain(spark, pack):
    """400 vectors, each near only to its neighbours: every other one stays, in a handful of rounds."""
    step = 0.01
    df = spark.createDataFrame([(i, [float(np.cos(step * i)), float(np.sin(step * i))], i) for i in range(90 if pack == 3 else 400)], "key int, v array<double>, g int")
    got = {r["key"]: r.keep for r in X.near_dup_keep(df, "key", "v", "g", float(np.cos(1.5 * step)), pivots=3, pack=max(pack, 20)).collect()}
    assert got == {i: i % 2 == 0 for i in got}


def test_hamming_partners(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2, (6, 64))
    rows = []
    for i in range(150):
        b = base[rng.integers(0, 6)].copy()
        b[rng.integers(0, 64, rng.integers(0, 7))] ^= 1
        rows.append("".join(map(str, b)))
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "k int, b string")
    first = {}
    for i, b in enumerate(rows):
        first.setdefault(b, i)
    want = {}
    for b, i in first.items():
        near = [(sum(x != y for x, y in zip(b, c)), j) for c, j in first.items() if c != b and any(b[w:w + 16] == c[w:w + 16] for w in (0, 16, 32, 48))]
        near = [(d, j) for d, j in near if d <= 8]
        if near or rows.count(b) > 1:
            want[i] = (rows.count(b), len(near), min((j for _, j in near), default=None), min((d for d, _ in near), default=None))
    for hot in (4096, 3):
        got = {r.id: (r.copies, r.partners, r.first_partner, r.distance) for r in X.hamming_partners(df, "k", "b", hot=hot).collect()}
        assert got == want


def python_greedy(pairs):
    out, used, last = {}, set(), {}
    for p in sorted({x[0] for x in pairs}):
        for f in sorted({x[1] for x in pairs if x[0] == p}):
            free = sorted((-v, j) for q, g, j, v in pairs if q == p and g == f and (p, j) not in used)
            if free:
                used.add((p, free[0][1]))
                out[(p, f)] = free[0][1]
    return out


@pytest.mark.parametrize("hot", [0, 10**6])
def test_greedy_match(spark, hot):
    rng = random.Random(11)
    pairs = list({(p, f, j): (p, f, j, round(rng.uniform(0.5, 1), 2)) for p in range(3) for f in range(14) for j in rng.sample(range(12), 4)}.values())
    df = spark.createDataFrame(pairs, "photo int, f int, j int, iou double")
    got = {(r.photo, r.f): r.j for r in J.greedy_match(df, "photo", "f", "j", hot_rows=hot).collect()}
    assert got == python_greedy(pairs)


def test_two_boxes_compete(spark):
    found = spark.createDataFrame([("p", 0, 0.0, 0.0, 10.0, 10.0), ("p", 1, 0.0, 1.0, 10.0, 11.0)], "photo string, f int, x0 double, y0 double, x1 double, y1 double")
    truth = spark.createDataFrame([("p", 7, 0.0, 1.0, 10.0, 11.0)], "photo string, j int, x0 double, y0 double, x1 double, y1 double")
    p = J.iou_pairs(found, truth, "photo", "f", "j", cell=4.0)
    assert p.count() == J.iou_pairs(found, truth, "photo", "f", "j", min_iou=0.4, cell=4.0).where("iou >= 0.5").count() == 2  # each overlap is seen once although the boxes share many cells
    assert [(r.f, r.j) for r in J.greedy_match(p, "photo", "f", "j").collect()] == [(0, 7)]


def test_sequence_gap(spark):
    rng = random.Random(3)
    a = [(rng.randrange(2), rng.randrange(400)) for _ in range(150)]
    c = [(rng.randrange(2), rng.randrange(400)) for _ in range(12)]
    mk = lambda x: spark.createDataFrame(x, "g int, n long")
    for gap in (0, 5, 20):
        got = sorted((r.g, r.n) for r in J.sequence_gap_anti(mk(a), mk(c), ["g"], "n", gap).collect())
        assert got == sorted(x for x in a if not any(y[0] == x[0] and abs(y[1] - x[1]) <= gap for y in c))


def test_hash_within_counts_other_files(spark):
    rows = [("s", "h", "a", 0), ("s", "h", "a", 1), ("s", "h", "b", 2), ("s", "h", "c", 3), ("s", "k", "z", 4), ("t", "k", "y", 5)]
    df = spark.createDataFrame(rows, "s string, h string, p string, o int")
    assert [tuple(r) for r in U.hash_within(df, "h", "s", "p", "o").collect()] == [("s", 2)]
    assert [tuple(r) for r in U.hash_cross_source(df, "h", "s").collect()] == [("s+t", 1)]


@pytest.mark.parametrize("tag", [False, True])
def test_pruned_groups_over_one_tile(spark, tag):
    """A group of many tiles goes through cells; the answers are those of the plain search."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(260, 6))
    v[30:50] = v[30]
    groups, tags, ids = np.where(np.arange(260) < 200, "hot", "cold"), np.where(v[:, 0] > 0, "x", "y"), rng.permutation(900)[:260]
    df = spark.createDataFrame([(int(i), str(g), str(t), [float(x) for x in a]) for i, g, t, a in zip(ids, groups, tags, v)], "id long, grp string, tag string, vec array<double>")
    got = X.nearest(df, df, 3, by=["grp"], tag="tag" if tag else None, chunk=3).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert {(r.qid, r.bid) for r in got} == plain_nearest([int(i) for i in ids], u, 3, groups, tags if tag else None)


def test_a_query_travels_once_per_pack(spark):
    """Vectors without structure visit every cell; before, a query was written once for each of about 100 cells."""
    v = np.random.default_rng(8).normal(size=(600, 32))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(600), "vec": list(v)}))
    bank = X.PrunedBank(df, 5, chunk=20)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(r.qid, r.bid) for r in bank.nearest(df).collect()}
    assert got == plain_nearest(list(range(600)), u, 5)
    packs = bank.cells.select("_pack").distinct().count()
    assert bank.cells.count() > 80 and packs <= 3 and bank.second.count() <= packs * 600


def test_rows_of_one_cell_travel_once_per_tile(spark):
    """100 rows in one cell at chunk 8: 13 x 13 blocks meet in one tile and leave one line (169 tiles of 8 rows before)."""
    v = np.random.default_rng(2).normal(size=(100, 4))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(100), "vec": list(v)}))
    cells = X.CosineCells(df, -0.99, chunk=8)
    assert cells.cells.count() == 1
    block = lambda left, right, sim: pd.DataFrame({"tiles": [1], "blocks": [1], "pairs": [sim.size]})
    merge = lambda out: pd.DataFrame({"tiles": [1], "blocks": [out["blocks"].sum()], "pairs": [out["pairs"].sum()]})
    r = cells.run(block, "tiles long, blocks long, pairs long", merge=merge).collect()
    assert [(x.tiles, x.blocks, x.pairs) for x in r] == [(1, 169, 10000)]


def test_probes_travel_once_per_pack(spark):
    """However many cells a probe visits; found pairs as by brute force, over several packs and tiles."""
    rng = np.random.default_rng(13)
    v = rng.normal(size=(3000, 6)) + 1.5
    v[:40] = v[0]  # more copies than a cell holds
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "vec": list(v)}))
    cells = X.CosineCells(df, 0.99, chunk=8)
    assert len(cells.home_parts) > 8 and cells.travelled < 9 * 3000, cells.travelled
    found = cells.run(lambda a, b, sim: pd.DataFrame({"id": b["id"].to_numpy(), "n": (sim >= 0.99).sum(0)}), "id long, n long")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert {r.id: r.n for r in found.groupBy("id").agg(F.sum("n").alias("n")).collect()} == dict(enumerate((u @ u.T >= 0.99).sum(1).tolist()))


def test_nearest_point_asks_few_cells(spark):
    """The nearest point as by brute force, with at most four rows per item (nine before)."""
    rng = np.random.default_rng(6)
    a, b = rng.uniform(-100, 200, (60, 2)), rng.uniform(-100, 200, (80, 2))
    items = spark.createDataFrame([(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(a)], "photo int, item int, cx double, cy double")
    points = spark.createDataFrame([(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(b)], "photo int, point int, cx double, cy double")
    got = {r.item: r.point for r in J.nearest_point(items, points, "photo", "item", "point", 30.0).collect()}
    for i, p in enumerate(a):
        d = sorted((float(np.hypot(*(p - q))), j) for j, q in enumerate(b) if j % 2 == i % 2)
        assert got[i] == (d[0][1] if d[0][0] < 30 else None)
    asked = J._in_reach(items, 30.0, 120.0).groupBy("item").count().toPandas()["count"]
    assert asked.max() <= 4 and asked.sum() < 60 * 3
