"""Golden cases of the fixed rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.operators import calls as K
from lotwise.operators import gates as G
from lotwise.operators import privacy as P
from lotwise.operators import verdict as V


def verdicts(spark, cases):
    rows = [(i, a + u, a - d, d, u, a) for i, (d, a, u) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, total long, good long, defects long, unsure long, answered long")
    return [r.asDict() for r in V.decide(df).orderBy("i").collect()]


def test_verdict_edges(spark):
    cases = [(12, 100, 0), (3, 100, 0), (5, 50, 0), (25, 97, 0), (60, 100, 0), (61, 100, 0), (0, 85, 15), (0, 84, 16), (0, 0, 30), (61, 80, 20), (5, 100, 0), (20, 100, 0)]
    r = verdicts(spark, cases)
    assert [(x["band"], x["reason"]) for x in r] == [
        ("some", ""), ("clean", ""), ("some", ""), ("many", ""), ("many", ""), ("unsure", "implausible"), ("clean", ""),
        ("unsure", "too_many_unsure"), ("unsure", "too_many_unsure"), ("unsure", "implausible"), ("some", ""), ("some", "")]
    assert [x["about"] for x in r[:4]] == [False, True, True, True]
    assert (round(r[0]["lo"], 3), round(r[0]["hi"], 3)) == (0.070, 0.198)
    assert round(r[2]["lo"], 4) == 0.0435
    assert r[8]["p"] is None and (r[8]["lo"], r[8]["hi"]) == (0.0, 1.0) and r[8]["unsure_frac"] == 1.0


def test_wilson_holds_its_rate(spark):
    df = spark.range(1, 60).select(F.col("id").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    p, lo, hi = fn.wilson("k", "n")
    assert df.where((p < lo - 1e-12) | (p > hi + 1e-12) | (lo < 0) | (hi > 1)).count() == 0


def test_pooled_veto(spark):
    rows = [("a", 1, 1)] * 3 + [("a", 1, 0)] * 97 + [("a", 2, 2)] * 40 + [("a", 2, 0)] * 60 + [("b", 1, 1)] * 3 + [("b", 1, 0)] * 97 + [("b", 2, 0)] * 50
    df = spark.createDataFrame(rows, "lot string, handful int, code int")
    r = {x["lot"]: x for x in V.pooled_verdict(df, ["lot"], "handful").collect()}
    assert (r["a"]["band"], r["a"]["reason"], r["a"]["can_add"]) == ("unsure", "too_many_unsure", False)
    assert (r["b"]["band"], r["b"]["handfuls"], r["b"]["total"]) == ("clean", 2, 150)


def test_veto_keeps_the_first_reason(spark):
    # the pool itself gets a band; handful 2 is implausible, handful 3 has too many unsure items
    rows = [("a", 1, 0)] * 400 + [("a", 2, 1)] * 7 + [("a", 2, 0)] * 3 + [("a", 3, 2)] * 3 + [("a", 3, 0)] * 7
    r = V.pooled_verdict(spark.createDataFrame(rows, "lot string, handful int, code int"), ["lot"], "handful").first()
    assert (r["band"], r["reason"]) == ("unsure", "implausible")


def test_ledger_adds_up(spark):
    rng = random.Random(1)
    rows = [(i, *(rng.randrange(200) for _ in range(3))) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, good long, defects long, unsure long").withColumn("total", F.expr("good + defects + unsure"))
    assert V.ledger(df).where(~F.col("adds_up")).count() == 0


def gate_row(**kw):
    base = dict(too_dark=False, too_blurry=False, count=100, count_ok=True, too_many_touching=False, not_green=False, colour_reason="",
                frac_off=0.0, frac_white=0.0, frac_dark=0.0, is_dark_lot=False)
    base.update(kw)
    base["count_ok"] = 20 <= base["count"] <= 160
    return base


GATES = [
    (gate_row(), "", ""),
    (gate_row(too_dark=True, too_blurry=True), "dark", "dark"),
    (gate_row(count=5, too_blurry=True), "count", "blur"),
    (gate_row(count=5, too_many_touching=True), "spread", "count"),
    (gate_row(count=5, not_green=True, colour_reason="off_colour", frac_off=0.9), "not_green", "not_green"),
    (gate_row(not_green=True, colour_reason="big_blob", too_many_touching=True), "spread", "not_green"),
    (gate_row(not_green=True, colour_reason="big_blob", too_many_touching=True, frac_off=0.6), "not_green", "not_green"),
    (gate_row(too_many_touching=True), "spread", "spread"),
    (gate_row(count=161), "count", "count"),
    (gate_row(count=161, too_many_touching=True), "spread", "count"),
    (gate_row(count=160), "", ""), (gate_row(count=20), "", ""), (gate_row(count=19), "count", "count"),
]


def test_gate_orders(spark):
    df = spark.createDataFrame([{"i": i, **g[0]} for i, g in enumerate(GATES)])
    r = df.select("i", G.gate_v2().alias("v2"), G.gate_v1().alias("v1")).orderBy("i").collect()
    assert [(x.v2, x.v1) for x in r] == [(g[1], g[2]) for g in GATES]


def test_dark_lot_is_answered_not_refused(spark):
    dark = dict(not_green=True, colour_reason="too_dark_items", frac_dark=0.9)
    rows = [gate_row(**dark, is_dark_lot=True), gate_row(**dark), gate_row(**dark, is_dark_lot=True, too_many_touching=True), gate_row(**dark, is_dark_lot=True, too_dark=True)]
    df = spark.createDataFrame([{"i": i, **g} for i, g in enumerate(rows)])
    assert [x[0] for x in df.orderBy("i").select(G.screen()).collect()] == ["unsure:dark_lot", "retake:not_green", "retake:not_green", "retake:dark"]


def test_calls(spark):
    df = spark.createDataFrame([(0.55, False), (0.5499, False), (0.09, False), (0.0901, False), (0.99, True), (None, False)], "p double, t boolean")
    assert [x[0] for x in df.select(K.call_pair("p", "t")).collect()] == [0, 2, 1, 2, 2, 2]
    assert [x[0] for x in df.select(K.call_pair("p", "t", tg=None)).collect()] == [2, 2, 1, 2, 2, 2]
    v = spark.createDataFrame([(0.99, 0.1, False), (0.99, 0.1, True), (0.99, 0.3, False)], "p double, v double, t boolean")
    assert [x[0] for x in v.select(K.call_override("p", "v", "t")).collect()] == [1, 2, 0]


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([1 / 6] * 6,), ([0.1, 0.2, 0.3, 0.3, 0.05, 0.05],)], "p array<double>")
    r = df.select(K.call_argmax("p", F.lit(False), 0.1), K.likely_type("p"), K.call_argmax("p", F.lit(False), 0.5)).collect()
    assert [tuple(x) for x in r] == [("good", "dark", "unsure"), ("insect", "insect", "unsure")]


def test_slip_fits_and_hides_counts(spark):
    days = ["2024-01-01", "2024-12-31"]
    rows = [(d, t, k, u, b) for d, (t, k, u), b in itertools.product(days, [(1, 0, 0), (100, 12, 0), (99999, 8888, 777), (10**7, 10**6, 10**5)], (True, False))]
    df = spark.createDataFrame(rows, "d string, t long, k long, u long, b boolean").withColumn("day", F.to_date("d"))
    s = df.withColumn("s", P.slip_text(F.col("day"), F.col("t"), F.col("k"), F.col("u"), F.col("b")))
    assert s.where(F.length("s") > C.SLIP_MAX).count() == 0
    assert s.where(F.col("b") & (F.col("s").contains("عيب") | ~F.col("s").contains(C.SLIP_UNSURE))).count() == 0
    assert s.where("s rlike '[0-9]'").count() == 0


def test_colour_classes(spark):
    rows = [(20, 15, 10), (250, 250, 245), (180, 150, 110), (220, 60, 60), (60, 80, 220), (0, 0, 0), (128, 128, 128)]
    df = fn.with_hsv(spark.createDataFrame(rows, "r int, g int, b int"))
    import colorsys

    got = df.select("r", "g", "b", "h", "s", "v", fn.colour_class("h", "s", "v").alias("c")).collect()
    for x in got:
        h, s, v = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert (x.h, x.s, x.v) == pytest.approx((h * 360, s, v))
    assert [x.c for x in got] == ["dark", "white", "pale", "off", "off", "dark", "off"]


def test_touching_rule_order(spark):
    one = [("p", f"s{i}", 100.0, 0.95, 0.95, 1.3) for i in range(6)]
    odd = [("p", "twice", 181.0, 0.95, 0.95, 1.3), ("p", "big", 165.0, 0.95, 0.95, 1.3), ("p", "hollow", 100.0, 0.7, 0.95, 1.3), ("p", "thin", 100.0, 0.9, 0.8, 1.3)]
    df = spark.createDataFrame(one + odd, "photo string, item string, area double, solidity double, fill double, elong double")
    r = {x.item: x.why for x in G.touching_rule(df, "photo").collect()}
    assert (r["twice"], r["big"], r["hollow"], r["thin"], r["s0"]) == ("area_median", "area_single", "solidity", "fill", "")


def test_gauge_thirds(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (0.2,), (1.0,), (0.6,)], "x double")
    got = [x[0] for x in df.select(fn.gauge_position("x")).collect()]
    assert got == pytest.approx([0.005, 1 / 3, 2 / 3, 0.995, 2 / 3 + 1 / 6])


def test_redacted_record(spark):
    df = spark.createDataFrame([("unsure", 5, 50, 0.1), ("many", 5, 50, 0.1)], "band string, defects int, total int, lo double")
    r = P.redact_unsure(df, ["band", "total"], ["defects", "lo"]).collect()
    assert [tuple(x) for x in r] == [("unsure", 50, None, None), ("many", 50, 5, 0.1)]


def test_vector_maths(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [0.0, 0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(fn.softmax("a", 2.0), fn.energy("a"), fn.unit("a"), fn.cosine("a", "z"), fn.retemper(fn.softmax("a", 2.0), 2.0, 1.0)).first()
    e = [math.exp(x / 2) for x in (1, 2, 3)]
    assert r[0] == pytest.approx([x / sum(e) for x in e])
    assert r[1] == pytest.approx(-math.log(sum(math.exp(x) for x in (1, 2, 3))))
    assert r[2] == pytest.approx([x / math.sqrt(14) for x in (1, 2, 3)])
    assert r[3] == 0
    e1 = [math.exp(x) for x in (1, 2, 3)]
    assert r[4] == pytest.approx([x / sum(e1) for x in e1])
