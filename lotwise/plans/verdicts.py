"""Lot verdicts, intervals, pooling, outcomes and their tallies."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.operators import gates as G
from lotwise.operators import verdict as V
from lotwise.plans.photos import GATE_V1, GATE_V2, PHOTOS, photo_table
from lotwise.plans.registry import query
from lotwise.plans.sqltext import LOTS, band, r6, verdict, wilson

VERDICT_COLS = ["total", "good", "defects", "unsure", "answered"]


def rounded(df, *keys):
    return df.select(*keys, *VERDICT_COLS, fn.r6("p").alias("p"), fn.r6("lo").alias("lo"), fn.r6("hi").alias("hi"),
                     fn.r6("unsure_frac").alias("unsure_frac"), "reason", "band", "about", "can_add")


SQL_COLS = (f"total, good, defects, unsure, answered, {r6('p')} AS p, {r6('lo')} AS lo, {r6('hi')} AS hi, {r6('unsure_frac')} AS unsure_frac, "
            "reason, band, about, band <> 'unsure' AND about AND handfuls < 3 AS can_add")


@query("lot_verdict", f"WITH {LOTS} SELECT lot, {SQL_COLS} FROM ({verdict('lots', 'lot')})")
def lot_verdict(t):
    return rounded(V.lot_verdict(t.lots(), ["lot"]), "lot")


@query("lot_verdict_v0", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot, year')}), w AS (SELECT *, answered = 0 OR unsure_frac > 0.15e0 AS stop,
 CASE WHEN {band('lo')} = {band('hi')} THEN {band('lo')} ELSE 'unsure' END AS iv FROM v)
 SELECT lot, year, total, defects, answered, {r6('lo')} AS lo, {r6('hi')} AS hi, CASE WHEN stop THEN 'unsure' ELSE iv END AS band,
 CASE WHEN stop THEN 'too_many_unsure' WHEN iv = 'unsure' THEN 'interval_spans_bands' ELSE '' END AS reason FROM w""")
def lot_verdict_v0(t):
    out = V.lot_verdict_v0(t.lots(), ["lot", "year"])
    return out.select("lot", "year", "total", "defects", "answered", fn.r6("lo").alias("lo"), fn.r6("hi").alias("hi"), "band", "reason")


_P, _LO, _HI = wilson("k", "n")


@query("wilson_by_group", f"""WITH {LOTS}, g AS (SELECT source, flag, count(*) FILTER (WHERE code=1) AS k, count(*) FILTER (WHERE code<>2) AS n FROM lots GROUP BY source, flag)
 SELECT source, flag, k, n, {r6(_P)} AS p, {r6(_LO)} AS lo, {r6(_HI)} AS hi FROM g""")
def wilson_by_group(t):
    g = t.lots().groupBy("source", "flag").agg(F.count_if(F.col("code") == 1).alias("k"), F.count_if(F.col("code") != 2).alias("n"))
    p, lo, hi = fn.wilson("k", "n")
    return g.select("source", "flag", "k", "n", fn.r6(p).alias("p"), fn.r6(lo).alias("lo"), fn.r6(hi).alias("hi"))


@query("band_flags", f"""WITH {LOTS}, g AS (SELECT lot, line, count(*) FILTER (WHERE code=1) AS k, count(*) FILTER (WHERE code<>2) AS n FROM lots GROUP BY lot, line),
 w AS (SELECT *, {_P} AS p, {_LO} AS lo, {_HI} AS hi FROM g)
 SELECT lot, line, k, n, {band('p')} AS rate_band, CASE WHEN {band('lo')}={band('hi')} THEN {band('lo')} ELSE 'unsure' END AS interval_band,
 {band('p')}='unsure' OR {band('lo')}<>{band('p')} OR {band('hi')}<>{band('p')} AS crosses FROM w""")
def band_flags(t):
    g = t.lots().groupBy("lot", "line").agg(F.count_if(F.col("code") == 1).alias("k"), F.count_if(F.col("code") != 2).alias("n"))
    p, lo, hi = fn.wilson("k", "n")
    return g.select("lot", "line", "k", "n", fn.band_of_rate(p).alias("rate_band"), fn.band_of_interval(lo, hi).alias("interval_band"),
                    fn.crosses_edge(p, lo, hi).alias("crosses"))


@query("lot_pooled", f"""WITH {LOTS}, l7 AS (SELECT *, lot*100+line AS pool FROM lots), each AS ({verdict('l7', 'pool, year')}),
 sums AS (SELECT pool, CAST(sum(total) AS BIGINT) AS total, CAST(sum(good) AS BIGINT) AS good, CAST(sum(defects) AS BIGINT) AS defects, CAST(sum(unsure) AS BIGINT) AS unsure,
   CAST(sum(answered) AS BIGINT) AS answered, count(*) AS handfuls, min(year) FILTER (WHERE band='unsure') AS vy, arg_min(reason, year) FILTER (WHERE band='unsure') AS vr FROM each GROUP BY pool),
 pooled AS (SELECT *, CASE WHEN reason <> '' THEN FALSE ELSE {band('lo')} <> {band('p')} OR {band('hi')} <> {band('p')} END AS about, CASE WHEN reason <> '' THEN 'unsure' ELSE {band('p')} END AS band FROM (
   SELECT *, CASE WHEN answered=0 THEN 'too_many_unsure' WHEN p > 0.6e0 THEN 'implausible' WHEN unsure_frac > 0.15e0 THEN 'too_many_unsure' ELSE '' END AS reason FROM (
   SELECT *, {wilson('defects', 'answered')[0]} AS p, {wilson('defects', 'answered')[1]} AS lo, {wilson('defects', 'answered')[2]} AS hi, CAST(unsure AS DOUBLE)/total AS unsure_frac FROM sums)))
 SELECT pool, handfuls, total, good, defects, unsure, answered, {r6('p')} AS p, {r6('lo')} AS lo, {r6('hi')} AS hi, {r6('unsure_frac')} AS unsure_frac,
   CASE WHEN band<>'unsure' AND vy IS NOT NULL THEN vr ELSE reason END AS reason, CASE WHEN band<>'unsure' AND vy IS NOT NULL THEN 'unsure' ELSE band END AS band,
   about AND NOT (band<>'unsure' AND vy IS NOT NULL) AS about, band<>'unsure' AND about AND handfuls<3 AND vy IS NULL AS can_add FROM pooled""")
def lot_pooled(t):
    df = t.lots().withColumn("pool", F.col("lot") * 100 + F.col("line"))
    return rounded(V.pooled_verdict(df, ["pool"], "year"), "pool", "handfuls")


@query("ledger", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot, flag')}) SELECT lot, flag, total AS found, good+defects AS sure, defects, good AS sound, unsure AS not_sure,
 total = good+defects+unsure AS adds_up, 'defect:'||defects||' sound:'||good||' unsure:'||unsure AS dots FROM v""")
def ledger(t):
    return V.ledger(V.tally_calls(t.lots(), ["lot", "flag"])).select("lot", "flag", "found", "sure", "defects", "sound", "not_sure", "adds_up", "dots")


def photo_outcomes(t):
    v = V.lot_verdict(t.items(), ["photo"]).select("photo", "band", "reason", "p", "unsure_frac")
    ph = photo_table(t).withColumn("gate", G.gate_v2())
    out = ph.join(v, "photo")
    return out.withColumns({
        "outcome": V.outcome(F.col("gate"), F.col("band"), F.col("reason")),
        "ungated": V.outcome(F.lit(""), F.col("band"), F.col("reason")),
    })


OUTCOMES = PHOTOS + f""", pv AS ({verdict('items', 'photo')}), outcomes AS (SELECT *, CASE WHEN gate <> '' THEN 'retake:'||gate ELSE ungated END AS outcome FROM (
 SELECT ph.*, {GATE_V2} AS gate, pv.band, pv.reason, pv.p, pv.unsure_frac, CASE WHEN pv.band='unsure' THEN 'notsure:'||pv.reason ELSE pv.band END AS ungated FROM photos ph JOIN pv USING (photo)))"""


@query("photo_outcome", f"WITH {OUTCOMES} SELECT photo, lot, year, gate, band, reason, outcome, ungated FROM outcomes")
def photo_outcome(t):
    return photo_outcomes(t).select("photo", "lot", "year", "gate", "band", "reason", "outcome", "ungated")


def _tally_sql(src, grp, o):
    return f"""k AS (SELECT CAST({grp} AS VARCHAR) AS grp, {o} AS o FROM {src}), k2 AS (SELECT grp, o FROM k UNION ALL SELECT 'all', o FROM k),
 k3 AS (SELECT grp, o, count(*) AS n, CASE WHEN starts_with(o,'retake') THEN 'retake' WHEN starts_with(o,'notsure') THEN 'notsure' ELSE 'band' END AS kd FROM k2 GROUP BY grp, o)
 SELECT grp, CAST(sum(n) AS BIGINT) AS photos, CAST(coalesce(sum(n) FILTER (WHERE kd='band'),0) AS BIGINT) AS given_band, CAST(coalesce(sum(n) FILTER (WHERE kd='notsure'),0) AS BIGINT) AS not_sure,
 CAST(coalesce(sum(n) FILTER (WHERE kd='retake'),0) AS BIGINT) AS retake, {r6("100.0e0*coalesce(sum(n) FILTER (WHERE kd='band'),0)/sum(n)")} AS pct_band,
 string_agg(o||'='||n, ' ' ORDER BY o||'='||n) AS outcomes FROM k3 GROUP BY grp"""


@query("outcome_tally", f"WITH {OUTCOMES}, {_tally_sql('outcomes', 'year', 'outcome')}")
def outcome_tally(t):
    return V.outcome_tally(photo_outcomes(t), "year")


@query("gated_vs_ungated", f"""WITH {OUTCOMES}, u AS (SELECT year, 'app' AS view, outcome, p FROM outcomes UNION ALL SELECT year, 'gates_ignored', ungated, p FROM outcomes)
 SELECT year, view, outcome, count(*) AS photos, {r6('median(p)')} AS median_rate FROM u GROUP BY year, view, outcome""")
def gated_vs_ungated(t):
    o = photo_outcomes(t).select("year", "p", F.col("outcome").alias("app"), F.col("ungated").alias("gates_ignored"))
    u = o.unpivot(["year", "p"], ["app", "gates_ignored"], "view", "outcome")
    return u.groupBy("year", "view", "outcome").agg(F.count(F.lit(1)).alias("photos"), fn.r6(F.median("p")).alias("median_rate"))


TRUTH = "CASE WHEN rate < 0.05e0 THEN 'clean' WHEN rate <= 0.2e0 THEN 'some' ELSE 'many' END"


def truth_outcomes(t):
    """Photo outcomes next to a truth band read from the return flags of the photo's items."""
    truth = t.items().groupBy("photo").agg(fn.band_of_rate(F.avg(F.when((F.col("flag") == "R") & (F.col("qty") <= 20), 1.0).otherwise(0.0))).alias("truth"))
    return photo_outcomes(t).join(truth, "photo")


TRUTH_SQL = OUTCOMES + f""", tr AS (SELECT photo, {TRUTH} AS truth FROM (SELECT photo, avg(CASE WHEN flag='R' AND qty<=20 THEN 1.0e0 ELSE 0.0e0 END) AS rate FROM items GROUP BY photo)),
 truthed AS (SELECT o.*, tr.truth FROM outcomes o JOIN tr USING (photo))"""
SCORE_SQL = """count(*) AS lots, count(*) FILTER (WHERE isb) AS bands, count(*) FILTER (WHERE isb AND truth=o) AS correct, count(*) FILTER (WHERE isb AND truth<>o) AS wrong,
 count(*) FILTER (WHERE truth='clean' AND o='many') AS clean_called_many, count(*) FILTER (WHERE truth='many' AND o='clean') AS many_called_clean"""


@query("tray_score", f"""WITH {TRUTH_SQL}, z AS (SELECT year, truth, ungated AS o, ungated IN ('clean','some','many') AS isb FROM truthed)
 SELECT year, truth, {SCORE_SQL} FROM z GROUP BY year, truth""")
def tray_score(t):
    return V.lot_score(truth_outcomes(t), ["year", "truth"], out="ungated")


RULES = ["none", "gate_v1", "gate_v2", "size_60", "unsure_strict"]


@query("gate_compare", f"""WITH {TRUTH_SQL}, r AS (SELECT year, truth, ungated AS before, ungated AS "none", CASE WHEN g1 <> '' THEN 'refused' ELSE ungated END AS gate_v1,
 CASE WHEN gate <> '' THEN 'refused' ELSE ungated END AS gate_v2, CASE WHEN count < 60 THEN 'refused' ELSE ungated END AS size_60, CASE WHEN unsure_frac > 0.05e0 THEN 'refused' ELSE ungated END AS unsure_strict
 FROM (SELECT *, {GATE_V1} AS g1 FROM truthed)), u AS (SELECT year, truth, before, rule, after FROM r UNPIVOT (after FOR rule IN ("none", gate_v1, gate_v2, size_60, unsure_strict)))
 SELECT rule, year, count(*) AS photos, count(*) FILTER (WHERE before IN ('clean','some','many')) AS before_conf, count(*) FILTER (WHERE after IN ('clean','some','many')) AS kept,
 count(*) FILTER (WHERE before IN ('clean','some','many') AND after NOT IN ('clean','some','many')) AS lost, count(*) FILTER (WHERE after IN ('clean','some','many') AND after<>truth) AS wrong
 FROM u GROUP BY rule, year""")
def gate_compare(t):
    """What each rule set would have refused, kept and still got wrong."""
    o = truth_outcomes(t).withColumn("g1", G.gate_v1())
    ref = lambda c: F.when(c, "refused").otherwise(F.col("ungated"))
    r = o.select("year", "truth", F.col("ungated").alias("before"), F.col("ungated").alias("none"), ref(F.col("g1") != "").alias("gate_v1"),
                 ref(F.col("gate") != "").alias("gate_v2"), ref(F.col("count") < 60).alias("size_60"), ref(F.col("unsure_frac") > 0.05).alias("unsure_strict"))
    u = r.unpivot(["year", "truth", "before"], RULES, "rule", "after")
    conf = lambda c: F.col(c).isin("clean", "some", "many")
    return u.groupBy("rule", "year").agg(
        F.count(F.lit(1)).alias("photos"), F.count_if(conf("before")).alias("before_conf"), F.count_if(conf("after")).alias("kept"),
        F.count_if(conf("before") & ~conf("after")).alias("lost"), F.count_if(conf("after") & (F.col("after") != F.col("truth"))).alias("wrong"))


@query("rule_margin", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot, line')}), m AS (SELECT * FROM v WHERE unsure_frac <= 0.15e0 AND answered > 0), a AS (SELECT count(*) AS of_groups FROM v)
 SELECT count(*) AS n, (SELECT of_groups FROM a) AS of_groups, {r6('min(p)')} AS min_p, {r6('quantile_cont(p,0.05)')} AS p5, {r6('quantile_cont(p,0.25)')} AS p25, {r6('quantile_cont(p,0.5)')} AS p50,
 {r6('avg(CASE WHEN p <= 0.6e0 THEN 1.0e0 ELSE 0.0e0 END)')} AS share_below, {r6('avg(CASE WHEN p > 0.5e0 AND p <= 0.6e0 THEN 1.0e0 ELSE 0.0e0 END)')} AS share_close FROM m""")
def rule_margin(t):
    """How far the groups the unsure rule would pass are from the implausible rule."""
    from lotwise.functions.scale import exact_quantiles, one_row

    v = V.lot_verdict(t.lots(), ["lot", "line"])
    pass_ = (F.col("unsure_frac") <= 0.15) & (F.col("answered") > 0)
    q = exact_quantiles(v.where(pass_), [], "p", {"p5": 0.05, "p25": 0.25, "p50": 0.5})
    pp = F.when(pass_, F.col("p"))
    agg = v.agg(F.count_if(pass_).alias("n"), F.count(F.lit(1)).alias("of_groups"), F.min(pp).alias("min_p"),
                F.avg(F.when(pass_, F.when(F.col("p") <= 0.6, 1.0).otherwise(0.0))).alias("share_below"),
                F.avg(F.when(pass_, F.when((F.col("p") > 0.5) & (F.col("p") <= 0.6), 1.0).otherwise(0.0))).alias("share_close"))
    return agg.withColumn("_q", one_row(q)).select("*", "_q.*").select("n", "of_groups", *[fn.r6(c).alias(c) for c in ("min_p", "p5", "p25", "p50", "share_below", "share_close")])


@query("extreme_rates", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot, line')}), w AS (SELECT *, CASE WHEN answered=0 OR unsure_frac > 0.15e0 THEN 'unsure' WHEN {band('lo')}={band('hi')} THEN {band('lo')} ELSE 'unsure' END AS old_band FROM v)
 SELECT {r6("min(p) FILTER (WHERE old_band='many')")} AS min_old_many, {r6("max(p) FILTER (WHERE band <> 'unsure')")} AS max_new_band,
 count(*) FILTER (WHERE old_band='many') AS old_many, count(*) FILTER (WHERE band='many') AS new_many FROM w""")
def extreme_rates(t):
    c = V.tally_calls(t.lots(), ["lot", "line"])
    both = V.decide(c).withColumn("old_band", F.when((F.col("answered") == 0) | (F.col("unsure_frac") > 0.15), "unsure").otherwise(fn.band_of_interval("lo", "hi")))
    old, new = F.col("old_band") == "many", F.col("band") != "unsure"
    return both.agg(fn.r6(F.min(F.when(old, F.col("p")))).alias("min_old_many"), fn.r6(F.max(F.when(new, F.col("p")))).alias("max_new_band"),
                    F.count_if(old).alias("old_many"), F.count_if(F.col("band") == "many").alias("new_many"))


@query("gauge_pos", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot')}), x AS (SELECT lot, greatest(0.0e0, least(1.0e0, p)) AS x FROM v WHERE p IS NOT NULL)
 SELECT lot, {r6("greatest(0.005e0, least(0.995e0, CASE WHEN x <= 0.05e0 THEN x/0.05e0/3 WHEN x <= 0.2e0 THEN 1.0e0/3+(x-0.05e0)/0.15e0/3 ELSE 2.0e0/3+(x-0.2e0)/0.8e0/3 END))")} AS pos FROM x""")
def gauge_pos(t):
    v = V.lot_verdict(t.lots(), ["lot"]).where(F.col("p").isNotNull())
    return v.select("lot", fn.r6(fn.gauge_position("p")).alias("pos"))
