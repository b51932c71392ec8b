"""Temperature, coverage curves and threshold choices on held-out scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.operators import metrics as M
from lotwise.operators import thresholds as H
from lotwise.operators.splits import cell_weights
from lotwise.plans.metrics import EMBP, OK, WTS, emb_probs, rnd, weighted_scores
from lotwise.plans.registry import query
from lotwise.plans.sqltext import EMB, ITEMS, SCORES, r6

EW = """ec AS (SELECT source, y<>0 AS d, count(*) AS n FROM emb GROUP BY source, y<>0), ew AS (SELECT source, d, 1.0e0/(n*count(*) OVER (PARTITION BY source)) AS w FROM ec),
 wemb AS (SELECT emb.*, ew.w FROM emb JOIN ew ON emb.source=ew.source AND (emb.y<>0)=ew.d)"""
TS = [round(-3 + 0.1 * i, 6) for i in range(61)]
TS_SQL = "ts AS (SELECT round(-3+0.1e0*i, 6) AS log_t FROM range(61) r(i))"
NLL = """lt AS (SELECT source, y, w, log_t, list_transform(logits, lambda x: exp((x-list_max(logits))/exp(log_t))) AS ex FROM wemb, ts),
 loss AS (SELECT source, log_t, w, -ln(greatest(1e-12, least(1.0e0, CASE WHEN y>=0 THEN ex[greatest(y,0)+1]/list_sum(ex) ELSE 1-ex[1]/list_sum(ex) END))) AS l FROM lt)"""


def weighted_emb(t):
    return cell_weights(t.emb().withColumn("d", F.col("y") != 0), "source", "d")


@query("weighted_nll", f"WITH {EMB}, {EW}, {TS_SQL}, {NLL} SELECT log_t, {r6('sum(w*l)/sum(w)')} AS nll FROM loss GROUP BY log_t")
def weighted_nll(t):
    return rnd(H.nll_at(weighted_emb(t), [], "logits", "y", "w", TS), ["log_t"], "nll")


@query("fit_temperature", f"""WITH {EMB}, {EW}, {TS_SQL}, {NLL}, g AS (SELECT log_t, sum(w*l)/sum(w) AS nll FROM loss GROUP BY log_t), r AS (SELECT *, row_number() OVER (ORDER BY round(nll,10), log_t) AS rn FROM g)
 SELECT log_t, {r6('exp(log_t)')} AS temperature, {r6('nll')} AS nll FROM r WHERE rn=1""")
def fit_temperature(t):
    return rnd(H.fit_temperature(weighted_emb(t), [], "logits", "y", "w"), ["log_t"], "temperature", "nll")


def _brackets(rounds: int) -> str:
    """The smallest loss by brackets that shrink tenfold: each round looks at the points around the last round's best."""
    out, points = [], "t0 AS (SELECT source, -3+0.25e0*i AS log_t FROM (SELECT DISTINCT source FROM wemb) s, range(25) r(i))"
    for n in range(rounds):
        if n:
            points = f"t{n} AS (SELECT source, log_t+(i-10)*{0.25 / 10**n!r}::DOUBLE AS log_t FROM b{n - 1}, range(21) r(i))"
        out.append(f"""{points}, x{n} AS (SELECT e.source, y, w, log_t, list_transform(logits, lambda v: exp((v-list_max(logits))/exp(log_t))) AS ex FROM wemb e JOIN t{n} USING (source)),
 g{n} AS (SELECT source, log_t, round(sum(-w*ln(greatest(1e-12, least(1.0e0, CASE WHEN y>=0 THEN ex[greatest(y,0)+1]/list_sum(ex) ELSE 1-ex[1]/list_sum(ex) END))))/sum(w), 13) AS nll FROM x{n} GROUP BY source, log_t),
 b{n} AS (SELECT source, log_t, nll FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY nll, log_t) AS rn FROM g{n}) WHERE rn=1)""")
    return ", ".join(out)


@query("fit_temperature_fine", f"""WITH {EMB}, {EW}, {_brackets(6)} SELECT source, round(log_t, 4) AS log_t, {r6('nll')} AS nll FROM b5""")
def fit_temperature_fine(t):
    """Continuous temperature per source: log T to 1e-5 by shrinking brackets, reported to four digits."""
    f = H.minimise_temperature(weighted_emb(t), ["source"], "logits", "y", "w")
    return f.select("source", F.round("log_t", 4).alias("log_t"), fn.r6("nll").alias("nll"))


_BIN = """bx AS (SELECT source, kind, w, greatest(1-p_good, p_good) AS conf, (1-p_good >= 0.5e0) = (defect=1) AS ok FROM ws), th AS (SELECT round(0.5e0+0.01e0*i, 2) AS threshold FROM range(51) r(i))"""
_CURVE = """curve AS (SELECT kind, threshold, sum(CASE WHEN conf >= threshold-1e-12 THEN w ELSE 0 END)/sum(w) AS coverage, count(*) FILTER (WHERE conf >= threshold-1e-12) AS answered,
 sum(w) FILTER (WHERE ok AND conf >= threshold-1e-12) AS k, sum(w) FILTER (WHERE conf >= threshold-1e-12) AS a FROM bx, th GROUP BY kind, threshold)"""


def binary_curve(t, keys):
    pred, conf = M.binary_view("p_good")
    return H.coverage_curve(weighted_scores(t), keys, conf, pred == (F.col("defect") == 1), F.col("w"))


@query("coverage_curve", f"""WITH {SCORES}, {WTS}, {_BIN}, {_CURVE} SELECT kind, threshold, {r6('coverage')} AS coverage, answered, {r6('CASE WHEN answered > 0 THEN coalesce(k,0)/a END')} AS accuracy FROM curve""")
def coverage_curve(t):
    return rnd(binary_curve(t, ["kind"]), ["kind", "threshold", "answered"], "coverage", "accuracy")


@query("coverage_curve_top1", f"""WITH {EMBP}, th AS (SELECT round(0.2e0+0.01e0*i, 2) AS threshold FROM range(81) r(i)), x AS (SELECT source, conf, {OK} AS ok FROM ep)
 SELECT source, threshold, count(*) FILTER (WHERE conf >= threshold-1e-12) AS answered, {r6('count(*) FILTER (WHERE conf >= threshold-1e-12)/CAST(count(*) AS DOUBLE)')} AS coverage,
 {r6('count(*) FILTER (WHERE ok AND conf >= threshold-1e-12)/nullif(CAST(count(*) FILTER (WHERE conf >= threshold-1e-12) AS DOUBLE),0)')} AS accuracy FROM x, th GROUP BY source, threshold""")
def coverage_curve_top1(t):
    c = H.coverage_curve(emb_probs(t), ["source"], F.col("conf"), M.correct_typed("pred", "y"), values=H.PLAIN_CURVE)
    return rnd(c, ["source", "threshold", "answered"], "coverage", "accuracy")


TARGET_DEMO = 0.5


def _pick_sql(target):
    return f"""okc AS (SELECT *, k/a AS acc FROM curve WHERE answered >= 30 AND a > 0), sx AS (SELECT *, min(coalesce(acc,0)) OVER (PARTITION BY kind ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM okc),
 st AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY threshold) AS rn FROM sx WHERE worst >= {target}e0)"""


@query("pick_threshold", f"""WITH {SCORES}, {WTS}, {_BIN}, {_CURVE}, {_pick_sql(0.9)} SELECT g.kind, threshold, {r6('coverage')} AS coverage, answered, {r6('acc')} AS accuracy FROM (SELECT DISTINCT kind FROM curve) g LEFT JOIN (SELECT * FROM st WHERE rn=1) s USING (kind)""")
def pick_threshold(t):
    return rnd(H.pick_threshold(binary_curve(t, ["kind"]), ["kind"]), ["kind", "threshold", "answered"], "coverage", "accuracy")


@query("pick_perclass", f"""WITH {SCORES}, {WTS}, bx AS (SELECT 'good' AS kind, w, p_good AS conf, defect=0 AS ok FROM ws UNION ALL SELECT 'defect', w, 1-p_good, defect=1 FROM ws), th AS (SELECT round(0.5e0+0.01e0*i, 2) AS threshold FROM range(51) r(i)),
 {_CURVE}, {_pick_sql(TARGET_DEMO)} SELECT g.kind AS call, threshold, answered, {r6('acc')} AS precision FROM (SELECT DISTINCT kind FROM curve) g LEFT JOIN (SELECT * FROM st WHERE rn=1) s USING (kind)""")
def pick_perclass(t):
    """Lowest stable threshold of each call, by the precision of that call (target .5 on this data)."""
    s = weighted_scores(t)
    sides = F.explode(F.array(
        F.struct(F.lit("good").alias("call"), F.col("p_good").alias("conf"), (F.col("defect") == 0).alias("ok")),
        F.struct(F.lit("defect").alias("call"), (1 - F.col("p_good")).alias("conf"), (F.col("defect") == 1).alias("ok"))))
    x = s.select("w", sides.alias("s")).select("w", "s.*")
    c = H.coverage_curve(x, ["call"], F.col("conf"), F.col("ok"), F.col("w"))
    p = H.pick_threshold(c, ["call"], target=TARGET_DEMO)
    return p.select("call", "threshold", "answered", fn.r6("accuracy").alias("precision"))


@query("pick_pair", f"""WITH {SCORES}, {WTS}, g AS (SELECT round(0.5e0+0.02e0*i,2) AS tg FROM range(23) r(i)), d AS (SELECT round(0.5e0+0.01e0*i,2) AS td FROM range(50) r(i)),
 rw AS (SELECT tg, td, count(*) FILTER (WHERE p_good >= tg OR 1-p_good >= td) AS answered, coalesce(sum(w) FILTER (WHERE p_good >= tg OR 1-p_good >= td),0) AS wa, coalesce(sum(w) FILTER (WHERE (p_good >= tg AND defect=0) OR (1-p_good >= td AND defect=1)),0) AS wk, sum(w) AS al
   FROM ws, g, d GROUP BY tg, td), ok AS (SELECT tg, td, answered, wk/wa AS acc, round(wa/al,9) AS cov FROM rw WHERE answered >= 30 AND wa > 0),
 sx AS (SELECT *, min(acc) OVER (PARTITION BY tg ORDER BY td ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS worst FROM ok), fi AS (SELECT *, row_number() OVER (PARTITION BY tg ORDER BY td) AS rn FROM sx WHERE worst >= {TARGET_DEMO}e0),
 be AS (SELECT *, row_number() OVER (ORDER BY cov DESC, tg) AS rb FROM fi WHERE rn=1) SELECT tg AS t_good, td AS t_defect, answered, {r6('acc')} AS accuracy, {r6('cov')} AS coverage FROM be WHERE rb=1""")
def pick_pair(t):
    return rnd(H.pick_pair(weighted_scores(t), [], "p_good", "defect", "w", target=TARGET_DEMO), ["t_good", "t_defect", "answered"], "accuracy", "coverage")


@query("loo_parameters", f"""WITH {EMB}, {EW}, {TS_SQL}, {NLL}, s AS (SELECT source, log_t, sum(w*l) AS wl, sum(w) AS w FROM loss GROUP BY source, log_t),
 o AS (SELECT h.source AS held_out, s.log_t, sum(s.wl)/sum(s.w) AS nll FROM (SELECT DISTINCT source FROM s) h JOIN s ON s.source <> h.source GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY round(nll,10), log_t) AS rn FROM o),
 tt AS (SELECT held_out, log_t, nll FROM b WHERE rn=1), x AS (SELECT held_out, w, y, source, list_transform(logits, lambda x: exp((x-list_max(logits))/exp(log_t))) AS ex FROM wemb JOIN tt ON source <> held_out),
 p AS (SELECT held_out, w, 1-ex[1]/list_sum(ex) AS pd, y<>0 AS d FROM x), th AS (SELECT round(0.5e0+0.01e0*i, 2) AS threshold FROM range(51) r(i)), bx AS (SELECT held_out AS kind, w, greatest(pd,1-pd) AS conf, (pd >= 0.5e0)=d AS ok FROM p),
 {_CURVE}, {_pick_sql(0.49)} SELECT tt.held_out, log_t, {r6('nll')} AS nll, threshold, answered FROM tt LEFT JOIN (SELECT * FROM st WHERE rn=1) s ON tt.held_out=s.kind""")
def loo_parameters(t):
    """Temperature and threshold for every source, fitted on all the other sources.

    The loss is additive, so the others' loss is the total minus the source's own: no row is repeated for it.
    The threshold depends on that temperature, so each row is counted once per other source, map-side.
    """
    e = weighted_emb(t)
    x = e.withColumn("log_t", F.explode(F.array(*[F.lit(v) for v in TS])))
    own = x.groupBy("source", "log_t").agg(F.sum(F.col("w") * H.row_nll("logits", "y", F.exp("log_t"))).alias("wl"), F.sum("w").alias("sw"))
    total = own.groupBy("log_t").agg(F.sum("wl").alias("twl"), F.sum("sw").alias("tsw"))
    loo = own.join(total, "log_t").select("source", "log_t", ((F.col("twl") - F.col("wl")) / (F.col("tsw") - F.col("sw"))).alias("nll"))
    fit = loo.groupBy("source").agg(F.min_by(F.struct("log_t", "nll"), F.struct(F.round("nll", 10), F.col("log_t"))).alias("b"))
    fit = fit.select(F.col("source").alias("held_out"), "b.log_t", "b.nll")
    table = fit.agg(F.collect_list(F.struct("held_out", "log_t")).alias("f"))  # one short struct per source
    others = e.select("source", "w", "y", "logits", F.explode(table.scalar()).alias("f")).where(F.col("f.held_out") != F.col("source"))
    p = others.select("f.held_out", "w", (F.col("y") != 0).alias("d"), (1 - F.get(fn.softmax("logits", F.exp("f.log_t")), F.lit(0))).alias("pd"))
    curve = H.coverage_curve(p, ["held_out"], F.greatest("pd", 1 - F.col("pd")), (F.col("pd") >= 0.5) == F.col("d"), F.col("w"))
    pick = H.pick_threshold(curve, ["held_out"], target=0.49).select("held_out", "threshold", "answered")
    return fit.join(pick, "held_out", "left").select("held_out", "log_t", fn.r6("nll").alias("nll"), "threshold", "answered")


@query("softmax_t", f"""WITH {EMB}, x AS (SELECT vec_id, list_transform(logits, lambda x: exp((x-list_max(logits))/2.046e0)) AS ex FROM emb) SELECT vec_id, {', '.join(f'{r6(f"ex[{i + 1}]/list_sum(ex)")} AS p{i}' for i in range(6))} FROM x""")
def softmax_t(t):
    e = t.emb().select("vec_id", fn.softmax("logits", 2.046).alias("p"))
    return e.select("vec_id", *[fn.r6(F.get("p", i)).alias(f"p{i}") for i in range(6)])


@query("retemper", f"""WITH {EMB}, z AS (SELECT vec_id, list_transform(p, lambda x: ln(greatest(1e-12, least(1.0e0, x)))*2.046e0) AS z FROM emb), x AS (SELECT vec_id, list_transform(z, lambda x: exp((x-list_max(z))/1.3e0)) AS ex FROM z)
 SELECT vec_id, {r6('list_max(ex)/list_sum(ex)')} AS top, {r6('ex[1]/list_sum(ex)')} AS p_good FROM x""")
def retemper(t):
    e = t.emb().select("vec_id", fn.softmax("logits").alias("p")).select("vec_id", fn.retemper("p", 2.046, 1.3).alias("q"))
    return e.select("vec_id", fn.r6(F.array_max("q")).alias("top"), fn.r6(F.get("q", 0)).alias("p_good"))


@query("energy", f"WITH {EMB} SELECT vec_id, {r6('-(list_max(logits)+ln(list_sum(list_transform(logits, lambda x: exp(x-list_max(logits))))))')} AS energy FROM emb")
def energy(t):
    return t.emb().select("vec_id", fn.r6(fn.energy("logits")).alias("energy"))


HAND = ["area", "elong", "solidity", "fill"]


@query("best_stump", f"""WITH {ITEMS}, f AS (SELECT code=1 AS pos, unnest(['{"','".join(HAND)}']) AS feature, unnest([area, elong, solidity, fill]) AS v FROM items),
 q AS (SELECT feature, quantile_cont(v, [{', '.join(repr(0.01 + 0.98 * i / 196) + 'e0' if 'e' not in repr(0.01 + 0.98 * i / 196) else repr(0.01 + 0.98 * i / 196) for i in range(197))}]) AS qs FROM f GROUP BY feature),
 cut AS (SELECT DISTINCT feature, unnest(qs) AS cut FROM q), tot AS (SELECT feature, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM f GROUP BY feature),
 fv AS (SELECT feature, v, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM f GROUP BY feature, v),
 s AS (SELECT c.feature, c.cut, sum(fv.p) FILTER (WHERE v < cut) AS pb, sum(fv.n) FILTER (WHERE v < cut) AS nb, sum(fv.p) FILTER (WHERE v > cut) AS pa, sum(fv.n) FILTER (WHERE v > cut) AS na FROM cut c JOIN fv ON c.feature=fv.feature GROUP BY c.feature, c.cut),
 sc AS (SELECT feature, cut, 1 AS direction, 0.5e0*(coalesce(pb,0)/CAST(p AS DOUBLE)+1-coalesce(nb,0)/CAST(n AS DOUBLE)) AS score FROM s JOIN tot USING (feature) UNION ALL SELECT feature, cut, -1, 0.5e0*(coalesce(pa,0)/CAST(p AS DOUBLE)+1-coalesce(na,0)/CAST(n AS DOUBLE)) FROM s JOIN tot USING (feature))
 SELECT feature, {r6('max(score)')} AS score, count(*) AS rules FROM sc GROUP BY feature""")
def best_stump(t):
    """Best one-feature rule per feature (balanced accuracy) over its percentile cuts and both directions."""
    s = H.best_stump(t.items(), {h: F.col(h) for h in HAND}, F.col("code") == 1)
    return s.groupBy("feature").agg(fn.r6(F.max("score")).alias("score"), F.count(F.lit(1)).alias("rules"))


@query("stump_held_out", f"""WITH {ITEMS}, f AS (SELECT code=1 AS pos, unnest(['{"','".join(HAND)}']) AS feature, unnest([area, elong, solidity, fill]) AS v FROM items WHERE source <> 5),
 q AS (SELECT feature, quantile_cont(v, [{', '.join(repr(0.01 + 0.98 * i / 196) + 'e0' if 'e' not in repr(0.01 + 0.98 * i / 196) else repr(0.01 + 0.98 * i / 196) for i in range(197))}]) AS qs FROM f GROUP BY feature),
 cut AS (SELECT DISTINCT feature, unnest(qs) AS cut FROM q), tot AS (SELECT feature, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM f GROUP BY feature),
 fv AS (SELECT feature, v, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS n FROM f GROUP BY feature, v),
 s AS (SELECT c.feature, c.cut, sum(fv.p) FILTER (WHERE v < cut) AS pb, sum(fv.n) FILTER (WHERE v < cut) AS nb, sum(fv.p) FILTER (WHERE v > cut) AS pa, sum(fv.n) FILTER (WHERE v > cut) AS na FROM cut c JOIN fv ON c.feature=fv.feature GROUP BY c.feature, c.cut),
 sc AS (SELECT feature, cut, 1 AS direction, 0.5e0*(coalesce(pb,0)/CAST(p AS DOUBLE)+1-coalesce(nb,0)/CAST(n AS DOUBLE)) AS score FROM s JOIN tot USING (feature) UNION ALL SELECT feature, cut, -1, 0.5e0*(coalesce(pa,0)/CAST(p AS DOUBLE)+1-coalesce(na,0)/CAST(n AS DOUBLE)) FROM s JOIN tot USING (feature))
, best AS (SELECT * FROM sc ORDER BY round(score, 12) DESC, feature, cut, direction DESC LIMIT 1),
 held AS (SELECT code=1 AS pos, CASE b.feature WHEN 'area' THEN area WHEN 'elong' THEN elong WHEN 'solidity' THEN solidity ELSE fill END AS v, b.* FROM items, best b WHERE source = 5),
 said AS (SELECT *, CASE WHEN direction=1 THEN v < cut ELSE v > cut END AS yes FROM held)
 SELECT feature, {r6('max(cut)')} AS cut, direction, count(*) AS n, count(*) FILTER (WHERE pos AND yes) AS hits, count(*) FILTER (WHERE NOT pos AND yes) AS false_alarms, count(*) FILTER (WHERE pos) AS positives FROM said GROUP BY feature, direction""")
def stump_held_out(t):
    """The best single-feature rule of all other sources, applied to the source that was held out."""
    items, cols, pos = t.items(), {h: F.col(h) for h in HAND}, F.col("code") == 1
    rule = H.pick_stump(H.best_stump(items.where("source <> 5"), cols, pos))
    said = H.apply_stump(items.where("source = 5"), rule, cols)
    n = said.agg(F.count(F.lit(1)).alias("n"), F.count_if(pos & F.col("stump")).alias("hits"), F.count_if(~pos & F.col("stump")).alias("false_alarms"), F.count_if(pos).alias("positives"))
    r = rule.select(F.struct("feature", "cut", "direction").alias("r")).scalar()
    return n.select(r["feature"].alias("feature"), fn.r6(r["cut"]).alias("cut"), r["direction"].alias("direction"), "n", "hits", "false_alarms", "positives")
