"""Held-out metrics: confusion, calibration, coverage, ranks, operating points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import exact_quantiles
from lotwise.operators import calls as K
from lotwise.operators import metrics as M
from lotwise.operators.splits import cell_weights
from lotwise.plans.registry import query
from lotwise.plans.sqltext import EMB, ITEMS, LOTS, SCORES, r6

EMBP = EMB + """, ep AS (SELECT *, list_position(p, list_max(p)) - 1 AS pred, list_max(p) AS conf, 1-p[1] >= 0.5e0 AS pd FROM emb)"""
OK = "CASE WHEN y >= 0 THEN pred = y ELSE pred <> 0 END"


def emb_probs(t):
    return t.emb().withColumn("p", fn.softmax("logits")).withColumn("pred", fn.argmax("p")).withColumn("conf", F.array_max("p"))


def rnd(df, keys, *cols):
    return df.select(*keys, *[fn.r6(c).alias(c) for c in cols])


@query("confusion", f"""WITH {EMBP}, c AS (SELECT y, pred, CASE WHEN y>=0 THEN -ln(greatest(1e-12, p[greatest(y,0)+1])) END AS nll, {OK} AS ok FROM ep)
 SELECT y, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE pred={i}) AS c{i}' for i in range(6))}, {r6('avg(CASE WHEN ok THEN 1.0e0 ELSE 0.0e0 END)')} AS recall, {r6('avg(nll)')} AS nll FROM c GROUP BY GROUPING SETS ((y), ())""")
def confusion(t):
    """Per class and over all (y NULL): counts per predicted class, recall, mean loss of the typed rows."""
    e = emb_probs(t)
    nll = F.when(F.col("y") >= 0, -F.log(F.greatest(F.lit(1e-12), F.get("p", F.greatest(F.col("y"), F.lit(0))))))
    return e.withColumn("nll", nll).groupingSets([["y"], []], "y").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("pred") == i).alias(f"c{i}") for i in range(6)],
        fn.r6(M.share(M.correct_typed("pred", "y"))).alias("recall"), fn.r6(F.avg("nll")).alias("nll"))


@query("kind_summary", f"""WITH {EMBP}, cell AS (SELECT source, y, count(*) AS n, count(*) FILTER (WHERE {OK}) AS hit, count(*) FILTER (WHERE pd) AS pd FROM ep GROUP BY source, y),
 s AS (SELECT source, CAST(sum(n) AS BIGINT) AS rows, count(*) AS kinds_present, avg(CAST(hit AS DOUBLE)/n) AS macro_accuracy, CAST(sum(hit) AS DOUBLE)/sum(n) AS accuracy_rows,
  sum(n-pd) FILTER (WHERE y=0)/CAST(sum(n) FILTER (WHERE y=0) AS DOUBLE) AS good_recall, sum(pd) FILTER (WHERE y<>0)/CAST(sum(n) FILTER (WHERE y<>0) AS DOUBLE) AS defect_recall,
  sum(CASE WHEN y<>0 THEN pd ELSE n-pd END)/CAST(sum(n) AS DOUBLE) AS binary_accuracy FROM cell GROUP BY source)
 SELECT source, rows, kinds_present, {', '.join(f'{r6(c)} AS {c}' for c in ('macro_accuracy', 'accuracy_rows', 'good_recall', 'defect_recall', 'binary_accuracy'))},
 {r6('(coalesce(good_recall,0)+coalesce(defect_recall,0))/nullif((good_recall IS NOT NULL)::INT+(defect_recall IS NOT NULL)::INT,0)')} AS balanced_accuracy FROM s""")
def kind_summary(t):
    e = t.emb().withColumn("p", fn.softmax("logits"))
    return rnd(M.kind_summary(e, ["source"], "y", "p"), ["source", "rows", "kinds_present"],
               "macro_accuracy", "accuracy_rows", "good_recall", "defect_recall", "binary_accuracy", "balanced_accuracy")


BACC = ("sensitivity", "fpr", "photo_sensitivity", "photo_fpr", "balanced", "photo_balanced")


@query("balanced_accuracy", f"""WITH {SCORES}, per AS (SELECT source, "user", kind, defect=1 AS tr, count(*) AS n, count(*) FILTER (WHERE p_good < 0.5e0) AS k FROM scores GROUP BY ALL),
 s AS (SELECT source, CAST(sum(n) FILTER (WHERE tr) AS BIGINT) AS n_pos, CAST(sum(n) FILTER (WHERE NOT tr) AS BIGINT) AS n_neg, sum(k) FILTER (WHERE tr)/CAST(sum(n) FILTER (WHERE tr) AS DOUBLE) AS sensitivity,
  sum(k) FILTER (WHERE NOT tr)/CAST(sum(n) FILTER (WHERE NOT tr) AS DOUBLE) AS fpr, avg(k/CAST(n AS DOUBLE)) FILTER (WHERE tr) AS photo_sensitivity, avg(k/CAST(n AS DOUBLE)) FILTER (WHERE NOT tr) AS photo_fpr FROM per GROUP BY source)
 SELECT source, n_pos, n_neg, {', '.join(f'{r6(c)} AS {c}' for c in BACC[:4])}, {r6('0.5e0*(sensitivity+1-fpr)')} AS balanced, {r6('0.5e0*(photo_sensitivity+1-photo_fpr)')} AS photo_balanced FROM s""")
def balanced_accuracy(t):
    s = t.scores().withColumns({"truth": F.col("defect") == 1, "pred": F.col("p_good") < 0.5})
    return rnd(M.balanced_accuracy(s, ["source"], ["user", "kind"], "truth", "pred"), ["source", "n_pos", "n_neg"], *BACC)


@query("ece_top1", f"""WITH {EMBP}, b AS (SELECT source, CASE WHEN conf > 0 THEN ceil(conf*10) END AS bin, conf, {OK} AS ok FROM ep),
 g AS (SELECT source, bin, count(*) AS n, sum(conf) AS c, count(*) FILTER (WHERE ok) AS k FROM b GROUP BY source, bin) SELECT source, {r6('sum(abs(k-c))/sum(n)')} AS ece FROM g GROUP BY source""")
def ece_top1(t):
    c = F.col("conf")
    return rnd(M.calibration_error(emb_probs(t), ["source"], c, M.correct_typed("pred", "y"), F.lit(1.0), M.top1_bin(c)), ["source"], "ece")


WTS = """cells AS (SELECT source, defect, count(*) AS n FROM scores GROUP BY source, defect), wc AS (SELECT *, 1.0e0/(n*count(*) OVER (PARTITION BY source)) AS w FROM cells),
 ws AS (SELECT s.*, wc.w FROM scores s JOIN wc USING (source, defect))"""


def weighted_scores(t):
    return cell_weights(t.scores(), "source", "defect")


@query("ece_binary", f"""WITH {SCORES}, {WTS}, x AS (SELECT kind, w, greatest(p_good, 1-p_good) AS c, CASE WHEN (1-p_good >= 0.5e0) = (defect=1) THEN 1.0e0 ELSE 0.0e0 END AS k FROM ws),
 g AS (SELECT kind, greatest(1, ceil((c-0.5e0)*20)) AS bin, sum(w) AS w, sum(w*c) AS c, sum(w*k) AS k FROM x GROUP BY kind, bin) SELECT kind, {r6('sum(abs(k-c))/sum(w)')} AS ece FROM g GROUP BY kind""")
def ece_binary(t):
    s = weighted_scores(t)
    pred, conf = M.binary_view("p_good")
    return rnd(M.calibration_error(s, ["kind"], conf, pred == (F.col("defect") == 1), F.col("w"), M.binary_bin(conf)), ["kind"], "ece")


@query("balanced_weights", f"WITH {SCORES}, {WTS} SELECT source, defect, count(*) AS n, (round(max(w),12)+0.0e0) AS w, {r6('sum(w)')} AS total FROM ws GROUP BY source, defect")
def balanced_weights(t):
    return weighted_scores(t).groupBy("source", "defect").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 12).alias("w"), fn.r6(F.sum("w")).alias("total"))


OPC = ("coverage", "answered_accuracy", "good_called_good", "good_called_defect", "defect_called_good", "defect_called_defect")
CODED = f"coded AS (SELECT *, CASE WHEN p_good >= 0.55e0 THEN 0 WHEN 1-p_good >= 0.91e0 THEN 1 ELSE 2 END AS code FROM scores)"


@query("operating_point", f"""WITH {SCORES}, {CODED} SELECT source, kind, count(*) AS n, {r6('avg((code<>2)::INT)')} AS coverage, {r6('avg((code=defect)::INT) FILTER (WHERE code<>2)')} AS answered_accuracy,
 {r6('avg((code=0)::INT) FILTER (WHERE defect=0)')} AS good_called_good, {r6('avg((code=1)::INT) FILTER (WHERE defect=0)')} AS good_called_defect,
 {r6('avg((code=0)::INT) FILTER (WHERE defect=1)')} AS defect_called_good, {r6('avg((code=1)::INT) FILTER (WHERE defect=1)')} AS defect_called_defect FROM coded GROUP BY GROUPING SETS ((source, kind), (source), ())""")
def operating_point(t):
    """Per source and kind, per source, and over all; one pre-aggregation feeds every level."""
    s = t.scores().withColumn("code", K.call_pair("p_good"))
    base = s.groupBy("source", "kind", "defect", "code").agg(F.count(F.lit(1)).alias("n"))
    d, c, n = F.col("defect") == 1, F.col("code"), F.col("n")
    rate = lambda hit, of: fn.ratio(F.sum(F.when(of & hit, n).otherwise(0)), F.sum(F.when(of, n)))
    every = F.lit(True)
    out = base.groupingSets([["source", "kind"], ["source"], []], "source", "kind").agg(
        F.sum("n").alias("n"), rate(c != 2, every).alias("coverage"), rate(c == F.col("defect"), c != 2).alias("answered_accuracy"),
        rate(c == 0, ~d).alias("good_called_good"), rate(c == 1, ~d).alias("good_called_defect"),
        rate(c == 0, d).alias("defect_called_good"), rate(c == 1, d).alias("defect_called_defect"))
    return rnd(out, ["source", "kind", "n"], *OPC)


@query("bean_metrics", f"""WITH {SCORES}, {CODED}, cell AS (SELECT source, count(*) FILTER (WHERE defect=0) AS n0, count(*) FILTER (WHERE defect=1) AS n1, count(*) FILTER (WHERE defect=0 AND code<>2) AS a0, count(*) FILTER (WHERE defect=1 AND code<>2) AS a1,
 count(*) FILTER (WHERE defect=0 AND code=0) AS k0, count(*) FILTER (WHERE defect=1 AND code=1) AS k1 FROM coded GROUP BY source)
 SELECT source, n0 AS n_good, n1 AS n_defect, {r6('(0.5e0*a0/greatest(n0,1)+0.5e0*a1/greatest(n1,1))/(0.5e0*n0/greatest(n0,1)+0.5e0*n1/greatest(n1,1))')} AS coverage_balanced,
 {r6('(0.5e0*k0/greatest(n0,1)+0.5e0*k1/greatest(n1,1))/nullif(0.5e0*a0/greatest(n0,1)+0.5e0*a1/greatest(n1,1),0)')} AS accuracy_balanced, {r6('(a0+a1)/CAST(n0+n1 AS DOUBLE)')} AS coverage_plain,
 {r6('(k0+k1)/nullif(CAST(a0+a1 AS DOUBLE),0)')} AS accuracy_plain FROM cell""")
def item_metrics(t):
    s = t.scores().withColumn("code", K.call_pair("p_good"))
    return rnd(M.item_metrics(s, ["source"], "code", "defect"), ["source", "n_good", "n_defect"],
               "coverage_balanced", "accuracy_balanced", "coverage_plain", "accuracy_plain")


@query("auroc", f"""WITH {SCORES}, r AS (SELECT source, defect, rank() OVER (PARTITION BY source ORDER BY value) + (count(*) OVER (PARTITION BY source, value) - 1)/2.0e0 AS rk FROM scores),
 s AS (SELECT source, count(*) FILTER (WHERE defect=1) AS n_pos, count(*) FILTER (WHERE defect=0) AS n_neg, sum(rk) FILTER (WHERE defect=1) AS r FROM r GROUP BY source)
 SELECT source, n_pos, n_neg, {r6('(r - n_pos*(n_pos+1)/2.0e0)/(CAST(n_pos AS DOUBLE)*n_neg)')} AS auroc FROM s""")
def auroc(t):
    s = t.scores().withColumn("pos", F.col("defect") == 1)
    return rnd(M.auroc(s, ["source"], "value", "pos"), ["source", "n_pos", "n_neg"], "auroc")


GRADES = ["click", "view", "purchase", "signup", "error"]


@query("spearman_by_grade", f"""WITH RECURSIVE {SCORES}, ph AS (SELECT source, "user", kind, list_position(['click','view','purchase','signup','error'], kind)-1 AS grade, avg(CASE WHEN p_good < 0.5e0 THEN 1.0e0 ELSE 0.0e0 END) AS share FROM scores GROUP BY source, "user", kind),
 ph2 AS (SELECT *, round(share, 9) AS sh FROM ph), r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY grade)+(count(*) OVER (PARTITION BY source, grade)-1)/2.0e0 AS ra, rank() OVER (PARTITION BY source ORDER BY sh)+(count(*) OVER (PARTITION BY source, sh)-1)/2.0e0 AS rb FROM ph2),
 s AS (SELECT source, count(*) AS n, corr(ra, rb) AS rho FROM r GROUP BY source),
 tt AS (SELECT *, CASE WHEN abs(rho)<1 THEN rho*sqrt((n-2)/(1-rho*rho)) END AS t FROM s), ab AS (SELECT *, (n-2)/2.0e0 AS a0, (n-2)/(n-2+t*t) AS x0 FROM tt),
 sd AS (SELECT *, x0 < (a0+1)/(a0+2.5e0) AS low, lgamma(a0+0.5e0)-lgamma(a0)-lgamma(0.5e0)+a0*ln(x0)+0.5e0*ln(1-x0) AS lf FROM ab),
 pr AS (SELECT *, CASE WHEN low THEN a0 ELSE 0.5e0 END AS a, CASE WHEN low THEN 0.5e0 ELSE a0 END AS b, CASE WHEN low THEN x0 ELSE 1-x0 END AS x FROM sd),
 cf AS (SELECT source, 1 AS k, 1.0e0 AS c, 0.0e0 AS d, 1.0e0 AS g FROM pr UNION ALL SELECT source, k+1, c, d, g*c*d FROM (
  SELECT source, k, g, 1+w/c AS c, 1/(1+w*d) AS d FROM (SELECT cf.*, CASE WHEN k%2=0 THEN (k//2)*(b-k//2)*x/((a+2*(k//2)-1)*(a+2*(k//2))) ELSE -(a+k//2)*(a+b+k//2)*x/((a+2*(k//2))*(a+2*(k//2)+1)) END AS w FROM cf JOIN pr USING (source) WHERE k <= 400)))
 SELECT source, n, {r6('rho')} AS rho, {r6('t')} AS t, {r6('CASE WHEN abs(rho)>=1 AND n>2 THEN 0 WHEN low THEN exp(lf)/g/a ELSE 1-exp(lf)/g/a END')} AS p FROM pr LEFT JOIN (SELECT source, g FROM cf WHERE k = 401) USING (source)""")
def spearman_by_grade(t):
    order = F.array(*[F.lit(g) for g in GRADES])
    ph = t.scores().groupBy("source", "user", "kind").agg(F.avg(F.when(F.col("p_good") < 0.5, 1.0).otherwise(0.0)).alias("share"))
    ph = ph.select("source", (F.array_position(order, F.col("kind")) - 1).cast("double").alias("grade"), F.round("share", 9).alias("sh"))
    return rnd(M.spearman(ph, ["source"], "grade", "sh"), ["source", "n"], "rho", "t", "p")


@query("grade_medians", f"""WITH {SCORES} SELECT kind, count(*) AS n, {r6('median(value)')} AS med, {r6('quantile_cont(value,0.1)')} AS p10, {r6('quantile_cont(value,0.9)')} AS p90 FROM scores GROUP BY kind""")
def grade_medians(t):
    s = t.scores()
    q = exact_quantiles(s, ["kind"], "value", {"med": 0.5, "p10": 0.1, "p90": 0.9})
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).join(q, "kind").select("kind", "n", *[fn.r6(c).alias(c) for c in ("med", "p10", "p90")])


@query("share_table", f"""WITH {SCORES}, {CODED} SELECT kind, count(DISTINCT "user") AS photos, count(*) AS items, {r6('avg((code=0)::INT)')} AS good, {r6('avg((code=1)::INT)')} AS defect, {r6('avg((code=2)::INT)')} AS unsure,
 {r6('avg((p_good < 0.5e0)::INT)')} AS argmax_defect, {r6('count(*) FILTER (WHERE code=1)/CAST(greatest(1, count(*) FILTER (WHERE code<>2)) AS DOUBLE)')} AS defect_of_answered, {r6('median(greatest(p_good,1-p_good))')} AS median_conf
 FROM coded GROUP BY GROUPING SETS ((kind), ())""")
def share_table(t):
    """Called and argmax shares per grade and over all."""
    s = t.scores().withColumn("code", K.call_pair("p_good")).withColumn("conf", F.greatest("p_good", 1 - F.col("p_good")))
    cells = s.groupBy("kind", "user", "code", (F.col("p_good") < 0.5).alias("am")).agg(F.count(F.lit(1)).alias("n"))
    n, c = F.col("n"), F.col("code")
    part = lambda cond: F.sum(F.when(cond, n).otherwise(0)) / F.sum("n")
    agg = cells.groupingSets([["kind"], []], "kind").agg(
        F.countDistinct("user").alias("photos"), F.sum("n").alias("items"), part(c == 0).alias("good"), part(c == 1).alias("defect"), part(c == 2).alias("unsure"),
        part(F.col("am")).alias("argmax_defect"),
        (F.sum(F.when(c == 1, n).otherwise(0)) / F.greatest(F.lit(1), F.sum(F.when(c != 2, n).otherwise(0)))).alias("defect_of_answered"))
    q = exact_quantiles(s, ["kind"], "conf", {"median_conf": 0.5}).unionByName(exact_quantiles(s, [], "conf", {"median_conf": 0.5}).withColumn("kind", F.lit(None).cast("string")))
    out = agg.join(q.withColumnRenamed("kind", "_k"), F.col("kind").eqNullSafe(F.col("_k"))).drop("_k")
    return rnd(out, ["kind", "photos", "items"], "good", "defect", "unsure", "argmax_defect", "defect_of_answered", "median_conf")


SWEEP = [0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9]


@query("photo_rule_sweep", f"""WITH {SCORES}, th AS (SELECT unnest([{', '.join(f'{v}e0' for v in SWEEP)}]) AS t), x AS (SELECT t, "user", greatest(p_good,1-p_good) AS c, (1-p_good >= 0.5e0) = (defect=1) AS ok FROM scores, th),
 ph AS (SELECT t, "user", count(*) AS n, count(*) FILTER (WHERE c >= t) AS a, count(*) FILTER (WHERE c >= t AND ok) AS k FROM x GROUP BY t, "user")
 SELECT t AS threshold, {r6('sum(a)/CAST(sum(n) AS DOUBLE)')} AS coverage, {r6('sum(k)/nullif(CAST(sum(a) AS DOUBLE),0)')} AS accuracy, {r6('avg(((n-a)/CAST(n AS DOUBLE) > 0.15e0)::INT)')} AS photos_refused FROM ph GROUP BY t""")
def photo_rule_sweep(t):
    """For every threshold: photos where more than 15 % of the items are below it, next to coverage and accuracy."""
    pred, conf = M.binary_view("p_good")
    s = t.scores().select("user", conf.alias("c"), (pred == (F.col("defect") == 1)).alias("ok"))
    cols = []
    for i, v in enumerate(SWEEP):  # one pass: two counters per threshold instead of rows x thresholds
        cols += [F.count_if(F.col("c") >= v).alias(f"a{i}"), F.count_if((F.col("c") >= v) & F.col("ok")).alias(f"k{i}")]
    ph = s.groupBy("user").agg(F.count(F.lit(1)).alias("n"), *cols)
    long = ph.select("n", F.explode(F.array(*[F.struct(F.lit(v).alias("threshold"), F.col(f"a{i}").alias("a"), F.col(f"k{i}").alias("k")) for i, v in enumerate(SWEEP)])).alias("s")).select("n", "s.*")
    out = long.groupBy("threshold").agg((F.sum("a") / F.sum("n")).alias("coverage"), fn.ratio(F.sum("k"), F.sum("a")).alias("accuracy"),
                                        M.share((F.col("n") - F.col("a")) / F.col("n") > C.MAX_UNSURE_FRAC).alias("photos_refused"))
    return rnd(out, ["threshold"], "coverage", "accuracy", "photos_refused")


@query("count_error", """WITH c AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS grade FROM lineitem GROUP BY l_orderkey)
 SELECT grade, n AS found, count(*) AS photos, n = 4 AS exact, abs(n-4) <= 2 AS within2 FROM c GROUP BY grade, n""")
def count_error(t):
    """Histogram of found counts per grade against the declared four."""
    c = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("found"), F.min("l_returnflag").alias("grade"))
    return c.groupBy("grade", "found").agg(F.count(F.lit(1)).alias("photos")).select(
        "grade", "found", "photos", (F.col("found") == 4).alias("exact"), (F.abs(F.col("found") - 4) <= 2).alias("within2"))


@query("count_error_ranked", """WITH c AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS grade FROM lineitem GROUP BY l_orderkey), h AS (SELECT grade, n-4 AS error, count(*) AS photos FROM c GROUP BY grade, error)
 SELECT grade, error, photos, CAST(row_number() OVER (PARTITION BY grade ORDER BY photos DESC, error) AS INTEGER) AS place FROM h""")
def count_error_ranked(t):
    """Count errors of each grade, the most frequent first; equal ones by the smaller error."""
    c = t.lineitem.groupBy("l_orderkey").agg((F.count(F.lit(1)) - 4).alias("error"), F.min("l_returnflag").alias("grade"))
    h = c.groupBy("grade", "error").agg(F.count(F.lit(1)).alias("photos"))  # a histogram: few lines
    return h.withColumn("place", F.row_number().over(Window.partitionBy("grade").orderBy(F.desc("photos"), "error")))


@query("choose_quantised", f"""WITH {SCORES}, q AS (SELECT kind, source, p_good AS p, floor(p_good*32+0.5e0)/32 AS pq, defect FROM scores),
 s AS (SELECT kind, source, avg(((p < 0.5e0) = (defect=1))::INT) AS a, avg(((pq < 0.5e0) = (defect=1))::INT) AS b, max(abs(p-pq)) AS d, count(*) AS n, count(*) FILTER (WHERE (p < 0.5e0) = (pq < 0.5e0)) AS same FROM q GROUP BY kind, source),
 f AS (SELECT kind, 100*(avg(a)-avg(b)) AS gap, max(d) AS worst, sum(same)/CAST(sum(n) AS DOUBLE) AS agreement FROM s GROUP BY kind)
 SELECT kind, {r6('gap')} AS gap_points, {r6('worst')} AS worst_diff, {r6('agreement')} AS agreement, CASE WHEN round(gap,9) <= 1.5e0 AND worst <= 0.02e0 AND agreement >= 0.98e0 THEN 'quantised' ELSE 'full' END AS deployed FROM f""")
def choose_quantised(t):
    """The quantised scores (steps of 1/32) are deployed where the mean accuracy over held-out sources falls by no more than
    1.5 points and the two sets of scores are alike."""
    s = t.scores().withColumn("pq", F.floor(F.col("p_good") * 32 + 0.5) / 32)
    out = M.quantised_choice(s, ["kind"], "source", "p_good", "pq", "defect", max_diff=0.02, min_agreement=0.98)
    return rnd(out, ["kind", "deployed"], "gap_points", "worst_diff", "agreement").select("kind", "gap_points", "worst_diff", "agreement", "deployed")


@query("count_error_summary", f"""WITH c AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS grade FROM lineitem GROUP BY l_orderkey)
 SELECT grade, count(*) AS photos, count(*) FILTER (WHERE n=4) AS exact, count(*) FILTER (WHERE abs(n-4)<=2) AS within2, {r6('avg(abs(n-4))')} AS mean_abs, {r6('avg(n)')} AS mean_n, min(n) AS min_n, max(n) AS max_n FROM c GROUP BY GROUPING SETS ((grade), ())""")
def count_error_summary(t):
    hist = count_error(t)
    n = F.col("photos")
    return hist.groupingSets([["grade"], []], "grade").agg(
        F.sum("photos").alias("photos"), F.sum(F.when(F.col("exact"), n).otherwise(0)).alias("exact"), F.sum(F.when(F.col("within2"), n).otherwise(0)).alias("within2"),
        fn.r6(F.sum(F.abs(F.col("found") - 4) * n) / F.sum(n)).alias("mean_abs"), fn.r6(F.sum(F.col("found") * n) / F.sum(n)).alias("mean_n"),
        F.min("found").alias("min_n"), F.max("found").alias("max_n"))


@query("majority_baseline", f"""WITH {EMBP}, c AS (SELECT source, y, count(*) AS n, count(*) FILTER (WHERE y=pred) AS hit FROM ep GROUP BY source, y)
 SELECT source, CAST(sum(n) AS BIGINT) AS n, arg_max(y, n*100 - y) AS majority, {r6('max(n)/CAST(sum(n) AS DOUBLE)')} AS majority_share, {r6('sum(hit)/CAST(sum(n) AS DOUBLE)')} AS accuracy FROM c GROUP BY source""")
def majority_baseline(t):
    return rnd(M.majority_baseline(emb_probs(t), ["source"], "y", "pred"), ["source", "n", "majority"], "majority_share", "accuracy")


@query("answered_accuracy", f"""WITH {SCORES}, {CODED} SELECT source, count(*) FILTER (WHERE code<>2 AND NOT touching) AS answered, {r6('count(*) FILTER (WHERE code=defect AND NOT touching)/CAST(greatest(1, count(*) FILTER (WHERE code<>2 AND NOT touching)) AS DOUBLE)')} AS accuracy FROM coded GROUP BY source""")
def answered_accuracy(t):
    """Right answers over answered items; unsure and unmatched items are left out."""
    s = t.scores().withColumn("code", K.call_pair("p_good"))
    m = ~F.col("touching")
    a, k = F.count_if((F.col("code") != 2) & m), F.count_if((F.col("code") == F.col("defect")) & m)
    return s.groupBy("source").agg(a.alias("answered"), fn.r6(k / F.greatest(F.lit(1), a)).alias("accuracy"))


@query("lopo_table", f"""WITH {EMBP}, ph AS (SELECT photo, CASE WHEN photo%5=0 THEN -1 ELSE CAST(photo%5 AS INTEGER) END AS cls, count(*) AS n, {', '.join(f'avg((pred={i})::INT) AS s{i}' for i in range(6))}, median(conf) AS med FROM ep GROUP BY photo),
 k AS (SELECT *, [s0,s1,s2,s3,s4,s5][cls+1] AS recall, count(*) OVER (PARTITION BY cls) AS photos_of_class FROM ph WHERE cls >= 0)
 SELECT cls, CAST(sum(n) AS BIGINT) AS n, count(*) AS photos, {r6('sum(n*recall)/sum(n)')} AS item_weighted, {r6('avg(recall)')} AS photo_mean, {', '.join(f'{r6(f"avg(s{i})")} AS s{i}' for i in range(6))}, {r6('avg(med)')} AS mean_median_conf
 FROM k WHERE photos_of_class > 1 GROUP BY GROUPING SETS ((cls), ())""")
def lopo_table(t):
    """Held-out photos of one class each: predicted shares, recall; item-weighted and photo means, lone classes skipped."""
    e = emb_probs(t)
    sh = [F.avg((F.col("pred") == i).cast("double")).alias(f"s{i}") for i in range(6)]
    cls = F.when(F.col("photo") % 5 == 0, -1).otherwise((F.col("photo") % 5).cast("int"))
    ph = e.groupBy("photo").agg(F.count(F.lit(1)).alias("n"), *sh).join(exact_quantiles(e, ["photo"], "conf", {"med": 0.5}), "photo").withColumn("cls", cls).where("cls >= 0")
    ph = ph.withColumn("recall", F.get(F.array(*[f"s{i}" for i in range(6)]), F.col("cls")))
    many = ph.groupBy("cls").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("cls")
    out = ph.join(many, "cls", "left_semi").groupingSets([["cls"], []], "cls").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("photos"), (F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("item_weighted"), F.avg("recall").alias("photo_mean"),
        *[F.avg(f"s{i}").alias(f"s{i}") for i in range(6)], F.avg("med").alias("mean_median_conf"))
    return rnd(out, ["cls", "n", "photos"], "item_weighted", "photo_mean", *[f"s{i}" for i in range(6)], "mean_median_conf")


@query("otsu_by_group", f"""WITH {ITEMS}, h AS (SELECT photo, CAST(floor(least(255.0e0, greatest(0.0e0, area))) AS INTEGER) AS bin, count(*) AS c FROM items GROUP BY photo, bin),
 w AS (SELECT *, CAST(sum(c) OVER (PARTITION BY photo ORDER BY bin) AS DOUBLE) AS wb, CAST(sum(c*bin) OVER (PARTITION BY photo ORDER BY bin) AS DOUBLE) AS sb, CAST(sum(c) OVER (PARTITION BY photo) AS DOUBLE) AS n, CAST(sum(c*bin) OVER (PARTITION BY photo) AS DOUBLE) AS s FROM h),
 b AS (SELECT *, CASE WHEN n-wb > 0 THEN wb*(n-wb)*power(sb/wb-(s-sb)/nullif(n-wb,0),2) END AS between FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY round(between,6) DESC NULLS LAST, bin) AS rn FROM b)
 SELECT photo, CAST(n AS BIGINT) AS n, CASE WHEN between IS NULL THEN 0 ELSE bin END AS threshold, (round(coalesce(between,0)/(n*n)+1e-10,6)+0.0e0) AS between FROM r WHERE rn=1""")
def otsu_by_group(t):
    o = M.otsu(t.items(), ["photo"], "area")
    return o.select("photo", "n", "threshold", fn.r6(F.col("between") / (F.col("n") * F.col("n"))).alias("between"))


@query("override_effect", f"""WITH {ITEMS}, {'''x AS (SELECT source, code=1 AS bad, greatest(r,g,b)/255.0e0 < 0.3e0 AS r0, area > 300 AS called_good FROM items)'''}
 SELECT source, {r6('avg(r0::INT) FILTER (WHERE NOT bad)')} AS good_with_rule, {r6('avg(r0::INT) FILTER (WHERE bad)')} AS defect_with_rule, count(*) FILTER (WHERE bad AND called_good) AS missed, count(*) FILTER (WHERE bad AND called_good AND r0) AS caught,
 count(*) FILTER (WHERE NOT bad AND called_good) AS good_kept, count(*) FILTER (WHERE NOT bad AND called_good AND r0) AS broken, {r6('0.5e0*(avg(r0::INT) FILTER (WHERE bad) + 1 - avg(r0::INT) FILTER (WHERE NOT bad))')} AS balanced FROM x GROUP BY source""")
def override_effect(t):
    """Dark-value rule against the model per source: what an override would catch and what it would break."""
    x = t.items().select("source", (F.col("code") == 1).alias("bad"), (F.greatest("r", "g", "b") / 255.0 < 0.3).alias("r0"), (F.col("area") > 300).alias("cg"))
    bad, r0, cg = F.col("bad"), F.col("r0"), F.col("cg")
    rate = lambda w: F.avg(F.when(w, r0.cast("double")))
    out = x.groupBy("source").agg(rate(~bad).alias("good_with_rule"), rate(bad).alias("defect_with_rule"), F.count_if(bad & cg).alias("missed"), F.count_if(bad & cg & r0).alias("caught"),
                                  F.count_if(~bad & cg).alias("good_kept"), F.count_if(~bad & cg & r0).alias("broken"))
    out = out.withColumn("balanced", 0.5 * (F.col("defect_with_rule") + 1 - F.col("good_with_rule")))
    return rnd(out, ["source", "missed", "caught", "good_kept", "broken"], "good_with_rule", "defect_with_rule", "balanced")


@query("seed_spread", f"""WITH {LOTS}, a AS (SELECT source, year AS seed, avg((code=0)::INT) AS acc FROM lots GROUP BY source, year) SELECT source, count(*) AS seeds, {r6('avg(acc)')} AS mean, {r6('stddev_samp(acc)')} AS sd FROM a GROUP BY source""")
def seed_spread(t):
    a = t.lots().groupBy("source", "year").agg(F.avg((F.col("code") == 0).cast("double")).alias("acc"))
    return a.groupBy("source").agg(F.count(F.lit(1)).alias("seeds"), fn.r6(F.avg("acc")).alias("mean"), fn.r6(F.stddev_samp("acc")).alias("sd"))


@query("heldout_totals", f"""WITH {SCORES}, {CODED}, u AS (SELECT 'item' AS test_set, CAST(source AS VARCHAR) AS src, code, defect FROM coded WHERE NOT touching UNION ALL SELECT 'touching', CAST(source AS VARCHAR), code, defect FROM coded WHERE touching),
 g AS (SELECT test_set, src, count(*) AS n, count(*) FILTER (WHERE code<>2) AS answered, avg((code=defect)::INT) FILTER (WHERE code<>2 AND defect=1) AS acc FROM u GROUP BY test_set, src)
 SELECT test_set, count(*) AS sources, CAST(sum(n) AS BIGINT) AS n, CAST(sum(answered) AS BIGINT) AS answered, {r6('avg(acc)')} AS mean_accuracy FROM g GROUP BY GROUPING SETS ((test_set), ())""")
def heldout_totals(t):
    """Totals over several test sets; the mean over sources skips sources where the metric is not defined."""
    s = t.scores().withColumn("code", K.call_pair("p_good"))
    a = s.where(~F.col("touching")).select(F.lit("item").alias("test_set"), "source", "code", "defect")
    b = s.where(F.col("touching")).select(F.lit("touching").alias("test_set"), "source", "code", "defect")
    ans = F.col("code") != 2
    g = a.unionByName(b).groupBy("test_set", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(ans).alias("answered"),
                                                          F.avg(F.when(ans & (F.col("defect") == 1), (F.col("code") == F.col("defect")).cast("double"))).alias("acc"))
    return g.groupingSets([["test_set"], []], "test_set").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("n"), F.sum("answered").alias("answered"), fn.r6(F.avg("acc")).alias("mean_accuracy"))


@query("metric_compare", f"""WITH {LOTS}, n AS (SELECT lot, avg((code=1)::INT) AS new_rate FROM lots GROUP BY lot), o AS (SELECT s_suppkey AS lot, s_acctbal/20000 AS old_rate FROM supplier WHERE s_acctbal > 0)
 SELECT n.lot, {r6('new_rate')} AS new_rate, {r6('old_rate')} AS old_rate, {r6('new_rate-old_rate')} AS diff FROM n LEFT JOIN o USING (lot)""")
def metric_compare(t):
    """New metric per source next to a recorded one; sources without a record stay."""
    n = t.lots().groupBy("lot").agg(F.avg((F.col("code") == 1).cast("double")).alias("new_rate"))
    o = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("lot"), (F.col("s_acctbal") / 20000).alias("old_rate"))
    return n.join(o, "lot", "left").select("lot", fn.r6("new_rate").alias("new_rate"), fn.r6("old_rate").alias("old_rate"), fn.r6(F.col("new_rate") - F.col("old_rate")).alias("diff"))
