"""Robust outlier scores, shape statistics, distance gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import exact_medians, exact_quantiles, hot_groups, one_row
from lotwise.operators import robust as R
from lotwise.operators import vectors as X
from lotwise.plans import photos as PH
from lotwise.plans.metrics import rnd
from lotwise.plans.registry import REGISTRY, query
from lotwise.plans.sqltext import EMB, ITEMS, LOTS, r6
from lotwise.plans.vectors import KNN_LOO, UNIT, loo_distance

FEATURES = [f"h{i}" for i in range(16)]


def hand(t):
    return t.emb().select("photo", "vec_id", "label", "y", "source", "logits", F.col("e").alias("vec"), *[F.get("hand", i).alias(f"h{i}") for i in range(16)])


def robust_sql(items: str, vectors: str = "un") -> str:
    """Robust scores of ``items`` (photo, vec_id, hand) with neighbour distances from ``vectors`` (photo, vec_id, u)."""
    return f"""{KNN_LOO.replace('FROM un a JOIN un b', f'FROM {vectors} a JOIN {vectors} b')}, lo AS (SELECT photo, vec_id, unnest(range(16)) AS f, unnest(hand) AS x FROM {items}), fl AS (SELECT f, 0.1e0*stddev_pop(x) AS floor FROM (SELECT unnest(range(16)) AS f, unnest(hand) AS x FROM emb) GROUP BY f),
 m1 AS (SELECT photo, f, median(x) AS med FROM lo GROUP BY photo, f), m2 AS (SELECT photo, f, any_value(med) AS med, median(abs(x-med)) AS mad FROM lo JOIN m1 USING (photo, f) GROUP BY photo, f),
 z1 AS (SELECT photo, vec_id, sqrt(avg(power(greatest(-8.0e0, least(8.0e0, (x-med)/greatest(1.4826e0*mad, floor))),2))) AS hand_score FROM lo JOIN m2 USING (photo, f) JOIN fl USING (f) GROUP BY photo, vec_id),
 sc AS (SELECT photo, vec_id, hand_score, distance FROM z1 JOIN kl USING (photo, vec_id)), s1 AS (SELECT photo, median(hand_score) AS hm, median(distance) AS dm FROM sc GROUP BY photo),
 s2 AS (SELECT photo, any_value(hm) AS hm, any_value(dm) AS dm, median(abs(hand_score-hm)) AS ha, median(abs(distance-dm)) AS da FROM sc JOIN s1 USING (photo) GROUP BY photo),
 un2 AS (SELECT photo, vec_id, hand_score, distance, (hand_score-hm)/greatest(1.4826e0*ha, 1e-6*greatest(abs(hm),1e-9)) AS z_hand, (distance-dm)/greatest(1.4826e0*da, 1e-6*greatest(abs(dm),1e-9)) AS z_emb FROM sc JOIN s2 USING (photo)),
 uns AS (SELECT *, 0.5e0*(z_hand+z_emb) AS z_both FROM un2)"""


ROBUST = f"{EMB}, {UNIT}, {robust_sql('emb')}"


def unusual_items(t):
    h = hand(t)
    x = h.join(loo_distance(t), ["photo", "vec_id"])
    return R.unusual(x, ["photo"], FEATURES, "distance", R.floors_of(h, FEATURES), sizes=h)


@query("robust_z", f"WITH {ROBUST} SELECT photo, vec_id, {r6('hand_score')} AS hand_score, {r6('z_hand')} AS z_hand FROM uns")
def robust_z(t):
    h = hand(t)
    hot = hot_groups(h, ["photo"])
    x = R.robust_z(h, ["photo"], FEATURES, R.floors_of(h, FEATURES), hot).withColumn("hand_score", R.rms_clipped(FEATURES))
    return rnd(R.final_z(x, ["photo"], {"hand_score": "z_hand"}, hot), ["photo", "vec_id"], "hand_score", "z_hand")


@query("unusual_flags", f"WITH {ROBUST} SELECT photo, vec_id, {r6('z_hand')} AS z_hand, {r6('z_emb')} AS z_emb, {r6('z_both')} AS z_both, z_both > 3.5e0 AS flagged FROM uns")
def unusual_flags(t):
    u = unusual_items(t)
    return rnd(u.withColumn("flagged", F.col("z_both") > C.UNUSUAL_Z), ["photo", "vec_id", "flagged"], "z_hand", "z_emb", "z_both")


@query("flag_share", f"""WITH {ROBUST}, lb AS (SELECT vec_id, label FROM emb), u AS (SELECT photo, label, unnest(['hand','emb','both']) AS score, unnest([z_hand, z_emb, z_both]) AS z FROM uns JOIN lb USING (vec_id)), p AS (SELECT label, score, photo, count(*) AS n, count(*) FILTER (WHERE z > 3.5e0) AS k FROM u GROUP BY label, score, photo)
 SELECT label, score, count(*) AS photos, CAST(sum(n) AS BIGINT) AS items, {r6('sum(k)/CAST(sum(n) AS DOUBLE)')} AS share_flagged, {r6('avg(k)')} AS mean_flags FROM p GROUP BY label, score""")
def flag_share(t):
    """Share of flagged items and mean flags per photo, by grade and score variant."""
    u = unusual_items(t).select("photo", "label", F.col("z_hand").alias("hand"), F.col("z_emb").alias("emb"), F.col("z_both").alias("both"))
    long = u.unpivot(["photo", "label"], ["hand", "emb", "both"], "score", "z")
    p = long.groupBy("label", "score", "photo").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("z") > C.UNUSUAL_Z).alias("k"))
    out = p.groupBy("label", "score").agg(F.count(F.lit(1)).alias("photos"), F.sum("n").alias("items"), (F.sum("k") / F.sum("n")).alias("share_flagged"), F.avg("k").alias("mean_flags"))
    return rnd(out, ["label", "score", "photos", "items"], "share_flagged", "mean_flags")


@query("relative_size", f"WITH {ITEMS}, m AS (SELECT photo, median(area) AS med FROM items GROUP BY photo) SELECT photo, count(*) AS n, {r6('avg(ln(area/med))')} AS mean_log, {r6('max(ln(area/med))')} AS max_log, {r6('min(ln(area/med))')} AS min_log FROM items JOIN m USING (photo) GROUP BY photo")
def relative_size(t):
    i = t.items().select("photo", "area")
    x = i.join(exact_medians(i, ["photo"], ["area"]), "photo").withColumn("rel", F.log(F.col("area") / F.col("area_med")))
    return x.groupBy("photo").agg(F.count(F.lit(1)).alias("n"), fn.r6(F.avg("rel")).alias("mean_log"), fn.r6(F.max("rel")).alias("max_log"), fn.r6(F.min("rel")).alias("min_log"))


@query("group_spread", f"""WITH {EMB}, {UNIT}, {KNN_LOO}, g AS (SELECT photo, quantile_cont(hand[1],0.75)-quantile_cont(hand[1],0.25) AS a_iqr, quantile_cont(hand[10],0.75)-quantile_cont(hand[10],0.25) AS b_iqr, median(hand[1]) AS med FROM emb GROUP BY photo),
 d AS (SELECT photo, avg((hand[1] < med-0.1e0)::INT) AS dark_rel FROM emb JOIN g USING (photo) GROUP BY photo), k AS (SELECT photo, median(distance) AS emb_spread FROM kl GROUP BY photo)
 SELECT g.photo, {r6('a_iqr')} AS a_iqr, {r6('b_iqr')} AS b_iqr, {r6('dark_rel')} AS dark_rel, {r6('emb_spread')} AS emb_spread FROM g JOIN d USING (photo) JOIN k USING (photo)""")
def group_spread(t):
    h = hand(t).select("photo", "h0", "h9")
    a = exact_quantiles(h, ["photo"], "h0", {"a25": 0.25, "a50": 0.5, "a75": 0.75})
    b = exact_quantiles(h, ["photo"], "h9", {"b25": 0.25, "b75": 0.75})
    dark = h.join(a, "photo").groupBy("photo").agg(F.avg((F.col("h0") < F.col("a50") - 0.1).cast("double")).alias("dark_rel"))
    k = exact_quantiles(loo_distance(t), ["photo"], "distance", {"emb_spread": 0.5})
    out = a.join(b, "photo").join(dark, "photo").join(k, "photo").withColumns({"a_iqr": F.col("a75") - F.col("a25"), "b_iqr": F.col("b75") - F.col("b25")})
    return rnd(out, ["photo"], "a_iqr", "b_iqr", "dark_rel", "emb_spread")


STATS = ["luma_med", "luma_p10", "luma_p90", "luma_std", "dark_frac", "sat_mean", "hue_deg", "val_mean", "chroma_mean", "fill", "elong"]


@query("group_stats16", f"""WITH {ITEMS}, p AS (SELECT photo, 0.299e0*r+0.587e0*g+0.114e0*b AS luma, greatest(r,g,b)-least(r,g,b) AS ch, greatest(r,g,b) AS mx, r, g, b, area, x0, y0 FROM items),
 a AS (SELECT photo, median(luma) AS luma_med, quantile_cont(luma,0.1) AS luma_p10, quantile_cont(luma,0.9) AS luma_p90, stddev_pop(luma) AS luma_std, avg((luma<80)::INT) AS dark_frac, avg(coalesce(ch/nullif(mx,0),0)) AS sat_mean, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb, avg(ch) AS chroma_mean,
  sum(area)/12996.0e0 AS fill, var_samp(x0) AS cxx, var_samp(y0) AS cyy, covar_samp(x0,y0) AS cxy FROM p GROUP BY photo),
 {PH.HSV.replace('FROM items)', "FROM (SELECT *, mr AS r, mg AS g, mb AS b FROM a))")}
 SELECT photo, {', '.join(f"{r6(c)} AS {c}" for c in STATS[:6])}, {r6('h')} AS hue_deg, {r6('v')} AS val_mean, {r6('chroma_mean')} AS chroma_mean, {r6('fill')} AS fill,
 {r6('sqrt(((cxx+cyy)/2+sqrt(greatest(0,power((cxx-cyy)/2,2)+cxy*cxy)))/greatest((cxx+cyy)/2-sqrt(greatest(0,power((cxx-cyy)/2,2)+cxy*cxy)),1e-6))')} AS elong FROM hsv""")
def group_stats16(t):
    return rnd(R.colour_stats(t.items(), ["photo"], PH.FRAME_AREA), ["photo"], *STATS)


@query("moment_shape", f"""WITH {ITEMS}, px AS (SELECT lot, flag, part%50 AS x, (part//50)%40 AS y FROM items), s AS (SELECT lot, flag, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x*x) AS axx, avg(y*y) AS ayy, avg(x*y) AS axy FROM px GROUP BY lot, flag),
 c AS (SELECT *, axx-mx*mx+1/12.0e0 AS cxx, ayy-my*my+1/12.0e0 AS cyy, axy-mx*my AS cxy FROM s), l AS (SELECT *, (cxx+cyy)/2+sqrt(greatest(0,power((cxx+cyy)/2,2)-(cxx*cyy-cxy*cxy))) AS l1, greatest(1e-9,(cxx+cyy)/2-sqrt(greatest(0,power((cxx+cyy)/2,2)-(cxx*cyy-cxy*cxy)))) AS l2 FROM c)
 SELECT lot, flag, n AS area, {r6('n/(4*pi()*sqrt(l1*l2))')} AS fill, {r6('sqrt(l1/l2)')} AS elong FROM l""")
def moment_shape(t):
    px = t.items().select("lot", "flag", (F.col("part") % 50).alias("x"), (F.floor(F.col("part") / 50) % 40).alias("y"))
    return rnd(R.moment_shape(px, ["lot", "flag"], "x", "y"), ["lot", "flag", "area"], "fill", "elong")


@query("border_median", f"""WITH {ITEMS}, px AS (SELECT lot, r, g, b, part%100 AS x, (part//100 + CAST(qty AS BIGINT)*7)%100 AS y FROM items), bd AS (SELECT * FROM px WHERE y < 4 OR y >= 96 UNION ALL SELECT * FROM px WHERE x < 4 OR x >= 96)
 SELECT lot, count(*) AS n, {r6('median(r)')} AS r, {r6('median(g)')} AS g, {r6('median(b)')} AS b, {r6('0.299e0*median(r)+0.587e0*median(g)+0.114e0*median(b)')} AS luma FROM bd GROUP BY lot""")
def border_median(t):
    """Reference colour: channel medians of the outer 4 % band; a pixel in a corner belongs to two bands and counts twice."""
    px = t.items().select("lot", "r", "g", "b", (F.col("part") % 100).alias("x"), ((F.floor(F.col("part") / 100) + F.col("qty").cast("long") * 7) % 100).alias("y"))
    times = ((F.col("y") < 4) | (F.col("y") >= 96)).cast("int") + ((F.col("x") < 4) | (F.col("x") >= 96)).cast("int")
    bd = px.withColumn("_k", times).where("_k > 0").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    m = exact_medians(bd, ["lot"], ["r", "g", "b"], suffix="").join(bd.groupBy("lot").agg(F.count(F.lit(1)).alias("n")), "lot")
    return rnd(m.withColumn("luma", fn.luma("r", "g", "b")), ["lot", "n"], "r", "g", "b", "luma")


@query("mahalanobis_moments", f"""WITH {EMB}, g AS (SELECT hand FROM emb WHERE y = 0), f AS (SELECT i, avg(hand[i]) AS m, stddev_pop(hand[i])+1e-6 AS s FROM g, range(1,17) r(i) GROUP BY i), z AS (SELECT (hand[a.i]-a.m)/a.s AS za, (hand[b.i]-b.m)/b.s AS zb, a.i AS i, b.i AS j FROM g, f a, f b WHERE a.i <= b.i)
 SELECT CAST(i-1 AS INTEGER) AS i, CAST(j-1 AS INTEGER) AS j, {r6('avg(za*zb)')} AS cov FROM z GROUP BY i, j""")
def mahalanobis_moments(t):
    """Second moments of the standardised reference rows; the 16 x 16 inverse is the only thing left to the driver."""
    m = R.cloud_moments(hand(t).where("y = 0"), FEATURES)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c_{i}_{j}").alias("cov")) for i in range(16) for j in range(i, 16)]))
    return m.select(cells.alias("c")).select("c.i", "c.j", fn.r6("c.cov").alias("cov"))


@query("mahalanobis_score", f"""WITH RECURSIVE {EMB}, f AS (SELECT i, avg(hand[i]) AS m, stddev_pop(hand[i])+1e-6 AS s FROM emb, range(1,17) r(i) WHERE y=0 GROUP BY i), zz AS (SELECT vec_id, photo, y, list((hand[i]-m)/s ORDER BY i) AS z FROM emb, f GROUP BY vec_id, photo, y),
 cv AS (SELECT a.i AS i, b.i AS j, avg(z[a.i]*z[b.i]) AS c FROM zz, range(1,17) a(i), range(1,17) b(i) WHERE y=0 GROUP BY 1, 2), sets(name, lo, hi) AS (VALUES ('maha_all',1,16),('maha_colour',1,11),('maha_shape',12,16)),
 pa AS (SELECT name, lo, hi, hi-lo+1 AS p, sum(c) FILTER (WHERE i=j)/(hi-lo+1) AS mu, sum(c*c) AS spread FROM sets JOIN cv ON i BETWEEN lo AND hi AND j BETWEEN lo AND hi GROUP BY name, lo, hi),
 qq AS (SELECT name, count(*) AS n, sum(power(list_sum(list_transform(z[lo:hi], lambda x: x*x)),2)) AS q4 FROM zz, sets WHERE y=0 GROUP BY name),
 sh AS (SELECT pa.*, CASE WHEN delta=0 OR beta<=0 THEN 0.0e0 ELSE least(beta,delta)/delta END AS sk FROM (SELECT pa.*, (spread-p*mu*mu)/p AS delta, (q4/n-spread)/(p*n) AS beta FROM pa JOIN qq USING (name)) pa),
 ro AS (SELECT name, lo, hi, p, i, list_concat(list((1-sk)*c+CASE WHEN i=j THEN sk*mu ELSE 0 END ORDER BY j), list(CASE WHEN i=j THEN 1.0e0 ELSE 0.0e0 END ORDER BY j)) AS rw FROM sh JOIN cv ON i BETWEEN lo AND hi AND j BETWEEN lo AND hi GROUP BY name, lo, hi, p, i),
 gj AS (SELECT name, lo, hi, p, 1 AS k, list(rw ORDER BY i) AS m FROM ro GROUP BY name, lo, hi, p UNION ALL SELECT name, lo, hi, p, k+1, list_transform(range(1,p+1), lambda r: CASE WHEN r=k THEN list_transform(m[k], lambda x: x/m[k][k]) ELSE list_transform(list_zip(m[r], m[k]), lambda q: q[1]-m[r][k]*q[2]/m[k][k]) END) FROM gj WHERE k <= p),
 iv AS (SELECT name, lo, hi, p, list_transform(m, lambda r: r[p+1:2*p]) AS pm FROM gj WHERE k=p+1), ds AS (SELECT photo, name, sqrt(list_sum(list_transform(range(1,p+1), lambda i: z[lo:hi][i]*list_dot_product(pm[i], z[lo:hi])))) AS d FROM zz, iv)
 SELECT photo, {', '.join(f"{r6(f'median(d) FILTER (WHERE name={chr(39)}{n}{chr(39)})')} AS {n}" for n in ('maha_all', 'maha_colour', 'maha_shape'))} FROM ds GROUP BY photo""")
def mahalanobis_score(t):
    """Photo medians of the distance to the good items, over all, colour and shape statistics."""
    h = hand(t)
    good = h.where("y = 0")
    sets = {"maha_all": FEATURES, "maha_colour": FEATURES[:11], "maha_shape": FEATURES[11:]}
    x = h.select("photo", *[R.fit_cloud(good, f).distance().alias(n) for n, f in sets.items()])
    m = exact_medians(x, ["photo"], list(sets), suffix="")
    return rnd(m, ["photo"], *sets)


BANK = """bk AS (SELECT * FROM un WHERE y=0 AND e[64] > 0), kq AS (SELECT q.vec_id, 1-list_dot_product(q.u,b.u) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(q.u,b.u) DESC, b.vec_id) AS rn FROM un q JOIN bk b ON q.vec_id <> b.vec_id),
 kb AS (SELECT vec_id, avg(d) AS d FROM kq WHERE rn <= 5 GROUP BY vec_id), tb AS (SELECT quantile_cont(d, 0.95) AS tau FROM kb JOIN emb USING (vec_id) WHERE y=0 AND e[64] <= 0)"""


def bank_distance(t, first: int = 1):
    """Mean distance to the five nearest bank items, by the vector's entries from ``first`` on."""
    e = t.emb().select(F.col("vec_id").alias("id"), F.slice("e", first, 64).alias("vec"), "y", (F.element_at("e", 64) > 0).alias("half"))
    return X.knn_distance(e.select("id", "vec"), e.where((F.col("y") == 0) & F.col("half")).select("id", "vec"), 5).select(F.col("qid").alias("vec_id"), F.col("distance").alias("d"))


@query("photo_scores", f"""WITH {EMB}, {UNIT}, {BANK} SELECT photo, {r6('avg((list_max(p) < 0.3e0)::INT)')} AS low_conf, {r6('median(-(list_max(logits)+ln(list_sum(list_transform(logits, lambda x: exp(x-list_max(logits)))))))')} AS energy,
 {r6('median(d)')} AS bank_knn, {r6('avg((d > tau)::INT)')} AS unfamiliar_share FROM emb JOIN kb USING (vec_id), tb GROUP BY photo""")
def photo_scores(t):
    """Photo score vector: low-confidence share, median energy and bank distance, share of unfamiliar items.

    The bank is one half of the good items; the other half sets what counts as unfamiliar."""
    e = t.emb().select("vec_id", "photo", "y", (F.element_at("e", 64) > 0).alias("half"), F.array_max(fn.softmax("logits")).alias("conf"), fn.energy("logits").alias("energy"))
    x = e.join(bank_distance(t), "vec_id")
    tau = one_row(exact_quantiles(x.where("y = 0 and not half"), [], "d", {"tau": 0.95}))["tau"]
    share = x.groupBy("photo").agg(F.avg((F.col("conf") < 0.3).cast("double")).alias("low_conf"), F.avg((F.col("d") > tau).cast("double")).alias("unfamiliar_share"))
    out = share.join(exact_medians(x, ["photo"], ["energy", "d"], suffix=""), "photo").withColumnRenamed("d", "bank_knn")
    return rnd(out, ["photo"], "low_conf", "energy", "bank_knn", "unfamiliar_share")


FEATURE_BANK = f"""WITH {EMB}, un AS (SELECT *, list_transform(e[17:64], lambda x: x/sqrt(list_dot_product(e[17:64], e[17:64]))) AS u FROM emb), {BANK}
 SELECT photo, {r6('median(d)')} AS feature_knn, {r6('avg((d > tau)::INT)')} AS feature_unfamiliar FROM emb JOIN kb USING (vec_id), tb GROUP BY photo"""


@query("photo_scores_full", f"""SELECT p.photo, low_conf, energy, bank_knn, feature_knn, feature_unfamiliar, maha_all, maha_colour, maha_shape
 FROM ({REGISTRY['photo_scores'].sql}) p JOIN ({FEATURE_BANK}) f USING (photo) JOIN ({REGISTRY['mahalanobis_score'].sql}) m USING (photo)""")
def photo_scores_full(t):
    """All eight scores of a photo: calls, energy, distance to a bank of embeddings and to one of features (with the
    share of items unfamiliar to it), and three distances to the cloud of good items."""
    e = t.emb().select("vec_id", "photo", "y", (F.element_at("e", 64) > 0).alias("half"))
    x = e.join(bank_distance(t, 17), "vec_id")
    tau = one_row(exact_quantiles(x.where("y = 0 and not half"), [], "d", {"tau": 0.95}))["tau"]
    share = x.groupBy("photo").agg(F.avg((F.col("d") > tau).cast("double")).alias("feature_unfamiliar"))
    feature = share.join(exact_medians(x, ["photo"], ["d"], suffix=""), "photo").withColumnRenamed("d", "feature_knn")
    feature = rnd(feature, ["photo"], "feature_knn", "feature_unfamiliar")
    return photo_scores(t).drop("unfamiliar_share").join(feature, "photo").join(mahalanobis_score(t), "photo")


@query("gate_calibrate", f"""WITH {LOTS}, s AS (SELECT lot, line, avg((code=2)::INT) AS score, avg((code=1)::INT) AS rate FROM lots GROUP BY lot, line), k AS (SELECT *, CASE WHEN line <= 2 AND rate < 0.2e0 THEN 'pass' WHEN line = 3 AND rate > 0.4e0 THEN 'refuse' ELSE 'test' END AS part FROM s),
 o AS (SELECT max(score) FILTER (WHERE part='pass') AS top, min(score) FILTER (WHERE part='refuse') AS low FROM k), r AS (SELECT 'fixed' AS rule, 0.15e0 AS tau, FALSE AS incl FROM o UNION ALL SELECT 'calibrated', CASE WHEN low > top THEN top+0.5e0*(low-top) ELSE top END, FALSE FROM o UNION ALL SELECT 'refuse_all', low, TRUE FROM o)
 SELECT rule, part, {r6('max(tau)')} AS tau, count(*) AS groups, count(*) FILTER (WHERE CASE WHEN incl THEN score >= tau ELSE score > tau END) AS refused FROM k, r GROUP BY rule, part""")
def gate_calibrate(t):
    s = t.lots().groupBy("lot", "line").agg(F.avg((F.col("code") == 2).cast("double")).alias("score"), F.avg((F.col("code") == 1).cast("double")).alias("rate"))
    part = F.when((F.col("line") <= 2) & (F.col("rate") < 0.2), "pass").when((F.col("line") == 3) & (F.col("rate") > 0.4), "refuse").otherwise("test")
    k = s.withColumn("part", part)
    rules = R.calibrate_gate(k, "score", F.col("part") == "pass", F.col("part") == "refuse")
    x = k.select("part", "score", F.explode(rules).alias("r")).select("part", "score", "r.*")
    hit = F.when(F.col("incl"), F.col("score") >= F.col("tau")).otherwise(F.col("score") > F.col("tau"))
    return x.groupBy("rule", "part").agg(fn.r6(F.max("tau")).alias("tau"), F.count(F.lit(1)).alias("groups"), F.count_if(hit).alias("refused"))
