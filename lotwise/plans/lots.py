"""Lots of known composition, sweeps over rules, and the verdicts drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import hash_rank, largest_group
from lotwise.operators import lots as O
from lotwise.operators import metrics as M
from lotwise.operators import robust as R
from lotwise.operators import splits as P
from lotwise.operators import vectors as X
from lotwise.operators import verdict as V
from lotwise.plans.metrics import rnd
from lotwise.plans.registry import query
from lotwise.plans.robust import FEATURES, hand, robust_sql
from lotwise.plans.sampling import h
from lotwise.session import cut_lineage
from lotwise.plans.sqltext import EMB, LOTS, SCORES, band, r6, verdict, wilson

DESIGN = O.share_design()
FIXED = [(80, 0), (80, 10), (80, 24)]


def pool_items(t):
    return t.scores().where(~F.col("touching")).select("event_id", F.col("source").cast("int").alias("unit"), "defect", "p_good")


def draw(t, design=None, reps=O.REPS, seeds=("s0",), refill=False, unit=None, carry=("p_good",)):
    items = pool_items(t) if unit is None else pool_items(t).withColumn("unit", unit)
    lots = O.build_lots(items, "unit", "defect", design or DESIGN, reps, F.array(*[F.lit(s) for s in seeds]), refill)
    pool = O.ranked_pool(items, "unit", "defect", "event_id", "pool")
    return O.pick_items(lots, pool, "unit", "defect", "event_id", list(carry))


def lots_sql(design, reps, seeds="['s0']", refill=False, unit="CAST(source AS INTEGER)"):
    cells = ", ".join(f"({s}, {d})" for s, d in design)
    short = "size-nd > n_good OR nd > n_bad"
    where = "NOT ((nd > 0 AND n_bad = 0) OR (size > nd AND n_good = 0))" if refill else f"NOT ({short})"
    strides = ", ".join(str(p) for p in O.STRIDES)
    return f"""{SCORES}, pl AS (SELECT event_id, {unit} AS unit, defect, p_good FROM scores WHERE NOT touching), pc AS (SELECT unit, count(*) FILTER (WHERE defect=0) AS n_good, count(*) FILTER (WHERE defect=1) AS n_bad FROM pl GROUP BY unit),
 ds(size, nd) AS (VALUES {cells}), lt0 AS (SELECT unit, n_good, n_bad, seed, size, nd, CAST(rep AS INTEGER) AS rep, {short} AS replaced FROM pc, ds, range({reps}) r(rep), (SELECT unnest({seeds}) AS seed) WHERE {where}),
 lt AS (SELECT *, md5(concat_ws('-', CAST(unit AS VARCHAR), size, nd, rep, seed)) AS hh, {band('nd/CAST(size AS DOUBLE)')} AS truth FROM lt0),
 px AS (SELECT *, CAST('0x'||substr(hh,1,12) AS BIGINT)/281474976710656.0e0 AS u, [{strides}][CAST('0x'||substr(hh,13,1) AS BIGINT)%8+1] AS pr FROM lt),
 pi AS (SELECT px.*, i, CASE WHEN i < nd THEN 1 ELSE 0 END AS defect, CASE WHEN i < nd THEN n_bad ELSE n_good END AS n, CASE WHEN i < nd THEN i ELSE i-nd END AS j FROM px, range(100) r(i) WHERE i < size),
 rp AS (SELECT *, row_number() OVER (PARTITION BY unit, defect ORDER BY {h('event_id', 'pool')}) AS pos FROM pl),
 pick AS (SELECT pi.unit, seed, size, nd, rep, replaced, truth, rp.defect, rp.event_id, rp.p_good FROM pi JOIN rp ON pi.unit=rp.unit AND pi.defect=rp.defect AND rp.pos = (CAST(floor(u*n) AS BIGINT)+j*(pr%n))%n+1)"""


SUM_SQL = "count(*) AS n, CAST(sum(defect) AS BIGINT) AS defects, count(DISTINCT event_id) AS items, CAST(sum(event_id) AS BIGINT) AS checksum"


def summed(p, keys):
    return p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("defect").alias("defects"), F.countDistinct("event_id").alias("items"), F.sum("event_id").alias("checksum"))


@query("tray_design", f"WITH {lots_sql(DESIGN, 200)} SELECT unit, size, nd, rep, truth, {SUM_SQL} FROM pick GROUP BY unit, size, nd, rep, truth")
def tray_design(t):
    return summed(draw(t), ["unit", "size", "nd", "rep", "truth"])


_REPL = [(50, 0), (50, 6), (50, 15)]
_SMALL = "CAST(\"user\" AS INTEGER)"


@query("tray_replacement", f"WITH {lots_sql(_REPL, 167, refill=True, unit=_SMALL)} SELECT unit, nd, replaced, truth, count(DISTINCT rep) AS lots, {SUM_SQL} FROM pick WHERE nd < 15 OR rep < 166 GROUP BY unit, nd, replaced, truth")
def tray_replacement(t):
    """500 lots per small pool (167, 167, 166): what it cannot fill without repeats is filled by going round, and flagged."""
    items = t.scores().where(~F.col("touching")).select("event_id", F.col("user").cast("int").alias("unit"), "defect", "p_good")
    lots = O.build_lots(items, "unit", "defect", _REPL, 167, F.array(F.lit("s0")), refill=True).where("nd < 15 OR rep < 166")
    pool = O.ranked_pool(items, "unit", "defect", "event_id", "pool")
    return O.pick_counts(lots, pool, "unit", ["unit", "nd", "replaced", "truth"], "defect", "event_id")


@query("tray_fixed", f"WITH {lots_sql(FIXED, 200, unit='CAST(CASE WHEN p_good >= 0.6e0 THEN 2 ELSE 1 END AS INTEGER)')} SELECT unit, size, nd, rep, truth, {SUM_SQL} FROM pick GROUP BY unit, size, nd, rep, truth")
def tray_fixed(t):
    """Fixed design 0 / 10 / 24 defects of 80 per fold."""
    return summed(draw(t, FIXED, unit=F.when(F.col("p_good") >= 0.6, 2).otherwise(1)), ["unit", "size", "nd", "rep", "truth"])


TD_DEMO = 0.6  # the test scores are weak: at the shipped .91 no lot would get a band
_TG = "[0.5e0,0.55e0,0.6e0,0.65e0,0.7e0,0.75e0]"
SWEPT = f"""cd AS (SELECT unit, seed, size, nd, rep, truth, tg, CASE WHEN p_good >= tg THEN 0 WHEN 1-p_good >= {TD_DEMO}e0 THEN 1 ELSE 2 END AS code FROM pick, (SELECT unnest({_TG}) AS tg)),
 vd AS ({verdict('cd', 'unit, seed, size, nd, rep, truth, tg')}), oc AS (SELECT *, CASE WHEN band='unsure' THEN 'notsure:'||reason ELSE band END AS o, band <> 'unsure' AS isb FROM vd)"""
SCORED = """count(*) AS lots, count(*) FILTER (WHERE isb) AS bands, count(*) FILTER (WHERE isb AND truth=o) AS correct, count(*) FILTER (WHERE isb AND truth<>o) AS wrong,
 count(*) FILTER (WHERE truth='clean' AND o='many') AS clean_called_many, count(*) FILTER (WHERE truth='many' AND o='clean') AS many_called_clean"""
LOT_KEYS = ["unit", "seed", "size", "nd", "rep", "truth"]


def swept(t, **kw):
    return O.score_lots(draw(t, **kw), LOT_KEYS, "p_good", td=TD_DEMO)


@query("tray_sweep", f"WITH {lots_sql(DESIGN, 200)}, {SWEPT} SELECT unit, size, tg, {SCORED} FROM oc GROUP BY unit, size, tg")
def tray_sweep(t):
    return V.lot_score(swept(t), ["unit", "size", "tg"])


_VERD = """un AS (SELECT unit, tg, {S} FROM oc GROUP BY unit, tg), tv AS (SELECT tg, CAST(sum(clean_called_many+many_called_clean) AS BIGINT) AS dangerous, count(*) FILTER (WHERE bands >= 10 AND wrong/CAST(bands AS DOUBLE) > 0.05e0) AS units_failing, CAST(sum(bands) AS BIGINT) AS bands, CAST(sum(wrong) AS BIGINT) AS wrong FROM un GROUP BY tg),
 tq AS (SELECT *, dangerous = 0 AND units_failing = 0 AS qualifies FROM tv)""".replace("{S}", SCORED)


@query("sweep_verdict", f"WITH {lots_sql(DESIGN, 200)}, {SWEPT}, {_VERD} SELECT *, coalesce((SELECT min(tg) FROM tq WHERE qualifies), 0.75e0) AS chosen, (SELECT min(tg) FROM tq WHERE qualifies) IS NULL AS is_fallback FROM tq")
def sweep_verdict(t):
    return O.sweep_verdict(V.lot_score(swept(t, reps=200), ["unit", "tg"]), "unit")


_SEEDS = ("s0", "s1", "s2")


@query("sweep_seeds", f"""WITH {lots_sql(DESIGN, 200, seeds="['s0','s1','s2']")}, {SWEPT}, un AS (SELECT seed, unit, tg, {SCORED} FROM oc GROUP BY seed, unit, tg), tv AS (SELECT seed, tg, sum(clean_called_many+many_called_clean) AS dangerous, count(*) FILTER (WHERE bands >= 10 AND wrong/CAST(bands AS DOUBLE) > 0.05e0) AS f, sum(bands) AS b, sum(wrong) AS w FROM un GROUP BY seed, tg)
 SELECT seed, coalesce(min(tg) FILTER (WHERE dangerous=0 AND f=0), 0.75e0) AS chosen, CAST(sum(b) AS BIGINT) AS bands, CAST(sum(w) AS BIGINT) AS wrong FROM tv GROUP BY seed""")
def sweep_seeds(t):
    """The whole sweep over further seeds: the choice per seed, pooled bands and wrong bands."""
    s = V.lot_score(swept(t, reps=200, seeds=_SEEDS), ["seed", "unit", "tg"]).withColumn("dangerous", F.col("clean_called_many") + F.col("many_called_clean"))
    fails = (F.col("bands") >= 10) & (F.col("wrong") / F.nullif(F.col("bands").cast("double"), F.lit(0.0)) > 0.05)
    r = s.groupBy("seed", "tg").agg(F.sum("dangerous").alias("d"), F.count_if(fails).alias("f"), F.sum("bands").alias("b"), F.sum("wrong").alias("w"))
    return r.groupBy("seed").agg(F.coalesce(F.min(F.when((F.col("d") == 0) & (F.col("f") == 0), F.col("tg"))), F.lit(C.T_FALLBACK)).alias("chosen"), F.sum("b").alias("bands"), F.sum("w").alias("wrong"))


_BARS = {"R": (0.30, 0.60), "A": (0.35, 0.60), "N": (0.30, 0.60)}


@query("go_nogo", f"""WITH {LOTS}, d AS (SELECT flag AS head, CAST(line AS INTEGER)*10 AS k, year AS draw, avg((code=0)::INT) FILTER (WHERE code<>2) AS acc, avg((code<>2)::INT) AS cov, count(*) FILTER (WHERE code=0 AND discount >= 0.085e0 AND qty > line*10) AS dangerous, count(*) FILTER (WHERE code=1 AND tax < 0.005e0 AND qty > line*10+5) AS forbidden FROM lots GROUP BY 1, 2, 3),
 a AS (SELECT head, k, count(*) AS draws, avg(coalesce(acc,0)) AS mean_acc, avg(cov) AS mean_cov, CAST(sum(dangerous) AS BIGINT) AS dangerous, max(forbidden) AS worst_forbidden FROM d GROUP BY head, k), nd AS (SELECT count(DISTINCT draw) AS n FROM d),
 g AS (SELECT a.*, mean_acc >= CASE head WHEN 'A' THEN 0.35e0 ELSE 0.30e0 END AND mean_cov >= 0.60e0 AND dangerous=0 AND worst_forbidden=0 AND draws=7 AS go FROM a), f AS (SELECT head, k FROM g WHERE go ORDER BY CASE head WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, k LIMIT 1)
 SELECT head, k, draws, {r6('mean_acc')} AS mean_acc, {r6('mean_cov')} AS mean_cov, dangerous, worst_forbidden, go, coalesce((SELECT 'GO '||head||' K='||k FROM f), 'NO-GO') AS verdict FROM g""")
def go_nogo(t):
    """GO / NO-GO over draws: three heads, several K, seven draws, every criterion in every draw. Dangerous: a good call
    at a high discount; forbidden: a defect call at no tax; both only above the quantity that K stands for."""
    d = t.lots().groupBy(F.col("flag").alias("head"), (F.col("line") * 10).alias("k"), F.col("year").alias("draw")).agg(
        F.avg(F.when(F.col("code") != 2, (F.col("code") == 0).cast("double"))).alias("acc"), F.avg((F.col("code") != 2).cast("double")).alias("cov"),
        F.count_if((F.col("code") == 0) & (F.col("discount") >= 0.085) & (F.col("qty") > F.col("line") * 10)).alias("dangerous"),
        F.count_if((F.col("code") == 1) & (F.col("tax") < 0.005) & (F.col("qty") > F.col("line") * 10 + 5)).alias("forbidden"))
    g = O.go_nogo(d, "head", "k", "draw", "acc", "cov", "dangerous", "forbidden", _BARS, 7)
    return rnd(g, ["head", "k", "draws", "dangerous", "worst_forbidden", "go", "verdict"], "mean_acc", "mean_cov")


# ---------------------------------------------------------------- odd items put into groups

ODD = 3
TRAYS = 300
# condition: (base is a whole photo?, which items may be put in)
CONDITIONS = {
    "A": (False, "label >= 4"), "B": (False, "label < 4 and source = 4"), "B2": (False, "shift"),
    "C": (True, "label >= 4"), "D": (True, "label < 4"), "E": (True, "label = 9"), "F": (True, "label < 2"),
}


def odd_trays(t, photos: bool = True):
    """Seven conditions x trays: 50 base items (or one whole photo) and three items from another pool.

    A pool is ranked once; tray r takes the positions that follow from its digest. Without ``photos`` a whole photo's items
    are not copied to its trays; the three items then carry its number as ``photo``."""
    e = hand(t)
    trays = t.spark.range(TRAYS).select(F.col("id").cast("int").alias("tray"))
    out = None
    n_photos = 25
    for cond, (whole, pool) in CONDITIONS.items():
        hsh = F.md5(F.concat_ws("|", F.lit(cond), F.col("tray").cast("string")))
        start = lambda a: F.conv(F.substring(hsh, a, 6), 16, 10).cast("long")
        base_pool = e.where("label < 4") if not whole else None

        def ranked(df, seed):
            r = hash_rank(df.withColumn("_h", P.seeded("vec_id", seed)).withColumn("_one", F.lit(1)), ["_one"], "_h")
            return r.drop("_h", "_one")
        if whole:
            base = trays.withColumn("photo", F.pmod(start(1), F.lit(n_photos))).join(e, "photo")
        else:
            rb = ranked(base_pool, f"base{cond}")
            n = rb.agg(F.max("rn_n")).scalar()
            pos = trays.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("rn", F.pmod(start(1) + F.col("_j"), n) + 1)
            base = pos.join(rb, "rn").drop("rn", "rn_n", "_j")
        ro = ranked(e.where("label < 4") if pool == "shift" else e.where(pool), f"base{cond}" if pool == "shift" else f"odd{cond}")
        n = ro.agg(F.max("rn_n")).scalar()
        # positions after the base block, so an inserted copy of a base pool is never one of the base items
        first = start(1) + 50 if pool == "shift" else start(7)
        odd = trays.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(ODD - 1)))).withColumn("rn", F.pmod(first + F.col("_j"), n) + 1).join(ro, "rn").drop("rn", "rn_n", "_j")
        if pool == "shift":
            odd = odd.withColumns({f: F.col(f) * 0.7 - 0.02 for f in FEATURES}).withColumn("vec", F.transform("vec", lambda x: x * 0.7 - 0.02))
        cols = ["tray", "vec_id", "vec", *FEATURES]
        both = odd.select(*cols, F.lit(True).alias("odd"))
        if photos or not whole:
            both = base.select(*cols, F.lit(False).alias("odd")).unionByName(both)
        both = both.withColumn("cond", F.lit(cond))
        if not photos:
            both = both.withColumn("photo", F.pmod(start(1), F.lit(n_photos)) if whole else F.lit(None).cast("long"))
        out = both if out is None else out.unionByName(both)
    # an item may be in a tray both as base and as insert (conditions on whole photos): the insert gets its own id
    return out.withColumn("id", F.col("vec_id") * 2 + F.col("odd").cast("long"))


def _odd_sql():
    """Trays of every condition in SQL: the same pools, digests and positions."""
    parts = []
    hx = lambda a: f"CAST('0x'||substr(hh,{a},6) AS BIGINT)"
    for c, (whole, pool) in CONDITIONS.items():
        tr = f"(SELECT CAST(tray AS INTEGER) AS tray, md5('{c}|'||tray) AS hh FROM range({TRAYS}) r(tray))"
        rank = lambda where, seed: f"(SELECT vec_id, row_number() OVER (ORDER BY {h('vec_id', seed)}) AS rn, count(*) OVER () AS n FROM emb WHERE {where})"
        if whole:
            parts.append(f"SELECT '{c}' AS cond, tray, vec_id, FALSE AS odd FROM {tr} JOIN emb ON photo = {hx(1)}%25")
        else:
            parts.append(f"SELECT '{c}' AS cond, tray, vec_id, FALSE AS odd FROM {tr}, range(50) g(j) JOIN {rank('label < 4', 'base' + c)} ON rn = ({hx(1)}+j)%n+1")
        where, seed, first = ("label < 4", "base" + c, f"{hx(1)}+50") if pool == "shift" else (pool, "odd" + c, hx(7))
        parts.append(f"SELECT '{c}' AS cond, tray, vec_id, TRUE AS odd FROM {tr}, range({ODD}) g(j) JOIN {rank(where, seed)} ON rn = ({first}+j)%n+1")
    return EMB + ", ot AS (" + " UNION ALL ".join(parts) + ")"


@query("odd_insertion", f"WITH {_odd_sql()} SELECT cond, tray, count(*) FILTER (WHERE NOT odd) AS base, count(*) FILTER (WHERE odd) AS inserted, CAST(sum(vec_id*2+odd::INT) AS BIGINT) AS checksum FROM ot GROUP BY cond, tray")
def odd_insertion(t):
    return odd_trays(t).groupBy("cond", "tray").agg(F.count_if(~F.col("odd")).alias("base"), F.count_if("odd").alias("inserted"), F.sum("id").alias("checksum"))


_SHIFT = "CASE WHEN cond='B2' AND odd THEN list_transform({v}, lambda x: x*0.7e0-0.02e0) ELSE {v} END"


@query("detector_eval", f"""WITH {_odd_sql()}, oi0 AS (SELECT cond||'-'||tray AS photo, ot.cond, ot.odd, ot.vec_id*2+odd::INT AS vec_id, {_SHIFT.format(v='hand')} AS hand, {_SHIFT.format(v='e')} AS e FROM ot JOIN emb ON ot.vec_id=emb.vec_id),
 oi AS (SELECT *, list_transform(e, lambda x: x/greatest(sqrt(list_dot_product(e,e)),1e-9)) AS u FROM oi0), {robust_sql('oi', 'oi')},
 z AS (SELECT o.cond, o.photo, o.odd, round(z_both,9) AS z_both, rank() OVER (PARTITION BY o.photo ORDER BY round(z_both,9))+(count(*) OVER (PARTITION BY o.photo, round(z_both,9))-1)/2.0e0 AS rk FROM uns JOIN oi o ON o.photo=uns.photo AND o.vec_id=uns.vec_id),
 g AS (SELECT cond, photo, (sum(rk) FILTER (WHERE odd) - count(*) FILTER (WHERE odd)*(count(*) FILTER (WHERE odd)+1)/2.0e0)/(count(*) FILTER (WHERE odd)*CAST(count(*) FILTER (WHERE NOT odd) AS DOUBLE)) AS auroc, avg((z_both > 3.5e0)::INT) FILTER (WHERE odd) AS rec, avg((z_both > 3.5e0)::INT) FILTER (WHERE NOT odd) AS ffr,
  count(*) FILTER (WHERE odd AND z_both > 3.5e0) AS hit, count(*) FILTER (WHERE z_both > 3.5e0) AS flags FROM z GROUP BY cond, photo)
 SELECT cond, count(*) AS trays, {r6('avg(auroc)')} AS mean_auroc, {r6('avg(rec)')} AS recall_inserted, {r6('avg(ffr)')} AS false_flag_rate, {r6('sum(hit)/CAST(greatest(sum(flags),1) AS DOUBLE)')} AS precision FROM g GROUP BY cond""")
def detector_eval(t):
    """Does the per-group outlier score find the inserted items? AUROC, recall, false flags per tray, then per condition.

    The 1,200 trays on whole photos share 25 photos, so what they share is worked out once per photo."""
    conds, items, floors = list(CONDITIONS), hand(t), R.floors_of(hand(t), FEATURES)
    shared = largest_group(items, ["photo"]) <= R.UNIT_ROWS
    grp = (F.array_position(F.lit(conds), F.col("cond")) - 1) * TRAYS + F.col("tray")
    x = cut_lineage(odd_trays(t, photos=not shared).withColumn("grp", grp.cast("int")))
    apart = x.where("photo IS NULL") if shared else x
    e = apart.select("grp", "id", "vec")
    d = X.knn_distance(e, e, C.KNN_K, by=["grp"]).withColumnRenamed("qid", "id")
    s = R.feature_score(cut_lineage(apart.drop("vec", "vec_id").join(d, ["grp", "id"])), ["grp"], FEATURES, floors).select("grp", "odd", "hand_score", "distance")
    if shared:
        base = items.select("photo", F.col("vec_id").alias("id"), "vec", *FEATURES)
        s = s.unionByName(R.scores_with_inserts(base, x.where("photo IS NOT NULL"), "photo", FEATURES, floors, C.KNN_K))
    u = R.final_z(cut_lineage(s), ["grp"], {"hand_score": "z_hand", "distance": "z_emb"})
    u = cut_lineage(u.select("grp", "odd", F.round(0.5 * (F.col("z_hand") + F.col("z_emb")), 9).alias("z_both")))
    a = M.auroc(u, ["grp"], "z_both", "odd")
    f = u.groupBy("grp").agg(F.avg(F.when(F.col("odd"), (F.col("z_both") > C.UNUSUAL_Z).cast("double"))).alias("rec"), F.avg(F.when(~F.col("odd"), (F.col("z_both") > C.UNUSUAL_Z).cast("double"))).alias("ffr"),
                                     F.count_if(F.col("odd") & (F.col("z_both") > C.UNUSUAL_Z)).alias("hit"), F.count_if(F.col("z_both") > C.UNUSUAL_Z).alias("flags"))
    cond = F.get(F.lit(conds), F.floor(F.col("grp") / TRAYS).cast("int"))
    out = a.join(f, ["grp"]).groupBy(cond.alias("cond")).agg(F.count(F.lit(1)).alias("trays"), F.avg("auroc").alias("mean_auroc"), F.avg("rec").alias("recall_inserted"), F.avg("ffr").alias("false_flag_rate"),
                                                        (F.sum("hit") / F.greatest(F.sum("flags"), F.lit(1))).alias("precision"))
    return rnd(out, ["cond", "trays"], "mean_auroc", "recall_inserted", "false_flag_rate", "precision")
