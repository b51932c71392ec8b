"""Samples, caps, splits, folds, weights and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.operators import splits as P
from lotwise.plans.metrics import emb_probs, rnd
from lotwise.plans.registry import query
from lotwise.plans.sqltext import DOCS, EMB, ITEMS, LOTS, SCORES, r6


def h(key: str, seed: str) -> str:
    return f"md5(concat_ws('|', '{seed}', CAST({key} AS VARCHAR)))"


@query("inverse_weights", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT lang, n, (round(1.0e0/(n*(SELECT count(*) FROM c)),9)+0.0e0) AS w, 1.0e0/(SELECT count(*) FROM c) AS class_total FROM c""")
def inverse_weights(t):
    w = P.inverse_weights(t.documents.select("lang"), "lang")
    return w.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("w"), 9).alias("w"), F.round(F.sum("w"), 9).alias("class_total"))


KIND_NAMES = C.KINDS


def kinds(t):
    names = F.array(*[F.lit(k) for k in KIND_NAMES])
    return t.emb().select("vec_id", "source", F.element_at(names, F.when(F.col("y") >= 0, F.col("y") + 1).otherwise(7)).alias("kind"))


KIND_SQL = EMB + """, ks AS (SELECT vec_id, source, ['good','dark','insect','broken','unhulled','other_defect','defect_untyped'][CASE WHEN y>=0 THEN y+1 ELSE 7 END] AS kind FROM emb),
 kw(kind, kw) AS (VALUES ('good',0.40e0),('dark',0.11e0),('insect',0.11e0),('broken',0.11e0),('unhulled',0.11e0),('other_defect',0.06e0),('defect_untyped',0.10e0)),
 kc AS (SELECT kind, source, count(*) AS n FROM ks GROUP BY kind, source), kk AS (SELECT kind, count(*) AS s FROM kc GROUP BY kind), kt AS (SELECT sum(kw) AS al FROM kk JOIN kw USING (kind)),
 cells AS (SELECT kind, source, n, kw/al/s AS cell_w, kw/al/s/n AS row_w FROM kc JOIN kk USING (kind) JOIN kw USING (kind), kt)"""


@query("sampler_weights", f"WITH {KIND_SQL} SELECT kind, source, n, {r6('cell_w')} AS cell_w, (round(row_w,9)+0.0e0) AS row_w FROM cells")
def sampler_weights(t):
    c = P.sampler_cells(kinds(t), "kind", "source", C.KIND_WEIGHTS)
    return c.select("kind", "source", "n", fn.r6("cell_w").alias("cell_w"), F.round("row_w", 9).alias("row_w"))


@query("sampler_draws", f"""WITH {KIND_SQL}, ed AS (SELECT *, sum(cell_w) OVER (ORDER BY kind, source) AS hi FROM cells), dr AS (SELECT event_id, {h('event_id', 'draw')} AS hh FROM events),
 du AS (SELECT event_id, CAST('0x'||substr(hh,1,8) AS BIGINT)/4294967296.0e0 AS u, CAST('0x'||substr(hh,9,8) AS BIGINT)/4294967296.0e0 AS u2 FROM dr), pk AS (SELECT event_id, u2, kind, source, n, row_number() OVER (PARTITION BY event_id ORDER BY hi) AS rk FROM du JOIN ed ON hi > u),
 rk AS (SELECT *, row_number() OVER (PARTITION BY kind, source ORDER BY {h('vec_id', 'draw')}) AS rn FROM ks) SELECT event_id, p.kind, p.source, vec_id FROM pk p JOIN rk r ON p.kind=r.kind AND p.source=r.source AND r.rn = CAST(floor(u2*n) AS BIGINT)+1 WHERE p.rk=1""")
def sampler_draws(t):
    """One draw with replacement per event: kind by weight, source evenly, item evenly."""
    k = kinds(t)
    cells = P.sampler_cells(k, "kind", "source", C.KIND_WEIGHTS)
    return P.draw_with_replacement(t.events.select("event_id"), "event_id", k, cells, "kind", "source", "vec_id", "draw")


@query("cap_per_group", f"""WITH {DOCS}, r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {h('doc_id', '13')}) AS rn FROM docs) SELECT doc_id, source, lang FROM r WHERE rn <= 15""")
def cap_per_group(t):
    return P.cap_per_group(t.documents.select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", "13", 15)


@query("stratified_split", f"""WITH {ITEMS}, a AS (SELECT item, source, flag, photo, row_number() OVER (PARTITION BY source, flag ORDER BY {h('item', '7')}) AS r1, count(*) OVER (PARTITION BY source, flag) AS n1, row_number() OVER (PARTITION BY photo ORDER BY {h('item', '8')}) AS r2, count(*) OVER (PARTITION BY photo) AS n2 FROM items)
 SELECT source, flag, count(*) AS n, count(*) FILTER (WHERE r1 <= greatest(1, CAST(floor(n1*0.12e0) AS BIGINT))) AS val_label, count(*) FILTER (WHERE r2 <= greatest(1, CAST(round_even(n2*0.2e0,0) AS BIGINT))) AS val_photo,
 max({h('item', '7')}) FILTER (WHERE r1 <= greatest(1, CAST(floor(n1*0.12e0) AS BIGINT))) AS last_pick FROM a GROUP BY source, flag""")
def stratified_split(t):
    """12 % of every (source, label) and 20 % of every photo, at least one row each."""
    i = t.items().select("item", "source", "flag", "photo")
    x = P.validation_split(i, ["source", "flag"], "item", "7", 0.12).withColumnRenamed("is_val", "v1")
    x = P.validation_split(x, ["photo"], "item", "8", 0.2, "round").withColumnRenamed("is_val", "v2")
    return x.groupBy("source", "flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("v1").alias("val_label"), F.count_if("v2").alias("val_photo"),
                                           F.max(F.when(F.col("v1"), P.seeded("item", "7"))).alias("last_pick"))


GROUPS = "CASE WHEN source IN (3, 4) THEN 'twins' ELSE 's' || source END"


@query("loso_folds", f"""WITH {LOTS}, g AS (SELECT {GROUPS} AS grp, source % 4 <> 3 AS lic FROM lots), c AS (SELECT grp, lic, count(*) AS n FROM g GROUP BY grp, lic), t AS (SELECT sum(n) FILTER (WHERE lic) AS all_lic, count(DISTINCT grp) FILTER (WHERE lic) AS gl FROM c)
 SELECT 'loso_'||grp AS fold, CAST(sum(n) AS BIGINT) AS n_test, CAST(max(all_lic) - coalesce(sum(n) FILTER (WHERE lic),0) AS BIGINT) AS n_train, max(gl) - (coalesce(sum(n) FILTER (WHERE lic),0) > 0)::INT AS train_groups FROM c, t GROUP BY grp""")
def loso_folds(t):
    """Leave-one-group-out folds: test is the group, training is every licensed item of the other groups.

    Each item is stored once with its own test fold; training sets are totals minus the held-out group."""
    grp = F.when(F.col("source").isin(3, 4), "twins").otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    c = t.lots().groupBy(grp.alias("grp"), (F.col("source") % 4 != 3).alias("lic")).agg(F.count(F.lit(1)).alias("n"))
    per = c.groupBy("grp").agg(F.sum("n").alias("n_test"), F.coalesce(F.sum(F.when(F.col("lic"), F.col("n"))), F.lit(0)).alias("own"))
    total = per.agg(F.sum("own").alias("al"), F.count_if(F.col("own") > 0).alias("gl"))
    from lotwise.functions.scale import one_row

    one = one_row(total)
    return per.select(F.concat(F.lit("loso_"), "grp").alias("fold"), "n_test", (one["al"] - F.col("own")).alias("n_train"), (one["gl"] - (F.col("own") > 0).cast("int")).alias("train_groups"))


@query("fold_leak_check", f"""WITH {ITEMS}, f AS (SELECT photo, source, (x0+x1)/2/114.0e0 >= 0.5e0 AS half FROM items), p AS (SELECT photo, count(DISTINCT source) AS s, count(DISTINCT half) AS hv, count(DISTINCT photo) AS ph FROM f GROUP BY photo)
 SELECT 'source' AS fold_by, count(*) FILTER (WHERE s > 1) AS leaking, count(*) AS groups FROM p UNION ALL SELECT 'half', count(*) FILTER (WHERE hv > 1), count(*) FROM p UNION ALL SELECT 'photo', count(*) FILTER (WHERE ph > 1), count(*) FROM p""")
def fold_leak_check(t):
    """Photos that would sit on both sides of a fold, for three ways of folding."""
    f = t.items().select("photo", "source", ((F.col("x0") + F.col("x1")) / 2 / 114.0 >= 0.5).alias("half"))
    span = lambda c: F.min(c) != F.max(c)
    p = f.groupBy("photo").agg(span("source").alias("source"), span(F.col("half").cast("int")).alias("half"), span("photo").alias("by_photo"))
    long = p.select(F.explode(F.array(*[F.struct(F.lit(n).alias("fold_by"), F.col(c).alias("leak")) for n, c in (("source", "source"), ("half", "half"), ("photo", "by_photo"))])).alias("s")).select("s.*")
    return long.groupBy("fold_by").agg(F.count_if("leak").alias("leaking"), F.count(F.lit(1)).alias("groups"))


HELD_OUT = (1, 7)
FOLDS = f"""fo AS (SELECT item, photo, source % 4 <> 3 AS lic, 's'||source AS source, 'p'||photo AS by_photo, {GROUPS} AS capture, CASE WHEN (x0+x1)/2/114.0e0 >= 0.5e0 THEN 'right' ELSE 'left' END AS half,
 CASE WHEN source % 4 = 3 THEN 'unlicensed' END AS licensed, CASE WHEN source IN {HELD_OUT} THEN 'held' END AS listed FROM items)"""
MODES = ["source", "by_photo", "capture", "half", "licensed", "listed"]


def fold_modes() -> dict:
    """The fold an item is tested in: its source, photo, capture group or half; what has no licence; what is on a list."""
    s = F.col("source").cast("string")
    return {
        "source": F.concat(F.lit("s"), s),
        "by_photo": F.concat(F.lit("p"), F.col("photo").cast("string")),
        "capture": F.when(F.col("source").isin(3, 4), "twins").otherwise(F.concat(F.lit("s"), s)),
        "half": F.when((F.col("x0") + F.col("x1")) / 2 / 114.0 >= 0.5, "right").otherwise("left"),
        "licensed": F.when(F.col("source") % 4 == 3, "unlicensed"),
        "listed": F.when(F.col("source").isin(*HELD_OUT), "held"),
    }


_LONG = f"""fl AS (SELECT item, photo, lic, mode, fold FROM (SELECT item, photo, lic, unnest(['{"','".join(MODES)}']) AS mode, unnest([{', '.join(MODES)}]) AS fold FROM fo))"""


@query("fold_sizes", f"""WITH {ITEMS}, {FOLDS}, {_LONG}, tt AS (SELECT mode, count(*) FILTER (WHERE lic) AS al FROM fl GROUP BY mode)
 SELECT mode, fold, count(*) AS n_test, max(al) - count(*) FILTER (WHERE lic) AS n_train FROM fl JOIN tt USING (mode) WHERE fold IS NOT NULL GROUP BY mode, fold""")
def fold_sizes(t):
    """Test and training size of every fold of six ways of folding; only licensed items are trained on."""
    return P.fold_sizes(t.items(), fold_modes(), F.col("source") % 4 != 3)


@query("fold_roles", f"""WITH {ITEMS}, {FOLDS} SELECT item, source AS by_source, capture AS by_capture, half AS by_half, CASE WHEN licensed IS NOT NULL THEN 'test' WHEN lic THEN 'train' ELSE 'none' END AS in_licensed,
 CASE WHEN listed IS NOT NULL THEN 'test' WHEN lic THEN 'train' ELSE 'none' END AS in_listed, CASE WHEN half='left' THEN 'test' WHEN lic THEN 'train' ELSE 'none' END AS in_left, CASE WHEN lic THEN 'train' ELSE 'none' END AS in_final FROM fo""")
def fold_roles(t):
    """The folds every item is tested in, and its role in four folds of a single test set each; the final fold tests nothing."""
    m, may = fold_modes(), F.col("source") % 4 != 3
    role = lambda mode, fold: P.fold_role(m[mode] if mode else F.lit(None).cast("string"), F.lit(fold), may)
    return t.items().select("item", m["source"].alias("by_source"), m["capture"].alias("by_capture"), m["half"].alias("by_half"), role("licensed", "unlicensed").alias("in_licensed"),
                            role("listed", "held").alias("in_listed"), role("half", "left").alias("in_left"), role(None, "final").alias("in_final"))


@query("fold_leaks", f"""WITH {ITEMS}, {FOLDS}, {_LONG}, g AS (SELECT mode, photo, count(DISTINCT coalesce(fold, '-')) AS k FROM fl GROUP BY mode, photo)
 SELECT mode, count(*) AS groups, count(*) FILTER (WHERE k > 1) AS leaking FROM g GROUP BY mode""")
def fold_leaks(t):
    """Photos that six ways of folding put on both sides of a fold."""
    return P.fold_leaks(t.items(), fold_modes(), "photo")


@query("calibration_draw", f"""WITH {LOTS}, b AS (SELECT item, lot, year*10+line%5 AS photo, code AS y FROM lots WHERE code <> 2), per AS (SELECT lot, photo, count(*) FILTER (WHERE y=0) AS g, count(*) FILTER (WHERE y=1) AS d, {h('photo', 'cal')} AS o FROM b GROUP BY lot, photo),
 r1 AS (SELECT *, coalesce(sum(g) OVER (PARTITION BY lot ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS gb FROM per), r2 AS (SELECT *, g > 0 AND gb < 10 AS fst FROM r1),
 r3 AS (SELECT *, coalesce(sum(d) FILTER (WHERE fst) OVER (PARTITION BY lot),0) AS d0, coalesce(sum(CASE WHEN fst THEN 0 ELSE d END) OVER (PARTITION BY lot ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS db FROM r2),
 r4 AS (SELECT *, fst OR d0+db < 10 AS chosen FROM r3), ok AS (SELECT lot FROM r4 WHERE chosen GROUP BY lot HAVING sum(g) >= 10 AND sum(d) >= 10),
 it AS (SELECT b.item, b.lot, b.y, chosen FROM b JOIN r4 ON b.lot=r4.lot AND b.photo=r4.photo WHERE b.lot IN (SELECT lot FROM ok)), rk AS (SELECT *, row_number() OVER (PARTITION BY lot, y, chosen ORDER BY {h('item', 'cal')}) AS rn FROM it)
 SELECT lot, CASE WHEN chosen AND rn <= 10 THEN 'cal' WHEN chosen THEN 'unused' ELSE 'test' END AS role, y, count(*) AS n, min(item) AS first_item FROM rk GROUP BY 1, 2, 3""")
def calibration_draw(t):
    """Ten good and ten defect items per lot from a few photos; their photos leave the test set."""
    b = t.lots().where("code <> 2").select("item", "lot", (F.col("year") * 10 + F.col("line") % 5).alias("photo"), F.col("code").alias("y"))
    d = P.calibration_draw(b, "lot", "photo", "item", "y", 20, "cal")
    return d.groupBy("lot", "role", "y").agg(F.count(F.lit(1)).alias("n"), F.min("item").alias("first_item"))


@query("n_per_group", f"""WITH {SCORES}, r AS (SELECT event_id, source, row_number() OVER (PARTITION BY source ORDER BY {h('event_id', '100')}) AS rn FROM scores) SELECT event_id, source FROM r WHERE rn <= 100""")
def n_per_group(t):
    return P.sample_k(t.scores().select("event_id", "source"), ["source"], "event_id", "100", 100)


@query("top_mixed_groups", f"""WITH {LOTS}, g AS (SELECT photo, count(*) FILTER (WHERE code=0) > 0 AND count(*) FILTER (WHERE code=1) > 0 AS mixed, count(*) AS n FROM lots GROUP BY photo) SELECT photo, mixed, n FROM g ORDER BY mixed DESC, n DESC, photo DESC LIMIT 3""")
def top_mixed_groups(t):
    g = t.lots().groupBy("photo").agg(((F.count_if(F.col("code") == 0) > 0) & (F.count_if(F.col("code") == 1) > 0)).alias("mixed"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("mixed"), F.desc("n"), F.desc("photo")).limit(3)


@query("first_k_per_group", """WITH r AS (SELECT s_suppkey, s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS rn FROM supplier WHERE s_acctbal > 0) SELECT s_nationkey, s_suppkey, s_name FROM r WHERE rn <= 5""")
def first_k_per_group(t):
    s = t.supplier.where("s_acctbal > 0").select("s_nationkey", "s_suppkey", "s_name")
    return P.first_k(s, ["s_nationkey"], [F.col("s_name")], 5)


HISTORY = """ha AS (SELECT user_id AS "user", CAST(json_extract_string(props,'$.k') AS INTEGER) AS id, event_id, ts, value, event_type='signup' AS wipe FROM events), hw AS (SELECT *, max(CASE WHEN wipe THEN (ts, event_id) END) OVER (PARTITION BY "user") AS w FROM ha),
 hk AS (SELECT "user", id, event_id, ts, value FROM hw WHERE NOT wipe AND (w IS NULL OR (ts, event_id) > w)), hl AS (SELECT *, row_number() OVER (PARTITION BY "user", id ORDER BY ts DESC, event_id DESC) AS r1 FROM hk),
 hn AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS r2 FROM hl WHERE r1=1)"""


def new_start():
    """A sign-up wipes what the user had."""
    return F.col("event_type") == "signup"


def last_five(events):
    """Newest record per (user, id) since the user's last wipe, then the newest five per user."""
    x = events.select(F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("int").alias("id"), "event_id", "ts", "value", new_start().alias("wipe"))
    wipes = x.where("wipe").groupBy("user").agg(F.max(F.struct("ts", "event_id")).alias("w"))
    latest = x.where("wipe IS NOT TRUE").groupBy("user", "id").agg(F.max(F.struct("ts", "event_id", "value")).alias("r"))
    since = latest.join(wipes, "user", "left").where("w IS NULL OR struct(r.ts, r.event_id) > w")
    return P.first_k(since.select("user", "id", "r.*"), ["user"], [F.desc("ts"), F.desc("event_id")], 5)


@query("last_n", f"""WITH {HISTORY} SELECT "user", id, event_id, ts, value FROM hn WHERE r2 <= 5""")
def last_n(t):
    return last_five(t.events)


@query("sweep_grid", f"""WITH {SCORES}, tg AS (SELECT unnest([0.50e0,0.55e0,0.60e0,0.65e0,0.70e0,0.75e0]) AS tg) SELECT source, tg, count(*) FILTER (WHERE p_good >= tg) AS good, count(*) FILTER (WHERE p_good < tg AND 1-p_good >= 0.91e0) AS defect, count(*) FILTER (WHERE p_good < tg AND 1-p_good < 0.91e0) AS unsure FROM scores, tg GROUP BY source, tg""")
def sweep_grid(t):
    """Every candidate threshold on every source, counted in one pass over the rows."""
    s, p = t.scores(), F.col("p_good")
    cols = []
    for i, tg in enumerate(C.T_CANDIDATES):
        cols += [F.count_if(p >= tg).alias(f"g{i}"), F.count_if((p < tg) & (1 - p >= C.T_DEFECT)).alias(f"d{i}"), F.count_if((p < tg) & (1 - p < C.T_DEFECT)).alias(f"u{i}")]
    wide = s.groupBy("source").agg(*cols)
    cand = F.explode(F.array(*[F.struct(F.lit(v).alias("tg"), F.col(f"g{i}").alias("good"), F.col(f"d{i}").alias("defect"), F.col(f"u{i}").alias("unsure")) for i, v in enumerate(C.T_CANDIDATES)]))
    return wide.select("source", cand.alias("c")).select("source", "c.*")


@query("choose_artifact", """WITH a AS (SELECT p_brand AS family, p_name, p_partkey, p_size*1000 AS bytes, 0.97e0+(p_partkey*7919%31)/1000 AS agreement FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY bytes, p_partkey) AS rn, max(bytes) OVER (PARTITION BY family) AS full_bytes FROM a WHERE agreement >= 0.99e0)
 SELECT f.family, coalesce(k.p_partkey, -1) AS artifact, k.bytes, k.p_partkey IS NULL AS fallback FROM (SELECT DISTINCT family FROM a) f LEFT JOIN (SELECT * FROM k WHERE rn=1) k USING (family)""")
def choose_artifact(t):
    """Smallest file that agrees on at least 99 % of the calls; the full file when none does."""
    a = t.part.select(F.col("p_brand").alias("family"), "p_partkey", (F.col("p_size") * 1000).alias("bytes"), (F.lit(0.97) + (F.col("p_partkey") * 7919 % 31) / 1000).alias("agreement"))
    best = a.where("agreement >= 0.99D").groupBy("family").agg(F.min(F.struct("bytes", "p_partkey")).alias("b"))
    out = a.select("family").distinct().join(best, "family", "left")
    return out.select("family", F.coalesce("b.p_partkey", F.lit(-1).cast("long")).alias("artifact"), F.col("b.bytes").alias("bytes"), F.col("b").isNull().alias("fallback"))
