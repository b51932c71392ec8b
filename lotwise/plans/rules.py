"""Labels, item rules, photo rules and calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import hot_groups
from lotwise.operators import calls as K
from lotwise.operators import gates as G
from lotwise.operators import labels as L
from lotwise.operators import privacy as P
from lotwise.operators import verdict as V
from lotwise.plans import photos as PH
from lotwise.plans.registry import query
from lotwise.plans.sqltext import EMB, ITEMS, LOTS, SCORES, r6, verdict

TYPE_MAP = {"economy": "broken", "small": "insect", "medium": "good", "promo": "other_defect", "standard": "good", "large": "dark"}
_CASE = "CASE lower(p_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TYPE_MAP.items()) + " END"


@query("label_map", f"SELECT {_CASE} AS class, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def label_map(t):
    return t.part.groupBy(L.map_label("p_type", TYPE_MAP).alias("class"), "p_type").agg(F.count(F.lit(1)).alias("n"))


UNTYPED = [(0, "R"), (3, "A"), (7, "N")]


@query("relabel_untyped", f"""WITH {LOTS} SELECT source, flag, CASE WHEN (source=0 AND flag='R') OR (source=3 AND flag='A') OR (source=7 AND flag='N') THEN 'defect_untyped'
 WHEN code=0 THEN 'good' ELSE 'other_defect' END AS kind, count(*) AS n FROM lots GROUP BY 1, 2, 3""")
def relabel_untyped(t):
    kind = F.when(F.col("code") == 0, "good").otherwise("other_defect")
    k = L.relabel_pairs(F.col("source"), F.col("flag"), kind, UNTYPED, "defect_untyped")
    return t.lots().groupBy("source", "flag", k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("exclusive_label_set", """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day, event_type FROM events),
 s AS (SELECT user_id, day, list(event_type) FILTER (WHERE event_type NOT IN ('view')) AS rest FROM d GROUP BY user_id, day),
 k AS (SELECT day, CASE WHEN rest IS NULL THEN 'healthy' WHEN len(rest)=1 AND rest[1]='error' THEN 'rust' WHEN len(rest)=1 AND rest[1]='click' THEN 'miner' ELSE 'dropped' END AS label FROM s)
 SELECT CAST(day AS VARCHAR) AS day, label, count(*) AS n FROM k GROUP BY day, label""")
def exclusive_label_set(t):
    sets = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("labels"))
    lab = L.exclusive_label(F.col("labels"), "view", {"error": "rust", "click": "miner"})
    return sets.groupBy(F.col("day").cast("string").alias("day"), F.coalesce(lab, F.lit("dropped")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


TWINS = {"src1": "twins", "src11": "twins", "src4": "pair", "src14": "pair"}


@query("alias_group", """SELECT CASE WHEN source IN ('src1','src11') THEN 'twins' WHEN source IN ('src4','src14') THEN 'pair' ELSE source END AS capture,
 count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY 1""")
def alias_group(t):
    g = L.capture_group(F.col("source"), TWINS)
    return t.documents.groupBy(g.alias("capture")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


@query("licensed_split", """WITH j AS (SELECT CASE WHEN coalesce(s_acctbal >= 4000, FALSE) THEN 'train' ELSE 'test_only' END AS role, l_suppkey, l_quantity, s_acctbal
 FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)
 SELECT role, count(*) AS n, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (WHERE role='train' AND s_acctbal < 4000) AS leaked FROM j GROUP BY role""")
def licensed_split(t):
    reg = t.supplier.withColumnRenamed("s_suppkey", "l_suppkey")
    out = L.licence_split(t.lineitem.select("l_suppkey"), reg, "l_suppkey", F.col("s_acctbal") >= 4000)
    bad = reg.where(F.col("s_acctbal") < 4000).select("l_suppkey", F.lit(True).alias("bad"))
    per = out.groupBy("role", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(bad, "l_suppkey", "left")
    return per.groupBy("role").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources"),
        F.coalesce(F.sum(F.when((F.col("role") == "train") & F.col("bad"), F.col("n"))), F.lit(0)).alias("leaked"))


@query("group_from_name", r"""WITH a AS (SELECT page_id, regexp_replace(url, '/+$', '') AS u FROM pages), b AS (SELECT page_id, string_split(u, '/')[-1] AS leaf FROM a)
 SELECT page_id, CASE WHEN regexp_extract(leaf, '^([A-Za-z0-9_-]+)([.?#].*)?$', 1) = '' THEN leaf ELSE regexp_extract(leaf, '^([A-Za-z0-9_-]+)([.?#].*)?$', 1) END AS grp FROM b""")
def group_from_name(t):
    return t.pages.select("page_id", L.group_from_name(F.col("url")).alias("grp"))


@query("item_qc", f"""WITH {ITEMS}, med AS (SELECT photo, median(area) AS med, 70.0e0+max(part)%100 AS sheet_luma FROM items GROUP BY photo),
 q AS (SELECT photo, sheet_luma < 120 AS rejected, area/nullif(med,0) BETWEEN 0.4e0 AND 2.5e0 AND x0 > 2 AND y0 > 2 AND x1 < 112 AND y1 < 112 AS ok FROM items JOIN med USING (photo))
 SELECT photo, rejected, count(*) AS found, count(*) FILTER (WHERE ok AND NOT rejected) AS kept, count(*) FILTER (WHERE NOT ok AND NOT rejected) AS dropped_qc FROM q GROUP BY photo, rejected""")
def item_qc(t):
    items = t.items()
    sheet = items.groupBy("photo").agg((70.0 + F.max("part") % 100).alias("sheet_luma"))
    q = G.item_qc(items.join(sheet, "photo"), "photo", PH.FRAME, PH.FRAME)
    return q.groupBy("photo", "rejected").agg(
        F.count(F.lit(1)).alias("found"), F.count_if(F.col("ok") & ~F.col("rejected")).alias("kept"),
        F.count_if(~F.col("ok") & ~F.col("rejected")).alias("dropped_qc"))


@query("component_filter", f"""WITH {ITEMS}, p AS (SELECT photo, quantile_cont(area, 0.9) AS p90 FROM items GROUP BY photo),
 m AS (SELECT photo, median(area) AS med FROM items JOIN p USING (photo) WHERE area >= greatest(30.0e0, 0.15e0*p90) GROUP BY photo)
 SELECT photo, count(*) AS kept, count(*) FILTER (WHERE area > 1.8e0*med) AS merged, {r6('max(med)')} AS median_area FROM items JOIN m USING (photo)
 WHERE area >= 0.25e0*med AND x0 > 0 AND y0 > 0 AND x1 < 114 AND y1 < 114 GROUP BY photo""")
def component_filter(t):
    k = G.component_filter(t.items(), "photo", PH.FRAME, PH.FRAME)
    return k.groupBy("photo").agg(F.count(F.lit(1)).alias("kept"), F.count_if("merged").alias("merged"), fn.r6(F.max("med")).alias("median_area"))


@query("photo_checks", f"WITH {PH.CHECKS} SELECT photo, count, touching, sheet_luma, blur_var, too_dark, too_blurry, count_ok, too_many_touching FROM checks")
def photo_checks(t):
    return PH.checks(t).select("photo", "count", "touching", "sheet_luma", "blur_var", "too_dark", "too_blurry", "count_ok", "too_many_touching")


@query("gate_v2", f"WITH {PH.PHOTOS} SELECT photo, {PH.GATE_V2} AS gate FROM photos")
def gate_v2(t):
    return PH.photo_table(t).select("photo", G.gate_v2().alias("gate"))


@query("gate_v1", f"WITH {PH.PHOTOS} SELECT photo, {PH.GATE_V1} AS gate, {PH.GATE_V1.replace(chr(39)+'not_green'+chr(39), chr(39)+chr(39)).replace('WHEN not_green THEN '+chr(39)*2, '')} AS gate_no_colour FROM photos")
def gate_v1(t):
    return PH.photo_table(t).select("photo", G.gate_v1().alias("gate"), G.gate_v1(with_colour=False).alias("gate_no_colour"))


@query("screen", f"""WITH {PH.PHOTOS}, g AS (SELECT *, {PH.GATE_V2} AS gate FROM photos)
 SELECT photo, CASE WHEN gate='not_green' AND colour_reason='too_dark_items' AND is_dark_lot AND NOT too_many_touching AND count BETWEEN 20 AND 160 THEN 'unsure:dark_lot'
 WHEN gate <> '' THEN 'retake:'||gate ELSE 'score' END AS screen FROM g""")
def screen(t):
    return PH.photo_table(t).select("photo", G.screen().alias("screen"))


PARTS = """items AS (SELECT p_partkey, 40.0e0+(p_partkey*37)%200 AS r, (40.0e0+(p_partkey*37)%200)*(70+p_partkey%30)/100 AS g, (40.0e0+(p_partkey*37)%200)*(40+(p_partkey*7)%60)/100 AS b FROM part)"""


def part_colours(t):
    pk = F.col("p_partkey")
    r = 40.0 + (pk * 37) % 200
    return t.part.select("p_partkey", r.alias("r"), (r * (70 + pk % 30) / 100).alias("g"), (r * (40 + (pk * 7) % 60) / 100).alias("b"))


@query("colour_class", f"WITH {PARTS}, {PH.HSV} SELECT p_partkey, cls FROM hsv")
def colour_class(t):
    return fn.with_hsv(part_colours(t)).select("p_partkey", fn.colour_class("h", "s", "v").alias("cls"))


@query("rgb_hsv", f"""WITH {PARTS}, {PH.HSV} SELECT p_partkey, {r6('h')} AS h, {r6('s')} AS s, {r6('v')} AS v, {r6('0.299e0*r+0.587e0*g+0.114e0*b')} AS luma,
 {r6('greatest(r,g,b)-least(r,g,b)')} AS chroma FROM hsv""")
def rgb_hsv(t):
    return fn.with_hsv(part_colours(t)).select(
        "p_partkey", *[fn.r6(c).alias(c) for c in "hsv"], fn.r6(fn.luma("r", "g", "b")).alias("luma"), fn.r6(fn.chroma("r", "g", "b")).alias("chroma"))


@query("white_balance", f"""WITH {PARTS}, ref AS (SELECT quantile_cont(r,0.9) AS rr, quantile_cont(g,0.9) AS rg, quantile_cont(b,0.9) AS rb FROM items)
 SELECT p_partkey, {r6('greatest(0.0e0,least(255.0e0,r*(235.0e0/greatest(rr,1.0e0))))')} AS r, {r6('greatest(0.0e0,least(255.0e0,g*(235.0e0/greatest(rg,1.0e0))))')} AS g,
 {r6('greatest(0.0e0,least(255.0e0,b*(235.0e0/greatest(rb,1.0e0))))')} AS b FROM items, ref""")
def white_balance(t):
    from lotwise.functions.scale import exact_quantiles, one_row

    c = part_colours(t)
    ref = {ch: one_row(exact_quantiles(c, [], ch, {"q": 0.9}))["q"] for ch in "rgb"}
    return c.select("p_partkey", *[fn.r6(fn.white_balance(ch, ref[ch])).alias(ch) for ch in "rgb"])


@query("colour_gate", f"WITH {ITEMS}, {PH.COLOUR} SELECT photo, colour_reason, not_green, used, {r6('frac_pale')} AS frac_pale, {r6('frac_dark')} AS frac_dark, {r6('frac_white')} AS frac_white, {r6('frac_off')} AS frac_off, {r6('largest_blob')} AS largest_blob FROM colour")
def colour_gate(t):
    g = G.colour_gate(t.items(), "photo", PH.FRAME_AREA)
    return g.select("photo", "colour_reason", "not_green", "used", *[fn.r6(c).alias(c) for c in ("frac_pale", "frac_dark", "frac_white", "frac_off", "largest_blob")])


@query("dark_lot", f"WITH {ITEMS}, {PH.COLOUR} SELECT photo, why, is_dark_lot, {r6('shaped')} AS shaped, {r6('area_cv')} AS area_cv, {r6('dark_hue')} AS dark_hue, {r6('dark_sat')} AS dark_sat FROM darklot")
def dark_lot(t):
    items = t.items()
    hot = hot_groups(items, ["photo"])
    d = G.dark_lot(items, G.colour_gate(items, "photo", PH.FRAME_AREA, hot), "photo", hot)
    return d.select("photo", "why", "is_dark_lot", *[fn.r6(c).alias(c) for c in ("shaped", "area_cv", "dark_hue", "dark_sat")])


TOUCH = """med AS (SELECT photo, median(area) AS median_area FROM items GROUP BY photo),
 one AS (SELECT photo, median(area) AS sm, count(*) AS ns FROM items WHERE solidity >= 0.93e0 AND fill >= 0.93e0 AND elong <= 2.2e0 GROUP BY photo),
 st AS (SELECT med.photo, median_area, CASE WHEN ns >= 5 THEN sm ELSE median_area END AS single_area FROM med LEFT JOIN one USING (photo)),
 marked AS (SELECT items.*, median_area, single_area, CASE WHEN area > 1.8e0*median_area THEN 'area_median' WHEN single_area > 0 AND area > 1.6e0*single_area THEN 'area_single'
  WHEN solidity < 0.8e0 THEN 'solidity' WHEN fill < 0.85e0 THEN 'fill' ELSE '' END AS why FROM items JOIN st USING (photo))"""


@query("touching_rule", f"WITH {ITEMS}, {TOUCH} SELECT photo, why, count(*) AS n, {r6('max(single_area)')} AS single_area FROM marked GROUP BY photo, why")
def touching_rule(t):
    m = G.touching_rule(t.items(), "photo")
    return m.groupBy("photo", "why").agg(F.count(F.lit(1)).alias("n"), fn.r6(F.max("single_area")).alias("single_area"))


@query("hidden_items", f"""WITH {ITEMS}, {TOUCH}, {PH.HSV.replace('FROM items)', 'FROM marked)')},
 h2 AS (SELECT *, floor(area/nullif(single_area,0)+0.5e0) AS held FROM hsv), a AS (SELECT photo, count(*) AS n, count(*) FILTER (WHERE why<>'') AS n_touch,
 count(*) FILTER (WHERE why<>'' AND held>=3 AND cls IN ('pale','dark')) AS clumps, CAST(coalesce(sum(held) FILTER (WHERE why<>'' AND held>=3 AND cls IN ('pale','dark')),0) AS BIGINT) AS hidden FROM h2 GROUP BY photo)
 SELECT *, n-clumps+hidden AS equiv, n_touch > greatest(2.0e0,0.08e0*greatest(n,1)) OR hidden > greatest(2.0e0,0.08e0*greatest(n-clumps+hidden,1)) AS too_many_touching FROM a""")
def hidden_items(t):
    return G.hidden_items(G.touching_rule(t.items(), "photo"), "photo")


@query("flag_before_after", f"""WITH {ITEMS}, {TOUCH} SELECT touching AS truly_merged, why, count(*) AS n, count(*) FILTER (WHERE why='area_median') AS flagged_before, count(*) FILTER (WHERE why<>'') AS flagged_after,
 count(*) FILTER (WHERE (why='area_median') <> (why<>'')) AS changed FROM marked GROUP BY touching, why""")
def flag_before_after(t):
    """Old flag (area alone) next to the full touching rule, on single and on merged items."""
    m = G.touching_rule(t.items(), "photo")
    old, new = F.col("why") == "area_median", F.col("why") != ""
    return m.groupBy(F.col("touching").alias("truly_merged"), "why").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(old).alias("flagged_before"), F.count_if(new).alias("flagged_after"), F.count_if(old != new).alias("changed"))


@query("call_argmax", f"""WITH {EMB} SELECT vec_id, CASE WHEN e[64] > 0.2e0 OR list_max(p) < 0.35e0 THEN 'unsure'
 ELSE ['good','dark','insect','broken','unhulled','other_defect'][list_position(p, list_max(p))] END AS call, {r6('list_max(p)')} AS conf FROM emb""")
def call_argmax(t):
    e = t.emb().withColumn("p", fn.softmax("logits"))
    return e.select("vec_id", K.call_argmax("p", F.element_at("e", 64) > 0.2, 0.35).alias("call"), fn.r6(F.array_max("p")).alias("conf"))


CALL = "CASE WHEN p_good IS NULL OR touching THEN 2 WHEN p_good >= 0.55e0 THEN 0 WHEN 1-p_good >= 0.91e0 THEN 1 ELSE 2 END"


@query("call_pair", f"WITH {SCORES} SELECT event_id, {CALL} AS code, CASE WHEN touching THEN 2 WHEN 1-p_good >= 0.91e0 THEN 1 ELSE 2 END AS defect_only FROM scores")
def call_pair(t):
    return t.scores().select("event_id", K.call_pair("p_good", "touching").alias("code"), K.call_pair("p_good", "touching", tg=None).alias("defect_only"))


@query("likely_type", f"WITH {EMB} SELECT vec_id, ['dark','insect','broken','unhulled','other_defect'][list_position(p[2:6], list_max(p[2:6]))] AS kind FROM emb")
def likely_type(t):
    return t.emb().select("vec_id", K.likely_type(fn.softmax("logits")).alias("kind"))


@query("threshold_defaults", """WITH k AS (SELECT event_id, CASE WHEN json_extract_string(props,'$.k') LIKE '%7' THEN 'n/a' WHEN json_extract_string(props,'$.k') LIKE '%3' THEN 'NaN'
 WHEN json_extract_string(props,'$.k') LIKE '%9' THEN NULL ELSE json_extract_string(props,'$.k') END AS raw FROM events),
 d AS (SELECT event_id, TRY_CAST(raw AS DOUBLE) AS x FROM k) SELECT event_id, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.55e0 ELSE x END AS good, CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0.91e0 ELSE x END AS defect FROM d""")
def threshold_defaults(t):
    k = F.get_json_object("props", "$.k")
    raw = F.when(k.endswith("7"), "n/a").when(k.endswith("3"), "NaN").when(k.endswith("9"), F.lit(None).cast("string")).otherwise(k)
    return t.events.select("event_id", raw.alias("raw")).select(
        "event_id", K.finite_or("raw", C.T_GOOD).alias("good"), K.finite_or("raw", C.T_DEFECT).alias("defect"))


@query("call_override", f"""WITH {SCORES} SELECT event_id, CASE WHEN touching THEN 2 WHEN value/100 < 0.3e0 THEN 1 WHEN p_good >= 0.55e0 THEN 0 WHEN 1-p_good >= 0.91e0 THEN 1 ELSE 2 END AS code FROM scores""")
def call_override(t):
    return t.scores().select("event_id", K.call_override("p_good", F.col("value") / 100, "touching").alias("code"))


UNFAM_Q = [0.90, 0.95, 0.99]


@query("unfamiliar_to_unsure", f"""WITH {LOTS}, q AS (SELECT unnest([90,95,99]) AS pct, unnest([quantile_cont(price,0.9), quantile_cont(price,0.95), quantile_cont(price,0.99)]) AS tau FROM lots),
 x AS (SELECT pct, lot, CASE WHEN price > tau THEN 2 ELSE code END AS code FROM lots, q), v AS ({verdict('x', 'pct, lot')})
 SELECT CAST(pct AS INTEGER) AS pct, band, reason, count(*) AS lots, CAST(sum(unsure) AS BIGINT) AS unsure FROM v GROUP BY 1, 2, 3""")
def unfamiliar_to_unsure(t):
    """Items farther out than a quantile of the distances become unsure, then the lot rule decides again."""
    from lotwise.functions.scale import exact_quantiles, one_row

    lots = t.lots()
    q = exact_quantiles(lots, [], "price", {f"q{int(x * 100)}": x for x in UNFAM_Q})
    one = one_row(q)
    tau = F.explode(F.array(*[F.struct(F.lit(int(x * 100)).alias("pct"), one[f"q{int(x * 100)}"].alias("tau")) for x in UNFAM_Q]))
    x = lots.select("lot", "code", "price", tau.alias("s")).select("lot", "price", "s.*", F.when(F.col("price") > F.col("s.tau"), 2).otherwise(F.col("code")).alias("code"))
    v = V.lot_verdict(x, ["pct", "lot"])
    return v.groupBy("pct", "band", "reason").agg(F.count(F.lit(1)).alias("lots"), F.sum("unsure").alias("unsure"))


@query("redact_unsure", f"""WITH {LOTS}, v AS ({verdict('lots', 'lot, year')}) SELECT lot, year, total, band, CASE WHEN band<>'unsure' THEN good END AS good, CASE WHEN band<>'unsure' THEN defects END AS defects,
 CASE WHEN band<>'unsure' THEN unsure END AS unsure, CASE WHEN band<>'unsure' THEN {r6('lo')} END AS lo, CASE WHEN band<>'unsure' THEN {r6('hi')} END AS hi, CASE WHEN band<>'unsure' THEN about END AS about FROM v""")
def redact_unsure(t):
    v = V.lot_verdict(t.lots(), ["lot", "year"]).withColumns({"lo": fn.r6("lo"), "hi": fn.r6("hi")})
    return P.redact_unsure(v, ["lot", "year", "total", "band"], ["good", "defects", "unsure", "lo", "hi", "about"])


_AR = lambda x: f"translate(CAST({x} AS VARCHAR), '0123456789', '{C.ARABIC_DIGITS}')"
_DL = _AR("strftime(day, '%-d/%-m/%y')")
_DS = _AR("strftime(day, '%-d/%-m')")
_BAD = f"CASE WHEN defects > 0 THEN {_AR('defects')}||' فيها عيب' ELSE 'ما فيه عيوب' END"
_VAG = f"CASE WHEN unsure > 0 THEN '، '||{_AR('unsure')}||' مش واضحة' ELSE '' END"


def _body(d, v):
    return f"{d}||': '||{_AR('total')}||' حبة، '||{_BAD}||{v}||'. {C.SLIP_TAG}'"


@query("slip_text", f"""WITH {LOTS}, l2 AS (SELECT *, date_trunc('month', ts) AS day FROM lots), v AS ({verdict('l2', 'lot, day')}),
 s AS (SELECT lot, day, band, {_body(_DL, _VAG)} AS a, {_body(_DS, _VAG)} AS b, {_body(_DS, "''")} AS c,
 {_DL}||': {C.SLIP_UNSURE}، '||{_AR('total')}||' حبة. {C.SLIP_TAG}' AS ua, {_DS}||': {C.SLIP_UNSURE}، '||{_AR('total')}||' حبة. {C.SLIP_TAG}' AS ub FROM v)
 SELECT lot, CAST(CAST(day AS DATE) AS VARCHAR) AS month, CASE WHEN band='unsure' THEN CASE WHEN length(ua) <= 70 THEN ua ELSE ub END WHEN length(a) <= 70 THEN a WHEN length(b) <= 70 THEN b ELSE c END AS slip FROM s""")
def slip_text(t):
    lots = t.lots().withColumn("day", F.date_trunc("month", "ts"))
    v = V.lot_verdict(lots, ["lot", "day"])
    return v.select("lot", F.to_date("day").cast("string").alias("month"),
                    P.slip_text(F.col("day"), F.col("total"), F.col("defects"), F.col("unsure"), F.col("band") == "unsure").alias("slip"))


@query("spatial_half", f"""WITH {ITEMS}, g AS (SELECT item, (x0+x1)/2/114.0e0 AS cxn, (y0+y1)/2/114.0e0 AS cyn, CAST(floor(greatest(x1-x0, y1-y0)) AS BIGINT) AS side FROM items)
 SELECT item, {r6('cxn')} AS cx_norm, {r6('cyn')} AS cy_norm, side, 2*(side//2 + CAST(round_even(0.18e0*side, 0) AS BIGINT)) AS src_px, least(128, 2*(side//2 + CAST(round_even(0.18e0*side, 0) AS BIGINT))) AS eff_px,
 CASE WHEN cxn >= 0.5e0 THEN 1 ELSE 2 END AS test_fold FROM g""")
def spatial_half(t):
    side = F.floor(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    src = 2 * (F.floor(side / 2) + F.bround(side * 0.18).cast("long"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2 / PH.FRAME, (F.col("y0") + F.col("y1")) / 2 / PH.FRAME
    return t.items().select("item", fn.r6(cx).alias("cx_norm"), fn.r6(cy).alias("cy_norm"), side.alias("side"), src.alias("src_px"),
                            F.least(F.lit(128).cast("long"), src).alias("eff_px"), F.when(cx >= 0.5, 1).otherwise(2).alias("test_fold"))


_PERT = [("none", 1.0, 1.0, 1.0, 1.0)] + [(k, *v, 1.0) for k, v in C.PERTURBATIONS.items()] + [("exposure", *C.EXPOSURE_GAIN, C.EXPOSURE_GAMMA)]


@query("stress_cross", f"""WITH {ITEMS.replace('items AS (', 'base AS (')}, pert(pert, fr, fg, fb, gam) AS (VALUES {', '.join(f"('{n}', {a!r}e0, {b!r}e0, {c!r}e0, {g!r}e0)" for n, a, b, c, g in _PERT)}),
 items AS (SELECT pert, photo, area, 255*power(least(1.0e0, base.r/255*fr), gam) AS r, 255*power(least(1.0e0, g/255*fg), gam) AS g, 255*power(least(1.0e0, b/255*fb), gam) AS b FROM base, pert),
 {PH.HSV}, s AS (SELECT pert, photo, coalesce(sum(area) FILTER (WHERE cls='dark'),0)/sum(area) AS fd, coalesce(sum(area) FILTER (WHERE cls IN ('off','white')),0)/sum(area) AS fo FROM hsv GROUP BY pert, photo)
 SELECT pert, CASE WHEN fo > 0.5e0 THEN 'off_colour' WHEN fd > 0.6e0 THEN 'too_dark_items' ELSE '' END AS reason, count(*) AS photos FROM s GROUP BY 1, 2""")
def stress_cross(t):
    """The colour rules again under every channel perturbation (a handful of literal rows)."""
    pert = F.explode(F.array(*[F.struct(F.lit(n).alias("pert"), *[F.lit(v).alias(k) for k, v in zip(("fr", "fg", "fb", "gam"), vals)]) for n, *vals in _PERT]))
    ch = lambda c, f: (255 * F.pow(F.least(F.lit(1.0), F.col(c) / 255 * F.col(f"p.{f}")), F.col("p.gam"))).alias(c)
    x = t.items().withColumn("p", pert).select("p.pert", "photo", "area", ch("r", "fr"), ch("g", "fg"), ch("b", "fb"))
    x = fn.with_hsv(x).withColumn("cls", fn.colour_class("h", "s", "v"))
    share = lambda *c: F.coalesce(F.sum(F.when(F.col("cls").isin(*c), F.col("area"))), F.lit(0.0)) / F.sum("area")
    s = x.groupBy("pert", "photo").agg(share("dark").alias("fd"), share("off", "white").alias("fo"))
    k = C.COLOUR_RULE
    reason = F.when(F.col("fo") > k["max_off"], "off_colour").when(F.col("fd") > k["max_dark"], "too_dark_items").otherwise("")
    return s.groupBy("pert", reason.alias("reason")).agg(F.count(F.lit(1)).alias("photos"))


@query("text_prefix_hash", """SELECT doc_id, sha256(rtrim(string_split(text, chr(10)||chr(10))[1], chr(10))) AS frozen, sha256(text) <> sha256(rtrim(string_split(text, chr(10)||chr(10))[1], chr(10))) AS has_more FROM documents""")
def text_prefix_hash(t):
    """Hash of the frozen part of a text: everything before the first blank line."""
    block = F.regexp_replace(F.substring_index("text", "\n\n", 1), r"\n+\z", "")
    return t.documents.select("doc_id", F.sha2(block, 256).alias("frozen"), (F.sha2("text", 256) != F.sha2(block, 256)).alias("has_more"))


@query("valid_heads", """WITH h AS (SELECT s_suppkey AS head, sha256(n_name) AS model_sha, CASE WHEN s_suppkey % 9 = 0 THEN 32 ELSE 64 END AS embed_dim, CASE WHEN s_acctbal < 0 THEN CAST('NaN' AS DOUBLE) ELSE s_acctbal/10000 END AS m_hi
 FROM supplier JOIN nation ON s_nationkey=n_nationkey), m AS (SELECT sha256(n_name) AS model_sha FROM nation WHERE n_regionkey IN (1,2,3)), d AS (SELECT max(len(embedding)) AS dim FROM embeddings)
 SELECT head, h.model_sha, (round(m_hi+1e-10,6)+0.0e0) AS m_hi FROM h JOIN m ON h.model_sha=m.model_sha JOIN d ON h.embed_dim=d.dim WHERE NOT isnan(m_hi) AND NOT isinf(m_hi)""")
def valid_heads(t):
    """Stored heads that fit a known model file, the vector length in use, and a finite margin."""
    nat = t.nation.select("n_nationkey", "n_regionkey", F.sha2("n_name", 256).alias("model_sha"))
    heads = t.supplier.join(nat, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("head"), "model_sha", F.when(F.col("s_suppkey") % 9 == 0, 32).otherwise(64).alias("embed_dim"),
        F.when(F.col("s_acctbal") < 0, float("nan")).otherwise(F.col("s_acctbal") / 10000).alias("m_hi"))
    known = nat.where(F.col("n_regionkey").isin(1, 2, 3)).select("model_sha")
    dim = t.embeddings.agg(F.max(F.size("embedding")).alias("embed_dim"))
    ok = ~F.isnan("m_hi") & (F.abs("m_hi") != float("inf"))
    return heads.join(known, "model_sha", "left_semi").join(F.broadcast(dim), "embed_dim").where(ok).select("head", "model_sha", fn.r6("m_hi").alias("m_hi"))


@query("flip_first_k", f"""WITH {EMB}, r AS (SELECT vec_id, label < 4 AS is_good, row_number() OVER (PARTITION BY label < 4 ORDER BY vec_id) AS rn FROM emb)
 SELECT vec_id, CASE WHEN is_good = (rn > 3) THEN 'good' ELSE 'defect' END AS label, rn <= 3 AS flipped FROM r""")
def flip_first_k(t):
    """The first three items of each class get the other label."""
    from lotwise.operators.splits import first_k

    e = t.emb().select("vec_id", (F.col("label") < 4).alias("is_good"))
    flip = first_k(e, ["is_good"], [F.col("vec_id")], 3).select("vec_id", F.lit(True).alias("flipped"))
    out = e.join(flip, "vec_id", "left").withColumn("flipped", F.coalesce("flipped", F.lit(False)))
    return out.select("vec_id", F.when(F.col("is_good") != F.col("flipped"), "good").otherwise("defect").alias("label"), "flipped")
