"""Photo-level table (one supplier and year) shared by the rule and outcome queries, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scale import hot_groups
from lotwise.operators import gates as G
from lotwise.plans.sqltext import ITEMS
from lotwise.sources.tables import Tables

FRAME = 114.0
FRAME_AREA = FRAME * FRAME


def checks(t: Tables) -> DataFrame:
    """Photo checks: the sheet brightness and blur are read off the part numbers of the photo's items."""
    base = t.items().groupBy("photo", "lot", "year").agg(
        F.count(F.lit(1)).alias("count"),
        F.count_if("touching").alias("touching"),
        (70.0 + F.max("part") % 100).alias("sheet_luma"),
        (5.0 + F.min("part") % 50).alias("blur_var"),
    )
    return G.photo_checks(base)


def photo_table(t: Tables) -> DataFrame:
    items = t.items()
    hot = hot_groups(items, ["photo"])
    colour = G.colour_gate(items, "photo", FRAME_AREA, hot)
    dark = G.dark_lot(items, colour, "photo", hot).drop("colour_reason")
    return checks(t).join(colour, "photo").join(dark, "photo")


CHECKS = ITEMS + """, checks AS (SELECT *, sheet_luma < 90 AS too_dark, blur_var < 15 AS too_blurry, count BETWEEN 20 AND 160 AS count_ok,
 touching > greatest(2.0e0, 0.08e0*greatest(count,1)) AS too_many_touching FROM (
 SELECT photo, lot, year, count(*) AS count, count(*) FILTER (WHERE touching) AS touching, 70.0e0+max(part)%100 AS sheet_luma, 5.0e0+min(part)%50 AS blur_var
 FROM items GROUP BY photo, lot, year))"""

HSV = """hsv0 AS (SELECT *, greatest(r,g,b)/255.0e0 AS v, least(r,g,b)/255.0e0 AS lov, r/255.0e0 AS rr, g/255.0e0 AS gg, b/255.0e0 AS bb FROM items),
 hsv1 AS (SELECT *, CASE WHEN v=lov THEN 0.0e0 ELSE (v-lov)/v END AS s, CASE WHEN v=lov THEN 0.0e0
   WHEN rr=v THEN ((v-bb)/(v-lov)-(v-gg)/(v-lov))/6.0e0 WHEN gg=v THEN (2.0e0+(v-rr)/(v-lov)-(v-bb)/(v-lov))/6.0e0
   ELSE (4.0e0+(v-gg)/(v-lov)-(v-rr)/(v-lov))/6.0e0 END AS h6 FROM hsv0),
 hsv AS (SELECT *, CASE WHEN v < 0.3e0 THEN 'dark' WHEN s < 0.15e0 AND v >= 0.6e0 THEN 'white' WHEN h < 26 OR h > 62 OR s > 0.66e0 THEN 'off' ELSE 'pale' END AS cls
   FROM (SELECT *, (h6-floor(h6))*360 AS h FROM hsv1))"""

COLOUR = HSV + """, med AS (SELECT photo, median(area) AS med FROM items GROUP BY photo),
 colour0 AS (SELECT hsv.photo, coalesce(sum(area) FILTER (WHERE cls='pale'),0)/sum(area) AS frac_pale, coalesce(sum(area) FILTER (WHERE cls='dark'),0)/sum(area) AS frac_dark,
   coalesce(sum(area) FILTER (WHERE cls='white'),0)/sum(area) AS frac_white, coalesce(sum(area) FILTER (WHERE cls='off'),0)/sum(area) AS frac_off,
   max(area)/12996.0e0 AS largest_blob, count(*) AS used FROM hsv JOIN med USING (photo) WHERE area >= greatest(30.0e0, 0.25e0*med) GROUP BY hsv.photo),
 colour AS (SELECT *, colour_reason <> '' AS not_green FROM (SELECT *, CASE WHEN largest_blob >= 0.08e0 THEN 'big_blob' WHEN frac_off+frac_white > 0.5e0 THEN 'off_colour'
   WHEN frac_dark > 0.6e0 THEN 'too_dark_items' ELSE '' END AS colour_reason FROM colour0)),
 darkmed AS (SELECT photo, median(h) AS dark_hue, median(s) AS dark_sat FROM hsv WHERE v < 0.3e0 GROUP BY photo),
 shape AS (SELECT photo, CAST(count(*) FILTER (WHERE NOT touching AND elong BETWEEN 1.15e0 AND 2.2e0) AS DOUBLE)/count(*) AS shaped,
   stddev_pop(area)/avg(area) AS area_cv FROM items GROUP BY photo),
 darklot AS (SELECT *, why = '' AS is_dark_lot FROM (SELECT c.photo, shaped, area_cv, dark_hue, dark_sat, CASE WHEN colour_reason <> 'too_dark_items' THEN 'not_dark' WHEN shaped < 0.8e0 THEN 'shape'
   WHEN NOT coalesce(area_cv <= 0.6e0, FALSE) THEN 'size' WHEN NOT coalesce(dark_hue BETWEEN 26 AND 62 AND dark_sat <= 0.42e0, FALSE) THEN 'colour' ELSE '' END AS why
   FROM colour c LEFT JOIN shape USING (photo) LEFT JOIN darkmed USING (photo)))"""

PHOTOS = CHECKS + ", " + COLOUR + """, photos AS (SELECT * FROM checks JOIN colour USING (photo) JOIN darklot USING (photo))"""

GATE_V2 = """CASE WHEN too_dark THEN 'dark' WHEN count < 20 AND NOT too_many_touching AND NOT not_green THEN 'count' WHEN too_blurry THEN 'blur'
 WHEN not_green AND colour_reason='big_blob' AND frac_off+frac_white <= 0.5e0 AND frac_dark <= 0.6e0 AND too_many_touching THEN 'spread'
 WHEN not_green THEN 'not_green' WHEN too_many_touching THEN 'spread' WHEN count < 20 OR count > 160 THEN 'count' ELSE '' END"""

GATE_V1 = """CASE WHEN too_dark THEN 'dark' WHEN too_blurry THEN 'blur' WHEN not_green THEN 'not_green' WHEN NOT count_ok THEN 'count'
 WHEN too_many_touching THEN 'spread' ELSE '' END"""
