"""Joins by geometry and sequence: candidates meet only in shared grid cells, never as all pairs of a photo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import core as fn
from lotwise.operators.curate import rounds_until
from lotwise.session import cut_lineage

PACK_ROWS = 100_000
BOX = ["x0", "y0", "x1", "y1"]


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def iou_pairs(found: DataFrame, truth: DataFrame, photo: str, found_id: str, truth_id: str, min_iou: float = 0.5, cell: float = 128.0) -> DataFrame:
    """(found, annotation) pairs of one photo whose overlap is large enough.

    From one half up the annotation's centre must lie in the found box, so an annotation needs only the grid cell of its
    centre. Below that both boxes are laid on the grid and a pair is looked at once, in the cell of its overlap's corner."""
    v = fn.iou("ax0", "ay0", "ax1", "ay1", "bx0", "by0", "bx1", "by1")
    if min_iou >= 0.5:
        a = found.select(photo, found_id, *[F.col(c).cast("double").alias(f"a{c}") for c in BOX])
        a = a.withColumn("_cx", F.explode(_cells(F.col("ax0"), F.col("ax1"), cell))).withColumn("_cy", F.explode(_cells(F.col("ay0"), F.col("ay1"), cell)))
        b = truth.select(photo, truth_id, *[F.col(c).cast("double").alias(f"b{c}") for c in BOX])
        b = b.withColumns({"_mx": (F.col("bx0") + F.col("bx1")) / 2, "_my": (F.col("by0") + F.col("by1")) / 2})
        b = b.withColumns({"_cx": F.floor(F.col("_mx") / cell), "_cy": F.floor(F.col("_my") / cell)})
        inside = F.col("_mx").between(F.col("ax0"), F.col("ax1")) & F.col("_my").between(F.col("ay0"), F.col("ay1"))
        # exploded sides are larger than their estimates say: never let one be broadcast
        return a.hint("merge").join(b, [photo, "_cx", "_cy"]).where(inside).select(photo, found_id, truth_id, v.alias("iou")).where(F.col("iou") >= min_iou)

    def laid(df, prefix, key):
        return df.select(
            photo, F.col(key), *[F.col(c).cast("double").alias(f"{prefix}{c}") for c in BOX],
            F.explode(_cells(F.col("x0"), F.col("x1"), cell)).alias("_cx"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"),
        ).withColumn("_cy", F.explode(_cells(F.col("_y0"), F.col("_y1"), cell))).drop("_y0", "_y1")

    a, b = laid(found, "a", found_id), laid(truth, "b", truth_id)
    x = a.hint("merge").join(b, [photo, "_cx", "_cy"]).where(
        (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
        & (F.floor(F.greatest("ax0", "bx0") / cell) == F.col("_cx")) & (F.floor(F.greatest("ay0", "by0") / cell) == F.col("_cy")))
    return x.select(photo, found_id, truth_id, v.alias("iou")).where(F.col("iou") >= min_iou)


def greedy_match(pairs: DataFrame, photo: str, found_id: str, truth_id: str, hot_rows: int = 200_000) -> DataFrame:
    """Found boxes in found order take the best annotation still free (first on ties).

    Photos with an ordinary number of surviving pairs are matched in packs, one Python call per pack; photos over
    ``hot_rows`` are solved in rounds over the whole cluster, with the same result."""
    pairs = cut_lineage(pairs.select(photo, found_id, truth_id, "iou"))  # counted, then matched
    per = pairs.groupBy(photo).agg(F.count(F.lit(1)).alias("_n"))
    hot = per.where(F.col("_n") > hot_rows).select(photo)
    packs = max(1, pairs.count() // PACK_ROWS)
    if hot.isEmpty():
        return _greedy_packed(pairs, photo, found_id, truth_id, packs)
    hot_pairs = pairs.join(F.broadcast(hot), photo, "left_semi")
    return _greedy_packed(pairs.join(F.broadcast(hot), photo, "left_anti"), photo, found_id, truth_id, packs).unionByName(
        _greedy_rounds(hot_pairs, photo, found_id, truth_id))


def _greedy_packed(pairs: DataFrame, photo: str, found_id: str, truth_id: str, packs: int) -> DataFrame:
    schema = pairs.schema

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([photo, found_id, "iou", truth_id], ascending=[True, True, False, True])
        keep, used, open_photo, last = [], set(), None, None
        for i, (p, f, j) in enumerate(zip(pdf[photo].tolist(), pdf[found_id].tolist(), pdf[truth_id].tolist())):
            if p != open_photo:
                open_photo, last = p, None
                used.clear()
            if f == last or j in used:
                continue
            used.add(j)
            last = f
            keep.append(i)
        return pdf.iloc[keep][schema.names]

    packed = pairs.withColumn("_g", F.pmod(F.xxhash64(photo), F.lit(packs)))
    return packed.groupBy("_g").applyInPandas(match, schema)


def _greedy_rounds(pairs: DataFrame, photo: str, found_id: str, truth_id: str) -> DataFrame:
    """A found box is settled once it is the first in line for every annotation it could take."""
    def step(df):
        open_ = df.where("_st = 0")
        first = open_.groupBy(photo, truth_id).agg(F.min(found_id).alias("_f"))
        ready = (
            open_.join(first, [photo, truth_id]).groupBy(photo, found_id)
            .agg(F.bool_and(F.col("_f") == F.col(found_id)).alias("_go"), F.min_by(truth_id, F.struct(-F.col("iou"), F.col(truth_id))).alias("_take"))
            .where("_go").select(photo, found_id, "_take"))
        taken = ready.select(photo, F.col("_take").alias(truth_id), F.lit(True).alias("_gone"))
        x = df.join(ready, [photo, found_id], "left").join(taken, [photo, truth_id], "left")
        st = (F.when(F.col("_st") > 0, F.col("_st")).when(F.col("_take") == F.col(truth_id), 1)
              .when(F.col("_take").isNotNull() | F.coalesce("_gone", F.lit(False)), 2).otherwise(0))
        return x.select(photo, found_id, truth_id, "iou", st.alias("_st"))

    done = rounds_until(pairs.select(photo, found_id, truth_id, "iou", F.lit(0).alias("_st")), step, F.col("_st") == 0)
    return done.where("_st = 1").drop("_st")


def _in_reach(items: DataFrame, radius: float, cell: float) -> DataFrame:
    """Items once per cell that holds a place within ``radius``."""
    x = items.withColumn("_gx", F.explode(_cells(F.col("cx") - radius, F.col("cx") + radius, cell)))
    return x.withColumn("_gy", F.explode(_cells(F.col("cy") - radius, F.col("cy") + radius, cell)))


def nearest_point(items: DataFrame, points: DataFrame, photo: str, item_id: str, point_id: str, radius: float) -> DataFrame:
    """Nearest reference point of the same photo within a radius; items without one get NULL.

    A cell is four radii wide, so an item mostly needs one or two cells, four at a corner."""
    cell = 4 * radius
    a = _in_reach(items.select(photo, item_id, "cx", "cy"), radius, cell)
    b = points.select(photo, point_id, F.col("cx").alias("px"), F.col("cy").alias("py"), F.floor(F.col("cx") / cell).alias("_gx"), F.floor(F.col("cy") / cell).alias("_gy"))
    d2 = F.pow(F.col("cx") - F.col("px"), 2) + F.pow(F.col("cy") - F.col("py"), 2)
    hit = a.hint("merge").join(b, [photo, "_gx", "_gy"]).withColumn("_d2", d2).where(F.sqrt("_d2") < radius)
    best = hit.groupBy(photo, item_id).agg(F.min(F.struct(F.col("_d2"), F.col(point_id))).alias("_b"))
    return items.join(best, [photo, item_id], "left").select(photo, item_id, F.col(f"_b.{point_id}").alias(point_id), F.sqrt("_b._d2").alias("distance"))


def points_in_box(items: DataFrame, points: DataFrame, photo: str, item_id: str, cell: float = 32.0) -> DataFrame:
    """How many known centres fall inside each found item."""
    a = items.select(photo, item_id, *BOX, F.explode(_cells(F.col("x0"), F.col("x1"), cell)).alias("_gx"))
    a = a.withColumn("_gy", F.explode(_cells(F.col("y0"), F.col("y1"), cell)))
    b = points.select(photo, F.col("cx").alias("px"), F.col("cy").alias("py")).withColumns({"_gx": F.floor(F.col("px") / cell), "_gy": F.floor(F.col("py") / cell)})
    b = b.groupBy(photo, "_gx", "_gy", "px", "py").agg(F.count(F.lit(1)).alias("_n"))
    inside = a.hint("merge").join(b, [photo, "_gx", "_gy"]).where(F.col("px").between(F.col("x0"), F.col("x1")) & F.col("py").between(F.col("y0"), F.col("y1")))
    n = inside.groupBy(photo, item_id).agg(F.sum("_n").alias("centres"))
    return items.select(photo, item_id).join(n, [photo, item_id], "left").withColumn("centres", F.coalesce("centres", F.lit(0)))


def sequence_gap_anti(test: DataFrame, cal: DataFrame, keys: list[str], number: str, gap: int) -> DataFrame:
    """Test rows whose number is not within ``gap`` of any calibration number of the same keys."""
    size = max(gap, 1)
    b = F.floor(F.col(number) / size)
    c = cal.select(*keys, F.col(number).alias("_n")).distinct()
    c = c.withColumn("_b", F.explode(F.sequence(F.floor((F.col("_n") - gap) / size), F.floor((F.col("_n") + gap) / size))))
    t = test.withColumn("_b", b)
    on = [t[k].eqNullSafe(c[k]) for k in keys] + [t["_b"] == c["_b"], F.abs(t[number] - c["_n"]) <= gap]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    return t.join(c, cond, "left_anti").drop("_b")


def prediction_parity(a: DataFrame, b: DataFrame, key: str, probs: str, call_a: Column, call_b: Column, group: str) -> DataFrame:
    """Two prediction tables on one key: largest difference, argmax and call agreement, cosine of the vectors."""
    x = a.select(group, key, F.col(probs).alias("_p"), call_a.alias("_ca")).join(b.select(key, F.col(probs).alias("_q"), call_b.alias("_cb")), key)
    diff = F.array_max(F.zip_with("_p", "_q", lambda u, v: F.abs(u - v)))
    x = x.withColumns({"_d": diff, "_cos": fn.cosine("_p", "_q"), "_am": fn.argmax("_p") == fn.argmax("_q")})
    return x.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.max("_d").alias("max_abs_diff"), F.avg(F.col("_am").cast("double")).alias("argmax_agreement"),
        F.avg((F.col("_ca") == F.col("_cb")).cast("double")).alias("call_agreement"), F.min("_cos").alias("min_cosine"), F.avg("_cos").alias("mean_cosine"))


def integrity_check(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Same key set and same values? One row of counts; also shows duplicated keys instead of multiplying them."""
    one = lambda df, side: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"_n{side}"), F.sum(value).alias(f"_v{side}"))
    x = one(a, "a").join(one(b, "b"), keys, "full_outer")
    return x.agg(
        F.count_if(F.col("_na").isNotNull() & F.col("_nb").isNotNull()).alias("both"),
        F.count_if(F.col("_nb").isNull()).alias("only_left"), F.count_if(F.col("_na").isNull()).alias("only_right"),
        F.count_if(F.col("_na") > 1).alias("dup_left"), F.count_if(F.col("_nb") > 1).alias("dup_right"),
        F.max(F.abs(F.col("_va") - F.col("_vb"))).alias("max_abs_diff"))
