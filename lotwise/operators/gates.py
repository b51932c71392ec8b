"""Photo-level checks and the ordered retake gates over a component table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import CHECK, attach, exact_medians, exact_quantiles, hot_groups


def too_many(n_touch, n) -> Column:
    n = F.greatest(fn.col(n), F.lit(1))
    return fn.col(n_touch) > F.greatest(F.lit(float(C.TOUCH_MIN)), C.TOUCH_FRAC * n)


def photo_checks(df: DataFrame) -> DataFrame:
    """Flags from sheet_luma, blur_var, count and touching."""
    return df.withColumns({
        "too_dark": F.col("sheet_luma") < C.DARK_LUMA,
        "too_blurry": F.col("blur_var") < C.BLUR_VAR,
        "count_ok": F.col("count").between(C.MIN_ITEMS, C.MAX_ITEMS),
        "too_many_touching": too_many("touching", "count"),
    })


def component_filter(df: DataFrame, photo: str, width: float, height: float) -> DataFrame:
    """Items of a component table: specks and cut-off pieces dropped, merged pieces flagged."""
    hot = hot_groups(df, [photo])
    p90 = exact_quantiles(df, [photo], "area", {"p90": 0.9}, hot=hot)
    big = attach(df, p90, [photo], hot).where(F.col("area") >= F.greatest(F.lit(float(C.MIN_AREA)), C.BIG_P90_FRAC * F.col("p90")))
    med = exact_quantiles(big, [photo], "area", {"med": 0.5}, hot=hot)
    kept = attach(df, med, [photo], hot).where(
        (F.col("area") >= C.SMALL_MED_FRAC * F.col("med"))
        & (F.col("x0") > 0) & (F.col("y0") > 0) & (F.col("x1") < width) & (F.col("y1") < height)
    )
    return kept.withColumn("merged", F.col("area") > C.TOUCH_AREA_X * F.col("med"))


def item_qc(df: DataFrame, photo: str, width: float, height: float) -> DataFrame:
    """Keeps items near their photo's median area and clear of the frame; dark-sheet photos are rejected whole."""
    hot = hot_groups(df, [photo])
    med = exact_quantiles(df, [photo], "area", {"med": 0.5}, hot=hot)
    rel = fn.ratio("area", "med")
    e = C.EDGE_PX
    inside = (F.col("x0") > e) & (F.col("y0") > e) & (F.col("x1") < width - e) & (F.col("y1") < height - e)
    return attach(df, med, [photo], hot).withColumns({
        "rejected": F.col("sheet_luma") < C.MIN_SHEET_LUMA,
        "ok": F.coalesce(rel.between(*C.AREA_REL), F.lit(False)) & inside,
    })


def colour_gate(df: DataFrame, photo: str, frame_area: float, hot=CHECK) -> DataFrame:
    """Area share per colour class of the components large enough to count, and the first rule that fires."""
    hot = hot_groups(df, [photo]) if hot is CHECK else hot
    med = exact_quantiles(df, [photo], "area", {"median_area": 0.5}, hot=hot)
    big = attach(df, med, [photo], hot).where(F.col("area") >= F.greatest(F.lit(30.0), 0.25 * F.col("median_area")))
    used = fn.with_hsv(big).withColumn("cls", fn.colour_class("h", "s", "v"))
    share = lambda c: F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("area"))), F.lit(0.0)) / F.sum("area")
    k = C.COLOUR_RULE
    return (
        used.groupBy(photo)
        .agg(*[share(c).alias(f"frac_{c}") for c in ("pale", "dark", "white", "off")],
             (F.max("area") / frame_area).alias("largest_blob"), F.count(F.lit(1)).alias("used"))
        .withColumn(
            "colour_reason",
            F.when(F.col("largest_blob") >= k["max_blob"], "big_blob")
            .when(F.col("frac_off") + F.col("frac_white") > k["max_off"], "off_colour")
            .when(F.col("frac_dark") > k["max_dark"], "too_dark_items")
            .otherwise(""),
        )
        .withColumn("not_green", F.col("colour_reason") != "")
    )


def dark_lot(df: DataFrame, colour: DataFrame, photo: str, hot=CHECK) -> DataFrame:
    """Is a photo the colour gate calls too dark made of item-shaped, even-sized, brownish pieces?"""
    k = C.DARK_LOT
    dark = fn.with_hsv(df).where(F.col("v") < k["dark_v"])
    hot = hot_groups(df, [photo]) if hot is CHECK else hot
    tone = exact_medians(dark, [photo], ["h", "s"], hot=hot).select(photo, F.col("h_med").alias("dark_hue"), F.col("s_med").alias("dark_sat"))
    shaped = ~F.col("touching") & F.col("elong").between(k["elong_min"], k["elong_max"])
    agg = df.groupBy(photo).agg(
        (F.count_if(shaped) / F.count(F.lit(1))).alias("shaped"),
        fn.ratio(F.stddev_pop("area"), F.avg("area")).alias("area_cv"),
    )
    out = colour.select(photo, "colour_reason").join(agg, photo, "left").join(tone, photo, "left")
    why = (
        F.when(F.col("colour_reason") != "too_dark_items", "not_dark")
        .when(F.col("shaped").isNull(), "no_blobs")
        .when(F.col("shaped") < k["min_shaped"], "shape")
        .when(~F.coalesce(F.col("area_cv") <= k["max_area_cv"], F.lit(False)), "size")
        .when(~F.coalesce(F.col("dark_hue").between(k["hue_min"], k["hue_max"]) & (F.col("dark_sat") <= k["max_dark_sat"]), F.lit(False)), "colour")
        .otherwise("")
    )
    return out.withColumn("why", why).withColumn("is_dark_lot", F.col("why") == "")


def touching_rule(df: DataFrame, photo: str) -> DataFrame:
    """The first rule that marks a piece as several items, with the one-item area it was judged by."""
    k = C.TOUCH_RULE
    hot = hot_groups(df, [photo])
    med = exact_quantiles(df, [photo], "area", {"median_area": 0.5}, hot=hot)
    single = (
        (F.col("solidity") >= k["single_solidity"]) & (F.col("fill") >= k["single_fill"]) & (F.col("elong") <= k["max_elong"])
    )
    singles = df.where(single)
    one = exact_quantiles(singles, [photo], "area", {"single_med": 0.5}, hot=hot)
    n_one = singles.groupBy(photo).agg(F.count(F.lit(1)).alias("n_single"))
    stats = (
        med.join(one, photo, "left").join(n_one, photo, "left")
        .select(photo, "median_area", F.when(F.col("n_single") >= k["min_singles"], F.col("single_med")).otherwise(F.col("median_area")).alias("single_area"))
    )
    why = (
        F.when(F.col("area") > C.TOUCH_AREA_X * F.col("median_area"), "area_median")
        .when((F.col("single_area") > 0) & (F.col("area") > k["area_x"] * F.col("single_area")), "area_single")
        .when(F.col("solidity") < k["min_solidity"], "solidity")
        .when(F.col("fill") < k["min_fill"], "fill")
        .otherwise("")
    )
    return attach(df, stats, [photo], hot).withColumn("why", why)


def hidden_items(marked: DataFrame, photo: str) -> DataFrame:
    """Items hidden in clumps of a touching-rule result, and the spread-out check counted both ways."""
    marked = fn.with_hsv(marked)
    touch = F.col("why") != ""
    held = F.floor(F.col("area") / F.nullif(F.col("single_area"), F.lit(0.0)) + 0.5)
    clump = touch & (held >= 3) & fn.colour_class("h", "s", "v").isin("pale", "dark")
    agg = marked.groupBy(photo).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(touch).alias("n_touch"),
        F.count_if(clump).alias("clumps"),
        F.coalesce(F.sum(F.when(clump, held)), F.lit(0)).alias("hidden"),
    )
    agg = agg.withColumn("equiv", F.col("n") - F.col("clumps") + F.col("hidden"))
    return agg.withColumn("too_many_touching", too_many("n_touch", "n") | too_many("hidden", "equiv"))


def item_coloured() -> Column:
    k = C.COLOUR_RULE
    return (F.col("frac_off") + F.col("frac_white") <= k["max_off"]) & (F.col("frac_dark") <= k["max_dark"])


def gate_v2(min_items: int = C.MIN_ITEMS) -> Column:
    """Retake reason, first match wins; '' lets the photo through."""
    few = F.col("count") < min_items
    return (
        F.when(F.col("too_dark"), "dark")
        .when(few & ~F.col("too_many_touching") & ~F.col("not_green"), "count")
        .when(F.col("too_blurry"), "blur")
        .when(F.col("not_green") & (F.col("colour_reason") == "big_blob") & item_coloured() & F.col("too_many_touching"), "spread")
        .when(F.col("not_green"), "not_green")
        .when(F.col("too_many_touching"), "spread")
        .when(few | (F.col("count") > C.MAX_ITEMS), "count")
        .otherwise("")
    )


def gate_v1(with_colour: bool = True) -> Column:
    """The older order: dark, blur, colour, count, spread."""
    out = F.when(F.col("too_dark"), "dark").when(F.col("too_blurry"), "blur")
    if with_colour:
        out = out.when(F.col("not_green"), "not_green")
    return out.when(~F.col("count_ok"), "count").when(F.col("too_many_touching"), "spread").otherwise("")


def screen(min_items: int = C.MIN_ITEMS) -> Column:
    """Gate before scoring; a dark lot is answered 'unsure' instead of being refused."""
    g = gate_v2(min_items)
    dark = (
        (g == "not_green") & (F.col("colour_reason") == "too_dark_items") & F.col("is_dark_lot")
        & ~F.col("too_many_touching") & F.col("count").between(min_items, C.MAX_ITEMS)
    )
    return F.when(dark, "unsure:dark_lot").when(g != "", F.concat(F.lit("retake:"), g)).otherwise("score")
