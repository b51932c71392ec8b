"""Held-out metrics over scored items. Every metric is a small table of partial sums, finished on top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import prefix_sums

N_CLASSES = len(C.CLASSES)


def share(cond: Column) -> Column:
    """Share of rows where ``cond`` holds; rows where it is NULL do not count."""
    return F.avg(F.when(cond, 1.0).when(~cond, 0.0))


def correct_typed(pred, y) -> Column:
    """Right class for typed rows; any defect class for rows whose defect type is not stated."""
    pred, y = fn.col(pred), fn.col(y)
    return F.when(y >= 0, pred == y).otherwise(pred != 0)


def binary_view(p_good) -> tuple[Column, Column]:
    """(predicted defect, confidence of the predicted side)."""
    pd = 1.0 - fn.col(p_good)
    return pd >= 0.5, F.greatest(pd, 1 - pd)


def confusion(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """One row per (keys, truth): count per predicted class and recall."""
    n = lambda i: F.count_if(F.col(pred) == i)
    return df.groupBy(*keys, y).agg(
        F.count(F.lit(1)).alias("n"), *[n(i).alias(f"c{i}") for i in range(N_CLASSES)],
        share(correct_typed(pred, y)).alias("recall"))


def kind_summary(df: DataFrame, keys: list[str], y: str, probs: str) -> DataFrame:
    """Per group: macro recall over the label kinds present, row accuracy, good / defect recall, balanced accuracy."""
    x = df.withColumn("_pred", fn.argmax(probs)).withColumn("_pd", (1.0 - F.element_at(probs, 1)) >= 0.5)
    truth = F.col(y) != 0
    cells = x.groupBy(*keys, y).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(correct_typed("_pred", y)).alias("hit"),
        F.count_if(F.col("_pd")).alias("pd"))
    pos, neg = F.when(truth, F.col("n")), F.when(~truth, F.col("n"))
    good = fn.ratio(F.sum(F.when(~truth, F.col("n") - F.col("pd"))), F.sum(neg))
    bad = fn.ratio(F.sum(F.when(truth, F.col("pd"))), F.sum(pos))
    out = cells.groupBy(*keys).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds_present"), F.avg(F.col("hit") / F.col("n")).alias("macro_accuracy"),
        (F.sum("hit") / F.sum("n")).alias("accuracy_rows"), good.alias("good_recall"), bad.alias("defect_recall"),
        (F.sum(F.when(truth, F.col("pd")).otherwise(F.col("n") - F.col("pd"))) / F.sum("n")).alias("binary_accuracy"))
    return out.withColumn("balanced_accuracy", mean_skipping_null("good_recall", "defect_recall"))


def mean_skipping_null(*cols: str) -> Column:
    """Row mean of the columns that are not NULL."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return total / F.nullif(n, F.lit(0))


def balanced_accuracy(df: DataFrame, keys: list[str], photo: list[str], truth: str, pred: str) -> DataFrame:
    """Item-weighted and photo-mean sensitivity, false-positive rate and balanced accuracy.

    A photo holds items of one truth, so photos are positive or negative as a whole."""
    per = df.groupBy(*keys, *photo, truth).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred)).alias("k"))
    pos = F.col(truth)
    rate = F.col("k") / F.col("n")
    out = per.groupBy(*keys).agg(
        F.sum(F.when(pos, F.col("n"))).alias("n_pos"), F.sum(F.when(~pos, F.col("n"))).alias("n_neg"),
        fn.ratio(F.sum(F.when(pos, F.col("k"))), F.sum(F.when(pos, F.col("n")))).alias("sensitivity"),
        fn.ratio(F.sum(F.when(~pos, F.col("k"))), F.sum(F.when(~pos, F.col("n")))).alias("fpr"),
        F.avg(F.when(pos, rate)).alias("photo_sensitivity"), F.avg(F.when(~pos, rate)).alias("photo_fpr"))
    return out.withColumns({
        "balanced": 0.5 * (F.col("sensitivity") + 1 - F.col("fpr")),
        "photo_balanced": 0.5 * (F.col("photo_sensitivity") + 1 - F.col("photo_fpr")),
    })


def calibration_error(df: DataFrame, keys: list[str], conf: Column, ok: Column, weight: Column, bin_no: Column) -> DataFrame:
    """Weighted gap between accuracy and confidence over bins; rows with a NULL bin only count in the total."""
    x = df.select(*keys, conf.alias("_c"), ok.cast("double").alias("_k"), weight.cast("double").alias("_w"), bin_no.alias("_bin"))
    bins = x.groupBy(*keys, "_bin").agg(
        F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_k")).alias("k"), F.sum(F.col("_w") * F.col("_c")).alias("c"))
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("k") - F.col("c")))
    return bins.groupBy(*keys).agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.sum("w")).alias("ece"))


def top1_bin(conf: Column, bins: int = 10) -> Column:
    """Left-open bins over 0..1; a zero confidence is in none."""
    return F.when(conf > 0, F.ceil(conf * bins))


def binary_bin(conf: Column, bins: int = 10) -> Column:
    """Bins over 0.5..1, the first one closed on the left."""
    return F.greatest(F.lit(1).cast("long"), F.ceil((conf - 0.5) * 2 * bins))


def auroc(df: DataFrame, keys: list[str], score: str, positive: str) -> DataFrame:
    """Area under the ROC curve from mid-ranks, exact with ties: counts per distinct score, then running totals."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("c"), F.count_if(F.col(positive)).alias("p"))
    run = prefix_sums(counts, keys, score, ["c"])
    mid = F.col("cum_c") - F.col("c") + (F.col("c") + 1) / 2
    agg = run.groupBy(*keys).agg(F.sum(mid * F.col("p")).alias("_r"), F.sum("p").alias("n_pos"), F.sum(F.col("c") - F.col("p")).alias("n_neg"))
    return agg.select(*keys, "n_pos", "n_neg", fn.ratio(F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def mid_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Adds the mid-rank of ``value`` within ``keys``."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    run = prefix_sums(counts, keys, value, ["_c"])
    ranks = run.select(*keys, value, (F.col("cum__c") - F.col("_c") + (F.col("_c") + 1) / 2).alias(out))
    return df.join(ranks, [*keys, value])


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with mid-ranks, its t statistic and two-sided p value (0 of a perfect correlation, null of two rows)."""
    r = mid_ranks(mid_ranks(df.select(*keys, a, b), keys, a, "_ra"), keys, b, "_rb")
    agg = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.corr("_ra", "_rb").alias("rho"))
    agg = agg.withColumn("t", F.when(F.abs("rho") < 1, F.col("rho") * F.sqrt((F.col("n") - 2) / (1 - F.col("rho") * F.col("rho")))))
    return agg.withColumn("p", F.when((F.abs("rho") >= 1) & (F.col("n") > 2), 0.0).otherwise(fn.t_two_sided(F.col("t"), F.col("n") - 2)))


def majority_baseline(df: DataFrame, keys: list[str], y: str, pred: str) -> DataFrame:
    """Share of the most frequent class next to the accuracy of the predictions."""
    cells = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(pred)).alias("hit"))
    return cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max(F.struct(F.col("n"), -F.col(y)))["n"].alias("_top"),
        (-F.max(F.struct(F.col("n").alias("n"), (-F.col(y)).alias("y")))["y"]).alias("majority"), F.sum("hit").alias("_hit"),
    ).select(*keys, "n", "majority", (F.col("_top") / F.col("n")).alias("majority_share"), (F.col("_hit") / F.col("n")).alias("accuracy"))


def operating_point(df: DataFrame, keys: list[str], code: str, defect: str) -> DataFrame:
    """Coverage, answered accuracy and what good and defect items were called, at fixed thresholds."""
    c, d = F.col(code), F.col(defect) == 1
    ans = c != C.UNSURE
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), share(ans).alias("coverage"),
        F.avg(F.when(ans, (c == F.col(defect)).cast("double"))).alias("answered_accuracy"),
        F.avg(F.when(~d, (c == C.GOOD).cast("double"))).alias("good_called_good"),
        F.avg(F.when(~d, (c == C.DEFECT).cast("double"))).alias("good_called_defect"),
        F.avg(F.when(d, (c == C.GOOD).cast("double"))).alias("defect_called_good"),
        F.avg(F.when(d, (c == C.DEFECT).cast("double"))).alias("defect_called_defect"))


def item_metrics(df: DataFrame, keys: list[str], code: str, defect: str) -> DataFrame:
    """Balanced (half the weight per class) and plain coverage and answered accuracy."""
    cell = df.groupBy(*keys, defect).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(code) != C.UNSURE).alias("ans"),
        F.count_if(F.col(code) == F.col(defect)).alias("ok"))
    d = F.col(defect)
    of = lambda c, v: F.coalesce(F.sum(F.when(d == v, F.col(c))), F.lit(0))
    x = cell.groupBy(*keys).agg(*[of(c, v).alias(f"{c}{v}") for c in ("n", "ans", "ok") for v in (0, 1)])
    per = lambda c: sum((0.5 * F.col(f"{c}{v}") / F.greatest(F.col(f"n{v}"), F.lit(1)) for v in (0, 1)), F.lit(0.0))
    return x.select(
        *keys, F.col("n0").alias("n_good"), F.col("n1").alias("n_defect"),
        (per("ans") / per("n")).alias("coverage_balanced"), fn.ratio(per("ok"), per("ans")).alias("accuracy_balanced"),
        fn.ratio(F.col("ans0") + F.col("ans1"), F.col("n0") + F.col("n1")).alias("coverage_plain"),
        fn.ratio(F.col("ok0") + F.col("ok1"), F.col("ans0") + F.col("ans1")).alias("accuracy_plain"))


def otsu(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Threshold of a 256-bin histogram with the largest between-class variance (first maximum)."""
    b = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.col(value))).cast("int")
    hist = df.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 256 rows
    whole = Window.partitionBy(*keys)
    moment = F.col("c") * F.col("bin")
    h = hist.withColumns({"wb": F.sum("c").over(upto), "sb": F.sum(moment).over(upto), "n": F.sum("c").over(whole), "s": F.sum(moment).over(whole)})
    wb, wf = F.col("wb").cast("double"), (F.col("n") - F.col("wb")).cast("double")
    h = h.withColumn("between", F.when(wf > 0, wb * wf * F.pow(F.col("sb") / wb - (F.col("s") - F.col("sb")) / F.nullif(wf, F.lit(0.0)), 2)))
    best = F.max(F.struct(F.col("between"), -F.col("bin")))
    return h.groupBy(*keys).agg(F.max("n").alias("n"), F.when(F.max("between").isNotNull(), F.max_by(-F.col("bin"), F.struct(F.round("between", 6), -F.col("bin")))).alias("_t"),
                                F.max("between").alias("between")).select(*keys, "n", F.coalesce(-F.col("_t"), F.lit(0)).alias("threshold"), F.coalesce("between", F.lit(0.0)).alias("between"))


def quantised_choice(df: DataFrame, keys: list[str], fold: str, full: str, quantised: str, defect: str, max_gap: float = 1.5,
                     max_diff: float = 0.05, min_agreement: float = 0.99) -> DataFrame:
    """Which of two sets of P(good) to deploy per group: the quantised one if its accuracy, as a mean over folds, is at most
    ``max_gap`` points lower and it agrees with the full one (largest difference, share of equal calls)."""
    right = lambda p: F.avg(((F.col(p) < 0.5) == (F.col(defect) == 1)).cast("double"))
    same = F.count_if((F.col(full) < 0.5) == (F.col(quantised) < 0.5))
    per = df.groupBy(*keys, fold).agg(right(full).alias("a"), right(quantised).alias("b"), F.max(F.abs(F.col(full) - F.col(quantised))).alias("d"), same.alias("same"), F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*keys).agg((100 * (F.avg("a") - F.avg("b"))).alias("gap_points"), F.max("d").alias("worst_diff"), (F.sum("same") / F.sum("n")).alias("agreement"))
    fit = (F.round("gap_points", 9) <= max_gap) & (F.col("worst_diff") <= max_diff) & (F.col("agreement") >= min_agreement)
    return out.withColumn("deployed", F.when(fit, "quantised").otherwise("full"))
