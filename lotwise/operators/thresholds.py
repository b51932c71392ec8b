"""Temperature, coverage curves and threshold searches.

All searches read the data once into a histogram on the threshold grid; the grid work is on bounded tables.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import attach, hot_groups, quantiles_long, with_bucket
from lotwise.session import cut_lineage


def grid(start: float, stop: float, step: float) -> list[float]:
    n = int(round((stop - start) / step)) + 1
    return [round(start + i * step, 2) for i in range(n)]


CURVE = grid(0.50, 1.00, 0.01)
PLAIN_CURVE = grid(0.20, 1.00, 0.01)
TG_GRID = grid(0.50, 0.94, 0.02)
TD_GRID = grid(0.50, 0.99, 0.01)


def passed(x: Column, values: list[float]) -> Column:
    """How many values of an evenly spaced grid are <= x: arithmetic guess, then corrected against the values."""
    step = values[1] - values[0]
    g = F.array(*[F.lit(v) for v in values])
    n = len(values)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((x - values[0]) / step).cast("int") + 1))
    return (
        F.when((guess < n) & (x >= F.get(g, F.least(guess, F.lit(n - 1)))), guess + 1)
        .when((guess > 0) & (x < F.get(g, F.greatest(guess - 1, F.lit(0)))), guess - 1)
        .otherwise(guess)
    )


def coverage_curve(df: DataFrame, keys: list[str], conf: Column, ok: Column, weight: Column | None = None,
                   values: list[float] = CURVE, eps: float = 1e-12) -> DataFrame:
    """Coverage and answered accuracy at every threshold: one histogram, then running sums from the top."""
    w = F.lit(1.0) if weight is None else weight
    x = df.select(*keys, passed(conf + eps, values).alias("_i"), w.alias("_w"), ok.cast("double").alias("_k"))
    hist = x.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_k")).alias("k"))
    total = hist.groupBy(*keys).agg(F.sum("w").alias("_all"))
    steps = F.posexplode(F.array(*[F.lit(v) for v in values]))
    rows = total.select(*keys, "_all", steps.alias("_p", "threshold")).withColumn("_i", F.col("_p") + 1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    acc = lambda c: F.coalesce(F.sum(c).over(down), F.lit(0))
    out = rows.join(hist, [*keys, "_i"], "left").withColumns({"answered": acc("n"), "_w": acc("w"), "_k": acc("k")})
    return out.select(
        *keys, "threshold", (F.col("_w") / F.nullif(F.col("_all"), F.lit(0.0))).alias("coverage"), F.col("answered").cast("long").alias("answered"),
        fn.ratio("_k", "_w").alias("accuracy"))


def suffix_stable(curve: DataFrame, keys: list[str], order: str, accuracy: str = "accuracy", answered: str = "answered",
                  target: float = C.TARGET_ACCURACY, min_answered: int = C.MIN_ANSWERED) -> DataFrame:
    """Rows of a bounded curve whose accuracy is on target there and at every higher threshold still answering enough."""
    ok = curve.where((F.col(answered) >= min_answered) & F.col(accuracy).isNotNull())
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return ok.withColumn("_worst", F.min(accuracy).over(ahead)).where(F.col("_worst") >= target).drop("_worst")


def pick_threshold(curve: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Lowest stable threshold per group; a group without one is kept with NULLs."""
    ok = suffix_stable(curve, keys, "threshold", **kw)
    best = ok.groupBy(*keys).agg(F.min_by(F.struct("threshold", "coverage", "answered", "accuracy"), "threshold").alias("c"))
    if not keys:
        return best.select("c.*")
    groups = curve.select(*keys).distinct()
    return groups.join(best, keys, "left").select(*keys, "c.threshold", "c.coverage", "c.answered", "c.accuracy")


def pick_pair(df: DataFrame, keys: list[str], p_good: str, defect: str, weight: str,
              target: float = C.TARGET_ACCURACY, min_answered: int = C.MIN_ANSWERED) -> DataFrame:
    """Best (good, defect) threshold pair: largest weighted coverage among the stable pairs, first good threshold on ties."""
    p = F.col(p_good)
    x = df.select(*keys, passed(p, TG_GRID).alias("_i"), passed(1 - p, TD_GRID).alias("_j"), F.col(defect).alias("_d"), F.col(weight).alias("_w"))
    hist = x.groupBy(*keys, "_i", "_j", "_d").agg(F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"))
    # the grid has 23 x 50 cells and the histogram at most 2 x 24 x 51, whatever the data
    a = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(v).alias("tg")) for i, v in enumerate(TG_GRID)]))
    b = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("j"), F.lit(v).alias("td")) for i, v in enumerate(TD_GRID)]))
    cells = hist.withColumn("a", a).withColumn("b", b)
    good, bad = F.col("_i") >= F.col("a.i"), F.col("_j") >= F.col("b.j")
    right = (good & (F.col("_d") == 0)) | (bad & (F.col("_d") == 1))
    rows = cells.groupBy(*keys, F.col("a.tg").alias("tg"), F.col("b.td").alias("td")).agg(
        F.sum(F.when(good | bad, F.col("n")).otherwise(0)).alias("answered"),
        F.sum(F.when(good | bad, F.col("w")).otherwise(0.0)).alias("_wa"),
        F.sum(F.when(right, F.col("w")).otherwise(0.0)).alias("_wk"), F.sum("w").alias("_all"))
    rows = rows.withColumns({"accuracy": fn.ratio("_wk", "_wa"), "coverage": F.round(F.col("_wa") / F.col("_all"), 9)})
    ok = suffix_stable(rows, [*keys, "tg"], "td", target=target, min_answered=min_answered)
    first = ok.groupBy(*keys, "tg").agg(F.min_by(F.struct("td", "accuracy", "coverage", "answered"), "td").alias("c"))
    best = first.groupBy(*keys).agg(F.max_by(F.struct("tg", "c"), F.struct(F.col("c.coverage"), -F.col("tg"))).alias("r"))
    best = best.where(F.col("r").isNotNull())  # no pair holds: no row, with or without keys
    return best.select(*keys, F.col("r.tg").alias("t_good"), F.col("r.c.td").alias("t_defect"), F.col("r.c.accuracy").alias("accuracy"),
                       F.col("r.c.coverage").alias("coverage"), F.col("r.c.answered").alias("answered"))


def row_nll(logits: str, y: str, t: Column) -> Column:
    """Minus log likelihood of one row at temperature t; an untyped defect takes the sum over the defect classes."""
    return fn.let(fn.softmax(logits, t), lambda p: -F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0),
                  F.when(F.col(y) >= 0, F.get(p, F.col(y))).otherwise(1.0 - F.get(p, F.lit(0)))))))


def nll_at(df: DataFrame, keys: list[str], logits: str, y: str, weight: str, log_ts: list[float]) -> DataFrame:
    """Weighted mean loss per group and temperature; the temperatures are exploded beside the row, never shuffled."""
    x = df.withColumn("log_t", F.explode(F.array(*[F.lit(float(v)) for v in log_ts])))
    x = x.withColumn("_l", row_nll(logits, y, F.exp("log_t")))
    return x.groupBy(*keys, "log_t").agg((F.sum(F.col(weight) * F.col("_l")) / F.sum(weight)).alias("nll"))


def fit_temperature(df: DataFrame, keys: list[str], logits: str, y: str, weight: str, lo: float = -3.0, hi: float = 3.0, points: int = 61) -> DataFrame:
    """Temperature of the smallest loss on an even grid of log T."""
    ts = [round(lo + i * (hi - lo) / (points - 1), 6) for i in range(points)]
    loss = nll_at(df, keys, logits, y, weight, ts)
    best = loss.groupBy(*keys).agg(F.min_by(F.struct("log_t", "nll"), F.struct(F.round("nll", 10), F.col("log_t"))).alias("b"))
    return best.select(*keys, F.col("b.log_t").alias("log_t"), F.exp("b.log_t").alias("temperature"), F.col("b.nll").alias("nll"))


def refine_temperature(df: DataFrame, logits: str, y: str, weight: str, lo: float = -3.0, hi: float = 3.0, rounds: int = 4, points: int = 13) -> float:
    """One pooled temperature: each round keeps the two grid steps around the smallest loss (driver sees ``points`` numbers)."""
    for _ in range(rounds):
        step = (hi - lo) / (points - 1)
        rows = nll_at(df, [], logits, y, weight, [lo + i * step for i in range(points)]).collect()
        best = min(rows, key=lambda r: r["nll"])["log_t"]
        lo, hi = best - step, best + step
    return math.exp((lo + hi) / 2)


def minimise_temperature(df: DataFrame, keys: list[str], logits: str, y: str, weight: str, lo: float = -3.0, hi: float = 3.0, tolerance: float = 1e-5) -> DataFrame:
    """Temperature of the smallest weighted loss per group, log T within ``tolerance``.

    Rounds of one aggregate each: the losses of all trial points of a group's bracket are summed side by side, so a row is
    read once a round and never repeated; the next bracket is one step to either side of the best point. Between rounds
    a group is one line. The loss of log T has to fall and then rise, as that of a softmax does. Of equal losses the smallest
    log T counts. Rows with a NULL among key, logits, class and weight are left out; weights that sum to zero give no line.
    A group's logits have one length."""
    rows = df.select(*keys, F.col(logits).cast("array<double>").alias("_z"), F.col(y).cast("int").alias("_y"), F.col(weight).cast("double").alias("_w")).where(
        " and ".join(f"`{c}` is not null" for c in [*keys, "_z", "_y", "_w"]))
    hot = hot_groups(rows, keys) if keys else None
    fields = ", ".join(["_mid double", "_w double", "_l array<double>", *(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)])
    step, best = (hi - lo) / 24, None
    offsets, placed = lo + step * np.arange(25), rows.withColumn("_mid", F.lit(0.0))
    while True:
        sums = placed.mapInPandas(_loss_sums(keys, offsets), fields).groupBy(*keys).agg(
            F.first("_mid").alias("_mid"), F.sum("_w").alias("_w"), *[F.sum(F.get("_l", F.lit(i))).alias(f"_l{i}") for i in range(len(offsets))]).where("_w > 0")
        points = F.array(*[F.struct(F.round(F.col(f"_l{i}") / F.col("_w"), 13).alias("nll"), (F.col("_mid") + float(o)).alias("log_t")) for i, o in enumerate(offsets)])
        best = cut_lineage(sums.select(*keys, F.array_min(points).alias("b")).select(*keys, "b.log_t", "b.nll"))
        if step <= tolerance:
            return best.select(*keys, "log_t", F.exp("log_t").alias("temperature"), "nll")
        mid = best.select(*keys, F.col("log_t").alias("_mid"))
        placed = attach(rows, mid, keys, hot) if keys else rows.withColumn("_mid", mid.scalar())
        step /= 10
        offsets = step * np.arange(-10, 11)


def _loss_sums(keys: list[str], offsets: np.ndarray):
    """Sums of an Arrow batch per group: weight and, for every trial point, weight times loss."""

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            z = np.stack(f["_z"].to_numpy())
            t = np.exp(f["_mid"].to_numpy()[:, None] + offsets)
            e = np.exp((z - z.max(1, keepdims=True))[:, None, :] / t[:, :, None])
            y = f["_y"].to_numpy()
            own = np.take_along_axis(e, np.maximum(y, 0)[:, None, None], 2)[:, :, 0] / e.sum(2)
            p = np.where(y[:, None] >= 0, own, 1 - e[:, :, 0] / e.sum(2))  # an untyped defect: any class but the first
            loss = -np.log(np.clip(p, 1e-12, 1.0)) * f["_w"].to_numpy()[:, None]
            group = f.groupby(keys, sort=False).ngroup().to_numpy() if keys else np.zeros(len(f), np.int64)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            out = f.iloc[order[starts]][["_mid", *keys]].copy()
            out["_w"] = np.add.reduceat(f["_w"].to_numpy()[order], starts)
            out["_l"] = list(np.add.reduceat(loss[order], starts))
            yield out[["_mid", "_w", "_l", *keys]]

    return run


def best_stump(df: DataFrame, features: dict[str, Column], positive: Column, cuts: int = 197) -> DataFrame:
    """Balanced accuracy of every single-feature rule: percentile cuts of each feature, in both directions.

    The cuts (features x 197 numbers) come to the driver; every row then finds its bucket by binary search and only
    bucket counts are shuffled."""
    probs = [0.01 + 0.98 * i / (cuts - 1) for i in range(cuts)]
    names = list(features)
    wide = df.select(positive.alias("pos"), *[features[n].cast("double").alias(n) for n in names])
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("f")).select("f.*")
    q = quantiles_long(long, ["feature"], "v", {f"q{i}": p for i, p in enumerate(probs)})
    edges = {r["feature"]: sorted(r["e"]) for r in q.groupBy("feature").agg(F.collect_set("value").alias("e")).collect()}
    x = wide
    for n in names:
        x = with_bucket(x, n, edges[n], f"_le_{n}")
    at = lambda n: F.element_at(F.array(*[F.lit(v) for v in edges[n]]), F.greatest(F.lit(1), F.col(f"_le_{n}").cast("int")))
    cell = lambda n: F.struct(F.lit(n).alias("feature"), F.col(f"_le_{n}").cast("int").alias("le"),
                              (F.col(f"_le_{n}") - F.when((F.col(f"_le_{n}") > 0) & (F.col(n) == at(n)), 1).otherwise(0)).cast("int").alias("lt"), F.col(n).isNotNull().alias("ok"))
    h = x.select("pos", F.explode(F.array(*[cell(n) for n in names])).alias("c")).where("c.ok").groupBy("c.feature", "c.le", "c.lt").agg(
        F.count_if("pos").alias("p"), F.count_if(~F.col("pos")).alias("n"))
    table = F.create_map(*[e for n in names for e in (F.lit(n), F.array(*[F.lit(v) for v in edges[n]]))])
    s = h.select("*", F.posexplode(F.element_at(table, F.col("feature"))).alias("k", "cut")).groupBy("feature", "k", "cut").agg(
        F.sum(F.when(F.col("le") <= F.col("k"), F.col("p")).otherwise(0)).alias("p_below"),
        F.sum(F.when(F.col("le") <= F.col("k"), F.col("n")).otherwise(0)).alias("n_below"),
        F.sum(F.when(F.col("lt") > F.col("k"), F.col("p")).otherwise(0)).alias("p_above"),
        F.sum(F.when(F.col("lt") > F.col("k"), F.col("n")).otherwise(0)).alias("n_above"),
        F.sum("p").alias("p"), F.sum("n").alias("n"))
    both = s.select("feature", "cut", F.explode(F.array(
        F.struct(F.lit(1).alias("direction"), (0.5 * (fn.ratio("p_below", "p") + 1 - fn.ratio("n_below", "n"))).alias("score")),
        F.struct(F.lit(-1).alias("direction"), (0.5 * (fn.ratio("p_above", "p") + 1 - fn.ratio("n_above", "n"))).alias("score")))).alias("r"))
    return both.select("feature", "cut", "r.direction", "r.score")


def pick_stump(rules: DataFrame) -> DataFrame:
    """The best rule of all (one row: feature, cut, direction, score); ties go to the first feature, cut and direction by order."""
    first = F.struct((-F.round("score", 12)).alias("s"), "feature", "cut", (-F.col("direction")).alias("d"), "score")
    b = rules.agg(F.min(first).alias("b"))
    return b.select("b.feature", "b.cut", (-F.col("b.d")).alias("direction"), "b.score")


def apply_stump(df: DataFrame, rule: DataFrame, features: dict[str, Column]) -> DataFrame:
    """Adds ``stump``: whether the rule calls the row positive (null where its feature is null). The rule is one row by
    construction, so it reaches the rows as a scalar."""
    r = rule.select(F.struct("feature", "cut", "direction").alias("r")).scalar()
    v = F.element_at(F.create_map(*[x for n, c in features.items() for x in (F.lit(n), c.cast("double"))]), r["feature"])
    return df.withColumn("stump", F.when(r["direction"] == 1, v < r["cut"]).otherwise(v > r["cut"]))
