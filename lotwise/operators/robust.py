"""Robust outlier scores, shape and colour statistics, distance gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import CHECK, attach, exact_medians, exact_quantiles, hot_groups, one_row
from lotwise.operators.vectors import _unit as unit_rows
from lotwise.operators.vectors import nearest
from lotwise.session import cut_lineage

MAD = 1.4826
UNIT_ROWS = 1_000_000  # rows of a unit whose features one task may hold


def floors_of(df: DataFrame, features: list[str], share: float = 0.1) -> Column:
    """Smallest spread a feature may have: a share of its standard deviation over all rows (struct column)."""
    return one_row(df.agg(*[(share * F.stddev_pop(f)).alias(f) for f in features]))


def robust_z(df: DataFrame, keys: list[str], features: list[str], floors: Column, hot=CHECK) -> DataFrame:
    """Adds z_<f> = (x - median) / max(1.4826 MAD, floor) per group."""
    hot = hot_groups(df, keys) if hot is CHECK else hot
    med = exact_medians(df, keys, features, hot=hot)
    x = attach(df, med, keys, hot)
    dev = x.select(*keys, *[F.abs(F.col(f) - F.col(f"{f}_med")).alias(f) for f in features])
    mad = exact_medians(dev, keys, features, suffix="_mad", hot=hot)
    x = attach(x, mad, keys, hot)
    z = {f"z_{f}": (F.col(f) - F.col(f"{f}_med")) / F.greatest(MAD * F.col(f"{f}_mad"), floors[f]) for f in features}
    return x.withColumns(z).drop(*[f"{f}{s}" for f in features for s in ("_med", "_mad")])


def rms_clipped(features: list[str], clip: float = 8.0) -> Column:
    """Root mean square of the clipped z values that are defined."""
    zs = F.filter(F.array(*[F.greatest(F.lit(-clip), F.least(F.lit(clip), F.col(f"z_{f}"))) for f in features]), lambda z: z.isNotNull())
    return F.sqrt(F.aggregate(zs, F.lit(0.0), lambda s, z: s + z * z) / F.nullif(F.size(zs), F.lit(0)))


def final_z(df: DataFrame, keys: list[str], scores: dict[str, str], hot=CHECK) -> DataFrame:
    """Robust z of finished scores per group: ``scores`` maps a score column to its output name."""
    cols = list(scores)
    hot = hot_groups(df, keys) if hot is CHECK else hot
    x = attach(df, exact_medians(df, keys, cols, hot=hot), keys, hot)
    dev = x.select(*keys, *[F.abs(F.col(c) - F.col(f"{c}_med")).alias(c) for c in cols])
    x = attach(x, exact_medians(dev, keys, cols, suffix="_mad", hot=hot), keys, hot)
    z = {}
    for c, out in scores.items():
        m = F.col(f"{c}_med")
        z[out] = (F.col(c) - m) / F.greatest(MAD * F.col(f"{c}_mad"), 1e-6 * F.greatest(F.abs(m), F.lit(1e-9)))
    return x.withColumns(z).drop(*[f"{c}{s}" for c in cols for s in ("_med", "_mad")])


def feature_score(df: DataFrame, keys: list[str], features: list[str], floors: Column, hot=CHECK) -> DataFrame:
    """Adds hand_score: the features' robust z of a group, clipped, as a root mean square."""
    return robust_z(df, keys, features, floors, hot).withColumn("hand_score", rms_clipped(features)).drop(*[f"z_{f}" for f in features])


def unusual(df: DataFrame, keys: list[str], features: list[str], distance: str, floors: Column, sizes: DataFrame | None = None) -> DataFrame:
    """Adds z_hand (feature outlier), z_emb (distance outlier) and z_both per item of a group.

    ``sizes`` is a cheaper table with the same groups, to look for oversized ones."""
    hot = hot_groups(df if sizes is None else sizes, keys)
    df = cut_lineage(df)  # four passes follow
    x = feature_score(df, keys, features, floors, hot)
    x = final_z(x, keys, {"hand_score": "z_hand", distance: "z_emb"}, hot)
    return x.withColumn("z_both", 0.5 * (F.col("z_hand") + F.col("z_emb")))


def scores_with_inserts(base: DataFrame, inserts: DataFrame, unit: str, features: list[str], floors: Column, k: int) -> DataFrame:
    """(grp, odd, hand_score, distance) of groups that are a whole unit of ``base`` (unit, id, vec, *features) and a few rows more.

    ``inserts`` (unit, grp, id, vec, *features) are few and go to the tasks. What the groups of a unit share is worked out once:
    the k nearest rows of a unit's rows among themselves; an insert is nearer or is not. A group's medians and spreads
    come from one task per unit, which holds the features alone (a unit has at most ``UNIT_ROWS`` rows). So a row of the
    unit is copied to its groups as two numbers, never with its vector or features."""
    kinds, spark = dict(base.dtypes), base.sparkSession
    schema = f"grp {dict(inserts.dtypes)['grp']}, odd boolean, hand_score double, distance double"
    more = inserts.select(unit, "grp", "id", "vec", *features).collect()
    if not more:
        return spark.createDataFrame([], schema)
    floor = np.array(base.select(floors.alias("f")).limit(1).select("f.*").first() or [0.0] * len(features), dtype=np.float64)
    number = lambda rows: np.array([[np.nan if r[f] is None else r[f] for f in features] for r in rows], dtype=np.float64).reshape(-1, len(features))
    near = lambda a, b: np.round(a @ b.T, 13)
    groups: dict = {}  # unit: group: positions of its inserts
    for i, r in enumerate(more):
        groups.setdefault(r[unit], {}).setdefault(r["grp"], []).append(i)
    added = number(more)
    vecs = unit_rows(np.array([r["vec"] for r in more], dtype=np.float64).reshape(len(more), -1))

    own = base.select(unit, (F.col("id") * 2).alias("id"), "vec")  # an insert's number is odd
    asking = spark.createDataFrame([(r[unit], 2 * i + 1, list(r["vec"])) for i, r in enumerate(more)], f"{unit} {kinds[unit]}, id long, vec {kinds['vec']}")
    found = nearest(own.unionByName(asking), own, k, by=[unit]).groupBy(unit, "qid").agg(F.collect_list("sim").alias("sims"))
    found = cut_lineage(found)

    def spread_of(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle = np.nanmedian if np.isnan(m).any() else np.median
        med = middle(m, axis=0)
        return med, middle(np.abs(m - med), axis=0)

    def spreads(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.asfortranarray(pdf[features].to_numpy(dtype=np.float64))
        out = [(g, *spread_of(np.vstack([m, added[at]]))) for g, at in groups.get(pdf[unit].iloc[0], {}).items()]
        return pd.DataFrame(out, columns=["grp", "med", "mad"])

    told = base.select(unit, *features).groupBy(unit).applyInPandas(spreads, f"grp {dict(inserts.dtypes)['grp']}, med array<double>, mad array<double>").collect()  # a line per group
    stats = {r["grp"]: (np.array(r["med"]), np.array(r["mad"])) for r in told}
    for own_groups in groups.values():
        for g, at in own_groups.items():
            if g not in stats:  # a unit without rows
                stats[g] = spread_of(added[at])

    def scored(g, sims: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of rows of a group from their similarities (-inf: none) and features."""
        best = -np.sort(-sims, axis=1)[:, :k]
        real = np.isfinite(best)
        with np.errstate(invalid="ignore", divide="ignore"):
            far = np.where(real, 1 - best, 0).sum(1) / real.sum(1)
            med, mad = stats[g]
            z = np.clip((m - med) / np.fmax(MAD * mad, floor), -8.0, 8.0)
            fine = ~np.isnan(z)
            return np.sqrt(np.where(fine, z * z, 0).sum(1) / fine.sum(1)), far

    def filled(lists) -> np.ndarray:
        out = np.full((len(lists), k), -np.inf)
        for i, v in enumerate(lists):
            if v is not None:
                out[i, : len(v)] = v
        return out

    def fan(batches):
        for pdf in batches:
            for u, rows in pdf.groupby(unit, sort=False):
                if u in groups:
                    a, m, had = unit_rows(np.stack(rows["vec"].to_list())), rows[features].to_numpy(dtype=np.float64), filled(rows["sims"].to_list())
                    for g, at in groups[u].items():
                        hand, far = scored(g, np.hstack([had, near(a, vecs[at])]), m)
                        yield pd.DataFrame({"grp": g, "odd": False, "hand_score": hand, "distance": far})

    met = base.select(unit, (F.col("id") * 2).alias("qid"), "vec", *features).join(found.hint("merge"), [unit, "qid"], "left")
    had = {r["qid"]: r["sims"] for r in found.where("qid % 2 <> 0").collect()}  # of the inserts
    lines = []
    for own_groups in groups.values():
        for g, at in own_groups.items():
            ids = np.array([more[i]["id"] for i in at])
            among = near(vecs[at], vecs[at])
            among[ids[:, None] == ids[None, :]] = -np.inf
            hand, far = scored(g, np.hstack([filled([had.get(2 * i + 1) for i in at]), among]), added[at])
            lines += [(g, True, *(None if np.isnan(v) else float(v) for v in pair)) for pair in zip(hand, far)]
    return met.mapInPandas(fan, schema).unionByName(spark.createDataFrame(lines, schema))


def moment_shape(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area, second moments (+ 1/12 per pixel), ellipse fill and elongation of a labelled component."""
    fx, fy = F.col(x).cast("double"), F.col(y).cast("double")
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("area"), F.sum(fx).alias("sx"), F.sum(fy).alias("sy"), F.sum(fx * fx).alias("sxx"), F.sum(fy * fy).alias("syy"), F.sum(fx * fy).alias("sxy"))
    n = F.col("area")
    s = s.withColumns({"cxx": F.col("sxx") / n - F.pow(F.col("sx") / n, 2) + F.lit(1.0) / 12, "cyy": F.col("syy") / n - F.pow(F.col("sy") / n, 2) + F.lit(1.0) / 12,
                       "cxy": F.col("sxy") / n - F.col("sx") * F.col("sy") / n / n})
    s = s.withColumns({"tr": F.col("cxx") + F.col("cyy"), "det": F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy")})
    s = s.withColumn("disc", F.sqrt(F.greatest(F.lit(0.0), F.col("tr") * F.col("tr") / 4 - F.col("det"))))
    s = s.withColumns({"l1": F.col("tr") / 2 + F.col("disc"), "l2": F.greatest(F.lit(1e-9), F.col("tr") / 2 - F.col("disc"))})
    return s.withColumns({"fill": n / (4 * F.pi() * F.sqrt(F.col("l1") * F.col("l2"))), "elong": F.sqrt(F.col("l1") / F.col("l2"))}).select(*keys, "area", "fill", "elong")


def colour_stats(df: DataFrame, keys: list[str], frame_area: float) -> DataFrame:
    """Colour and shape statistics of a group of pixels (r, g, b, x0, y0, area)."""
    p = df.withColumns({"luma": fn.luma("r", "g", "b"), "chroma": fn.chroma("r", "g", "b")})
    p = p.withColumn("sat", F.coalesce(F.col("chroma") / F.nullif(F.greatest("r", "g", "b"), F.lit(0.0)), F.lit(0.0)))
    q = exact_quantiles(p, keys, "luma", {"luma_med": 0.5, "luma_p10": 0.1, "luma_p90": 0.9})
    a = p.groupBy(*keys).agg(
        F.stddev_pop("luma").alias("luma_std"), F.avg((F.col("luma") < 80).cast("double")).alias("dark_frac"), F.avg("sat").alias("sat_mean"),
        F.avg("r").alias("mr"), F.avg("g").alias("mg"), F.avg("b").alias("mb"), F.avg("chroma").alias("chroma_mean"), (F.sum("area") / frame_area).alias("fill"),
        F.var_samp("x0").alias("cxx"), F.var_samp("y0").alias("cyy"), F.covar_samp("x0", "y0").alias("cxy"))
    a = fn.with_hsv(a, "mr", "mg", "mb").withColumn("disc", F.sqrt(F.greatest(F.lit(0.0), F.pow((F.col("cxx") - F.col("cyy")) / 2, 2) + F.col("cxy") * F.col("cxy"))))
    mid = (F.col("cxx") + F.col("cyy")) / 2
    a = a.withColumn("elong", F.sqrt((mid + F.col("disc")) / F.greatest(mid - F.col("disc"), F.lit(1e-6))))
    return a.join(q, keys).select(*keys, "luma_med", "luma_p10", "luma_p90", "luma_std", "dark_frac", "sat_mean", F.col("h").alias("hue_deg"), F.col("v").alias("val_mean"), "chroma_mean", "fill", "elong")


# ---------------------------------------------------------------- distance to a reference cloud

class Cloud:
    """Mean, spread and shrunk precision of a reference cloud; a handful of numbers on the driver."""

    def __init__(self, features: list[str], mean: np.ndarray, sd: np.ndarray, cov: np.ndarray, shrinkage: float):
        self.features, self.mean, self.sd, self.cov, self.shrinkage = features, mean, sd, cov, shrinkage
        p = len(features)
        mu = np.trace(cov) / p
        self.precision = np.linalg.inv((1 - shrinkage) * cov + shrinkage * mu * np.eye(p))

    def subset(self, features: list[str], fit: DataFrame) -> "Cloud":
        return fit_cloud(fit, features)

    def distance(self) -> Column:
        """sqrt(z P z') as a column; a missing feature counts as 0 before centring."""
        z = F.array(*[(F.coalesce(F.nanvl(F.col(f), F.lit(0.0)), F.lit(0.0)) - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.sd)])
        rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in self.precision])
        return fn.let(z, lambda v: F.sqrt(fn.asum(F.zip_with(v, rows, lambda x, r: x * fn.dot(r, v)))))


def cloud_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: n, mean, sd, second moments of the standardised rows and the sum of their fourth powers of length."""
    ok = df.where(sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) == 0)
    first = one_row(ok.agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[(F.stddev_pop(f) + 1e-6).alias(f"s_{f}") for f in features]))
    z = ok.select(first.alias("_f"), *features).select("_f", *[((F.col(f) - F.col(f"_f.m_{f}")) / F.col(f"_f.s_{f}")).alias(f) for f in features])
    z = z.withColumn("_q", F.pow(sum((F.col(f) * F.col(f) for f in features), F.lit(0.0)), 2))
    p = len(features)
    return z.agg(
        F.count(F.lit(1)).alias("n"), F.first("_f").alias("first"), F.sum("_q").alias("q4"),
        *[F.avg(F.col(features[i]) * F.col(features[j])).alias(f"c_{i}_{j}") for i in range(p) for j in range(i, p)])


def shrinkage_of(cov: np.ndarray, q4: float, n: int) -> float:
    """Ledoit-Wolf (2004) share of the scaled identity, from the sum of fourth powers of the row lengths."""
    p = cov.shape[0]
    mu = np.trace(cov) / p
    spread = float((cov ** 2).sum())
    delta = (spread - p * mu * mu) / p
    beta = min((q4 / n - spread) / (p * n), delta)
    return 0.0 if delta == 0 or beta <= 0 else beta / delta


def fit_cloud(df: DataFrame, features: list[str]) -> Cloud:
    m = cloud_moments(df, features).first()
    p = len(features)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = m[f"c_{i}_{j}"]
    mean = np.array([m["first"][f"m_{f}"] for f in features])
    sd = np.array([m["first"][f"s_{f}"] for f in features])
    return Cloud(features, mean, sd, cov, shrinkage_of(cov, m["q4"], m["n"]))


def calibrate_gate(df: DataFrame, score: str, must_pass: Column, must_refuse: Column, fixed: float = C.MAX_UNSURE_FRAC) -> Column:
    """Thresholds of a refusal gate (struct): a fixed share; the largest score that must pass, moved half way to the
    smallest one that must be refused when there is a gap; and the smallest must-refuse score itself ('at or above')."""
    one = one_row(df.agg(F.max(F.when(must_pass, F.col(score))).alias("top"), F.min(F.when(must_refuse, F.col(score))).alias("low")))
    gap = one["low"] > one["top"]
    mid = F.when(gap, one["top"] + 0.5 * (one["low"] - one["top"])).otherwise(one["top"])
    return F.array(
        F.struct(F.lit("fixed").alias("rule"), F.lit(fixed).alias("tau"), F.lit(False).alias("incl")),
        F.struct(F.lit("calibrated").alias("rule"), mid.alias("tau"), F.lit(False).alias("incl")),
        F.struct(F.lit("refuse_all").alias("rule"), one["low"].alias("tau"), F.lit(True).alias("incl")))
