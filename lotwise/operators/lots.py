"""Lots of known composition drawn from scored items, and how every rule does on them.

An item of a pool has a fixed position (its seeded rank). A lot starts at a seeded position and walks the pool with
a stride that shares no factor with the pool's size, so the items of a lot are distinct by construction and no lot
ever has to look at the whole pool. The lots depend on the design and the seed only: every rule sees the same lots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import hash_rank
from lotwise.operators import verdict as V
from lotwise.operators.splits import seeded

SIZES = [50, 100]
SHARES = [0.0, 0.02, 0.10, 0.15, 0.30, 0.45, 1.0]
REPS = 200
# Primes above 10**12: larger than any pool, so none divides a pool's size.
STRIDES = [1000000000039, 1000000000061, 1000000000063, 1000000000091, 1000000000121, 1000000000163, 1000000000169, 1000000000177]


def band_of_share(x) -> Column:
    return fn.band_of_rate(x)


def ranked_pool(items: DataFrame, unit: str, defect: str, key: str, seed: str) -> DataFrame:
    """Items with their position 1..n inside (unit, good or defect)."""
    r = hash_rank(items.withColumn("_h", seeded(key, seed)), [unit, defect], "_h")
    return r.withColumnRenamed("rn", "pos").withColumnRenamed("rn_n", "pool_n").drop("_h")


def cells(design: list[tuple[int, int]]) -> Column:
    """Design cells (size, defects) as an array column."""
    return F.array(*[F.struct(F.lit(s).alias("size"), F.lit(d).alias("nd")) for s, d in design])


def share_design(sizes: list[int] = SIZES, shares: list[float] = SHARES) -> list[tuple[int, int]]:
    return [(s, int(round(x * s))) for s in sizes for x in shares]


def build_lots(items: DataFrame, unit: str, defect: str, design: list[tuple[int, int]], reps: int, seed: Column, refill: bool = False) -> DataFrame:
    """One row per lot. Cells a pool cannot fill are skipped, or (``refill``) filled by going round the pool, flagged."""
    pools = items.groupBy(unit).agg(F.count_if(F.col(defect) == 0).alias("n_good"), F.count_if(F.col(defect) == 1).alias("n_bad"))
    # a small table of pools makes very many lots: spread it by number, or adaptive execution joins it into one task
    pools = pools.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), unit)
    lots = pools.withColumn("_s", F.explode(seed)).withColumn("_c", F.explode(cells(design))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    lots = lots.select(unit, "n_good", "n_bad", F.col("_s").alias("seed"), F.col("_c.size").alias("size"), F.col("_c.nd").alias("nd"), "rep")
    short = (F.col("size") - F.col("nd") > F.col("n_good")) | (F.col("nd") > F.col("n_bad"))
    lots = lots.withColumn("replaced", short)
    empty = ((F.col("nd") > 0) & (F.col("n_bad") == 0)) | ((F.col("size") > F.col("nd")) & (F.col("n_good") == 0))
    lots = lots.where(~empty) if refill else lots.where(~short)
    name = F.concat_ws("-", F.col(unit).cast("string"), "size", "nd", "rep", "seed")
    return lots.withColumns({"lot_id": name, "truth": band_of_share(F.col("nd") / F.col("size"))})


def _positions(lots: DataFrame, defect: str) -> DataFrame:
    """Lots with one row per place (``_i`` from 0): which half of the pool it is filled from, and the position there."""
    h = F.md5("lot_id")
    digits = lambda a, n: F.conv(F.substring(h, a, n), 16, 10)
    u = digits(1, 12).cast("double") / float(2 ** 48)
    stride = F.element_at(F.array(*[F.lit(p) for p in STRIDES]), (digits(13, 1).cast("int") % len(STRIDES)) + 1)
    x = lots.withColumns({"_u": u, "_p": stride}).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    bad = F.col("_i") < F.col("nd")
    n = F.when(bad, F.col("n_bad")).otherwise(F.col("n_good"))
    j = F.when(bad, F.col("_i")).otherwise(F.col("_i") - F.col("nd"))
    x = x.withColumns({defect: bad.cast("int"), "_n": n, "_j": j})
    return x.withColumn("pos", F.pmod(F.floor(F.col("_u") * F.col("_n")) + F.col("_j") * F.pmod(F.col("_p"), F.col("_n")), F.col("_n")) + 1)


def pick_items(lots: DataFrame, pool: DataFrame, unit: str, defect: str, key: str, carry: list[str]) -> DataFrame:
    """One row per picked item: an equi-join of computed positions with the ranked pool, spread over all positions."""
    keep = [c for c in lots.columns if c not in ("n_good", "n_bad")]
    x = _positions(lots, defect).select(*keep, defect, "pos")
    # one unit's line becomes all its lots' places, which no estimate knows: never let that side be broadcast
    return x.hint("merge").join(pool.select(unit, defect, "pos", key, *carry), [unit, defect, "pos"])


def pick_counts(lots: DataFrame, pool: DataFrame, unit: str, keys: list[str], defect: str, key: str) -> DataFrame:
    """Per ``keys`` (the unit first): lots, picks, picked defects, different items and the sum of the picked keys.

    Places that fall on one position are counted where they are made, so what is shuffled follows the pools, not the lots."""
    times = _positions(lots, defect).groupBy(*keys, defect, "pos").agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("_i") == 0).alias("_l"))
    picked = times.hint("merge").join(pool.select(unit, defect, "pos", key), [unit, defect, "pos"])
    t = F.col("_t")
    return picked.groupBy(*keys).agg(
        F.sum("_l").alias("lots"), F.sum(t).alias("n"), F.sum(t * F.col(defect)).alias("defects"), F.countDistinct(key).alias("items"), F.sum(t * F.col(key)).alias("checksum"))


def score_lots(picks: DataFrame, keys: list[str], p_good: str, candidates: list[float] = C.T_CANDIDATES, td: float = C.T_DEFECT) -> DataFrame:
    """Outcome of every lot under every candidate threshold; the items are read once for all candidates."""
    p = F.col(p_good)
    counts = picks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(1 - p >= td).alias("defects"), *[F.count_if(p >= tg).alias(f"_g{i}") for i, tg in enumerate(candidates)])
    cand = F.explode(F.array(*[F.struct(F.lit(tg).alias("tg"), F.col(f"_g{i}").alias("good")) for i, tg in enumerate(candidates)]))
    x = counts.withColumn("_c", cand).select(*keys, "total", "defects", "_c.tg", "_c.good")
    x = x.withColumns({"answered": F.col("good") + F.col("defects"), "unsure": F.col("total") - F.col("good") - F.col("defects")})
    d = V.decide(x)
    return d.withColumn("outcome", V.outcome(F.lit(""), F.col("band"), F.col("reason")))


def sweep_verdict(scores: DataFrame, unit: str, fallback: float = C.T_FALLBACK, max_wrong: float = 0.05, min_bands: int = 10) -> DataFrame:
    """Smallest candidate with no dangerous lot anywhere and few wrong bands in every unit that gives enough bands."""
    s = scores.withColumn("dangerous", F.col("clean_called_many") + F.col("many_called_clean"))
    fails = (F.col("bands") >= min_bands) & (F.col("wrong") / F.nullif(F.col("bands").cast("double"), F.lit(0.0)) > max_wrong)
    rows = s.groupBy("tg").agg(F.sum("dangerous").alias("dangerous"), F.count_if(fails).alias("units_failing"), F.sum("bands").alias("bands"), F.sum("wrong").alias("wrong"))
    rows = rows.withColumn("qualifies", (F.col("dangerous") == 0) & (F.col("units_failing") == 0))
    best = rows.agg(F.min(F.when(F.col("qualifies"), F.col("tg"))).alias("best")).scalar()
    return rows.withColumns({"chosen": F.coalesce(best, F.lit(fallback)), "is_fallback": best.isNull()})


def go_nogo(draws: DataFrame, head: str, k: str, draw: str, acc: str, cov: str, dangerous: str, forbidden: str, bars: dict[str, tuple[float, float]], n_draws: int) -> DataFrame:
    """Per (head, K) over the draws: means, and whether every criterion of that head holds; the smallest K that goes."""
    agg = draws.groupBy(head, k).agg(
        F.count(F.lit(1)).alias("draws"), F.avg(F.coalesce(acc, F.lit(0.0))).alias("mean_acc"), F.avg(cov).alias("mean_cov"), F.sum(dangerous).alias("dangerous"), F.max(forbidden).alias("worst_forbidden"))
    bar = F.create_map(*[x for h, (a, c) in bars.items() for x in (F.lit(h), F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")))])
    b = F.element_at(bar, F.col(head))
    go = (F.col("mean_acc") >= b["a"]) & (F.col("mean_cov") >= b["c"]) & (F.col("dangerous") == 0) & (F.col("worst_forbidden") == 0) & (F.col("draws") == n_draws)
    agg = agg.withColumn("go", go)
    order = F.create_map(*[x for i, h in enumerate(bars) for x in (F.lit(h), F.lit(i))])
    first = agg.where("go").agg(F.min(F.struct(F.element_at(order, F.col(head)).alias("o"), F.col(k).alias("k"), F.col(head).alias("h"))).alias("b")).scalar()
    return agg.withColumn("verdict", F.when(first.isNull(), "NO-GO").otherwise(F.concat(F.lit("GO "), first["h"], F.lit(" K="), first["k"].cast("string"))))
