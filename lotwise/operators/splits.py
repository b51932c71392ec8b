"""Deterministic samples, caps, splits, folds and weights.

Order comes from a digest of the key and a seed, so every run and every cluster picks the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hash_rank, hot_groups, prefix_sums


def seeded(key, seed: str) -> Column:
    """Hexadecimal order of a key under a seed."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(seed), k.cast("string")))


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group. Spark limits every map task to k rows per group before the shuffle,
    so a hot group reaches its last task as (map tasks x k) rows."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def sample_k(df: DataFrame, keys: list[str], key, seed: str, k: int) -> DataFrame:
    """k rows per group in seeded order."""
    return first_k(df.withColumn("_h", seeded(key, seed)), keys, [F.col("_h")], k).drop("_h")


def sample_share(df: DataFrame, keys: list[str], key, seed: str, size: Column, out: str = "picked") -> DataFrame:
    """Marks the first ``size`` rows of every group in seeded order; ``size`` may use the group's size ``rn_n``."""
    return (
        hash_rank(df.withColumn("_h", seeded(key, seed)), keys, "_h")
        .withColumn(out, F.col("rn") <= size)
        .drop("_h", "rn", "rn_n")
    )


def cell_weights(df: DataFrame, source: str, defect: str) -> DataFrame:
    """Every source weighs 1 in total, split evenly over its non-empty good / defect cells."""
    cells = df.groupBy(source, defect).agg(F.count(F.lit(1)).alias("_n"))
    w = cells.withColumn("_c", F.count(F.lit(1)).over(Window.partitionBy(source)))
    w = w.select(source, defect, (1.0 / (F.col("_c") * F.col("_n"))).alias("w"))
    return attach(df, w, [source, defect], hot_groups(df, [source, defect]))


def cap_per_group(df: DataFrame, keys: list[str], key, seed: str, cap: int) -> DataFrame:
    """At most ``cap`` seeded rows per group. Caps past Spark's group-limit threshold use the split ranking."""
    if cap <= 1000:
        return sample_k(df, keys, key, seed, cap)
    return sample_share(df, keys, key, seed, F.lit(cap)).where("picked").drop("picked")


def validation_split(df: DataFrame, keys: list[str], key, seed: str, share: float, rounding: str = "floor") -> DataFrame:
    """Marks a share of every group, at least one row; 'floor' cuts, 'round' rounds half to even."""
    want = F.col("rn_n") * F.lit(share)
    n = F.floor(want) if rounding == "floor" else F.bround(want)
    return sample_share(df, keys, key, seed, F.greatest(F.lit(1), n.cast("long")), out="is_val")


def inverse_weights(df: DataFrame, label: str) -> DataFrame:
    """Weight 1 / class size, scaled so that all weights sum to 1."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    k = n.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy()))  # one row per class
    return df.join(k.select(label, (1.0 / (F.col("_n") * F.col("_k"))).alias("w")), label)


def sampler_cells(df: DataFrame, kind: str, source: str, kind_weights: dict[str, float]) -> DataFrame:
    """Per (kind, source): row count, the weight of one row and of the whole cell; kinds present are renormalised."""
    kw = F.create_map(*[F.lit(x) for kv in kind_weights.items() for x in kv])
    cells = df.groupBy(kind, source).agg(F.count(F.lit(1)).alias("n")).withColumn("_kw", F.element_at(kw, F.col(kind)))
    per_kind = cells.groupBy(kind).agg(F.count(F.lit(1)).alias("_s"), F.first("_kw").alias("_w"))
    per_kind = per_kind.withColumn("_all", F.sum("_w").over(Window.partitionBy()))  # one row per kind
    cells = cells.join(per_kind.select(kind, "_s", "_all"), kind)
    return cells.select(kind, source, "n", (F.col("_kw") / F.col("_all") / F.col("_s")).alias("cell_w"),
                        (F.col("_kw") / F.col("_all") / F.col("_s") / F.col("n")).alias("row_w"))


def uniform(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from eight hexadecimal digits."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / 4294967296.0


def draw_with_replacement(draws: DataFrame, draw: str, pool: DataFrame, cells: DataFrame, kind: str, source: str, key: str, seed: str) -> DataFrame:
    """Every draw picks a cell by its weight, then a row of the cell by position.

    The cells (kinds x sources) are a bounded table; the row lookup is an equi-join on (cell, position)."""
    edge = cells.withColumn("hi", F.sum("cell_w").over(Window.orderBy(kind, source)))
    table = edge.agg(F.array_sort(F.collect_list(F.struct("hi", kind, source, "n"))).alias("c"))
    d = draws.withColumn("_h", seeded(draw, seed)).select(draw, uniform(F.col("_h")).alias("_u"), uniform(F.col("_h"), 9).alias("_u2"))
    d = d.withColumn("_c", table.scalar())
    d = d.withColumn("_at", F.least(F.size(F.filter("_c", lambda c: c["hi"] <= F.col("_u"))) + 1, F.size("_c")))
    d = d.withColumn("_p", F.element_at("_c", F.col("_at"))).select(
        draw, F.col(f"_p.{kind}").alias(kind), F.col(f"_p.{source}").alias(source), (F.floor(F.col("_u2") * F.col("_p.n")) + 1).alias("rn"))
    ranked = hash_rank(pool.withColumn("_h", seeded(key, seed)), [kind, source], "_h").select(kind, source, "rn", key)
    return d.join(ranked, [kind, source, "rn"]).select(draw, kind, source, key)


def calibration_draw(df: DataFrame, source: str, photo: str, key: str, defect: str, k: int, seed: str) -> DataFrame:
    """Adds role per item: 'cal' (k/2 good and k/2 defect items of the chosen photos), 'unused' (other items of those
    photos) or 'test'. Photos are taken in seeded order: first those with a good item until k/2 good items are there,
    then further ones until k/2 defects are. Sources that cannot supply both are left out."""
    half = k // 2
    per = df.groupBy(source, photo).agg(F.count_if(F.col(defect) == 0).alias("g"), F.count_if(F.col(defect) == 1).alias("d"))
    per = per.withColumn("_o", seeded(photo, seed)).withColumn("gg", F.when(F.col("g") > 0, F.col("g")).otherwise(0))
    b = F.substring("_o", 1, 2)
    run = prefix_sums(per, [source], "_o", ["gg"], bucket=b)
    run = run.withColumn("first", (F.col("g") > 0) & (F.col("cum_gg") - F.col("gg") < half))
    base = run.groupBy(source).agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("d"))), F.lit(0)).alias("d0"))
    rest = run.join(base, source).withColumn("dd", F.when(F.col("first"), 0).otherwise(F.col("d"))).drop("cum_gg")
    rest = prefix_sums(rest, [source], "_o", ["dd"], bucket=b)
    chosen = rest.withColumn("chosen", F.col("first") | (F.col("d0") + F.col("cum_dd") - F.col("dd") < half))
    enough = chosen.where("chosen").groupBy(source).agg(F.sum("g").alias("sg"), F.sum("d").alias("sd")).where((F.col("sg") >= half) & (F.col("sd") >= half))
    chosen = chosen.join(enough.select(source), source, "left_semi").select(source, photo, "chosen")
    rows = df.join(chosen, [source, photo])
    cal = sample_k(rows.where("chosen"), [source, defect], key, seed, half).select(key, F.lit(True).alias("_cal"))
    rows = rows.join(cal, key, "left")
    return rows.withColumn("role", F.when(F.col("_cal"), "cal").when(F.col("chosen"), "unused").otherwise("test")).drop("_cal", "chosen")


def fold_sizes(df: DataFrame, modes: dict[str, Column], trains: Column | None = None) -> DataFrame:
    """(mode, fold, n_test, n_train) of several ways of folding, without a row per fold and item.

    A mode's column names the fold that an item is tested in (NULL: in none); it is trained on in all other folds of the mode,
    if ``trains`` holds. So a fold is a rule, and its training size is the total less its own rows. One pass counts the
    cells of all modes; the modes are summed from that table."""
    may = F.lit(True) if trains is None else F.coalesce(trains, F.lit(False))
    cells = df.groupBy(*[c.alias(m) for m, c in modes.items()], may.alias("_may")).agg(F.count(F.lit(1)).alias("_n"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).cast("string").alias("fold")) for m in modes]))
    own = cells.select(each.alias("f"), "_may", "_n").groupBy("f.mode", "f.fold").agg(
        F.sum("_n").alias("n_test"), F.coalesce(F.sum(F.when(F.col("_may"), F.col("_n"))), F.lit(0)).alias("_own"))
    total = cells.agg(F.coalesce(F.sum(F.when(F.col("_may"), F.col("_n"))), F.lit(0)).alias("n")).scalar()
    return own.where("fold IS NOT NULL").select("mode", "fold", "n_test", (total - F.col("_own")).alias("n_train"))


def fold_role(test_fold: Column, fold: Column, trains: Column | None = None) -> Column:
    """'test', 'train' or 'none': the role of an item in one fold, from the fold it is tested in."""
    may = F.lit(True) if trains is None else F.coalesce(trains, F.lit(False))
    return F.when(test_fold.eqNullSafe(fold), "test").when(may, "train").otherwise("none")


def fold_leaks(df: DataFrame, modes: dict[str, Column], group: str) -> DataFrame:
    """(mode, groups, leaking): groups with items on both sides of some fold, that is tested in more than one fold or only in part."""
    spread = [((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(m) for m, c in modes.items()]
    per = df.groupBy(group).agg(*spread)
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(F.col(m), F.lit(False)).alias("leak")) for m in modes]))
    return per.select(each.alias("f")).groupBy("f.mode").agg(F.count(F.lit(1)).alias("groups"), F.count_if("f.leak").alias("leaking"))
