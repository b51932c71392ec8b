"""Exact ranks, prefix sums and quantiles that never put one whole group into one task.

The plain Spark forms (``percentile``, an ordered window) hold a whole group in one place. That is the
right plan for ordinary groups; the forms here split a group by a *monotone* bucket first: small per-bucket
totals give every bucket its offset, and the ordered work happens inside one (group, bucket) cell.
Nothing is sampled away: approximate quantiles only choose the bucket edges, and any edges give exact results.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000  # groups over this many rows leave Spark's plain quantile
SPLIT_ROWS = 2_000_000  # ordered windows are split once a group is over this many rows
BUCKETS = 256
CHECK = object()  # "look for oversized groups yourself"


def quantile_edges(df: DataFrame, value: str, buckets: int = BUCKETS) -> list[float]:
    """Inner bucket edges (at most ``buckets - 1`` doubles on the driver, whatever the data size)."""
    probs = [i / buckets for i in range(1, buckets)]
    edges = df.select(F.col(value).cast("double").alias(value)).approxQuantile(value, probs, 0.25 / buckets)
    return sorted(set(edges or []))


def with_bucket(df: DataFrame, value: str, edges: list[float], out: str = "_b") -> DataFrame:
    """Monotone bucket number of ``value`` (binary search in the JVM)."""
    splits = [float("-inf"), *edges, float("inf")]
    tmp = df.withColumn("_edge_in", F.col(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="_edge_in", outputCol=out, handleInvalid="keep").transform(tmp).drop("_edge_in")


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the largest group: a map-side combined count, one number on the driver."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else df.agg(F.count(F.lit(1)).alias("_n"))
    return n.agg(F.max("_n").alias("m")).first()["m"] or 0


def prefix_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], bucket: Column | None = None, limit: int | None = None) -> DataFrame:
    """Adds ``cum_<s>``: the inclusive running total of every ``s`` by ``order`` within ``keys``.

    ``df`` holds one row per (keys, order): aggregate before calling. When no group is over ``limit`` rows this is an
    ordinary window. Otherwise groups are split by ``bucket``, any expression that never falls as ``order`` grows
    (a digest's first digits, say); by default it comes from quantile edges."""
    largest = largest_group(df, keys)
    limit = SPLIT_ROWS if limit is None else limit
    if largest <= limit:
        run = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(s).over(run).alias(f"cum_{s}") for s in sums])
    if bucket is None:
        rows = with_bucket(df, order, quantile_edges(df, order, min(4096, max(16, 4 * largest // limit))))
    else:
        rows = df.withColumn("_b", bucket)
    cells = rows.groupBy(*keys, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys, "_b", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(offsets, [*keys, "_b"])
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(inside) + F.col(f"_o_{s}"))
    return out.drop("_b", *[f"_o_{s}" for s in sums])


def dense_index(df: DataFrame, value: str, out: str = "idx") -> DataFrame:
    """Distinct values of a numeric column with their zero-based position in natural order."""
    one = df.select(value).distinct().withColumn("_one", F.lit(1))
    return prefix_sums(one, [], value, ["_one"]).select(value, (F.col("cum__one") - 1).alias(out))


def hash_rank(df: DataFrame, keys: list[str], digest: str, out: str = "rn", limit: int | None = None) -> DataFrame:
    """Row number within ``keys`` by a hexadecimal digest, plus the group's size as ``<out>_n``.

    When no group is over ``limit`` rows this is an ordinary window. Otherwise the first digits of the digest are the
    bucket, as many of them as bring the largest group under the limit, so it is spread evenly over its cells."""
    largest = largest_group(df, keys)
    limit = SPLIT_ROWS if limit is None else limit
    if largest <= limit:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(digest)).cast("long")
        return df.select("*", rank.alias(out), F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias(f"{out}_n"))
    chars = min(6, max(1, math.ceil(math.log(2 * largest / limit, 16))))
    rows = df.withColumn("_b", F.substring(digest, 1, chars))
    cells = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = cells.select(
        *keys, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
        F.sum("_n").over(whole).alias(f"{out}_n"),
    )
    inside = Window.partitionBy(*keys, "_b").orderBy(digest)
    return (
        rows.join(offsets, [*keys, "_b"])
        .withColumn(out, (F.row_number().over(inside) + F.col("_o")).cast("long"))
        .drop("_b", "_o")
    )


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct column (a scalar subquery), to be used beside every row of another table."""
    return df.select(F.struct(*df.columns)).scalar()


def hot_groups(df: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame | None:
    """Groups larger than ``limit`` (there can be at most rows / limit of them), or None when there are none."""
    limit = HOT_ROWS if limit is None else limit
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select(*keys)
    return None if hot.isEmpty() else hot


def attach(df: DataFrame, stats: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """Rows joined with one line of statistics per group.

    Rows of oversized groups (``hot``, from ``hot_groups``) meet their few lines by broadcast, where they are; all
    others by an ordinary join. So no task receives a whole hot group, whatever is computed on top."""
    if hot is None:
        return df.join(stats, keys, how)
    few = F.broadcast(stats.join(F.broadcast(hot), keys, "left_semi"))  # at most rows / limit lines
    cold = df.join(F.broadcast(hot), keys, "left_anti").join(stats, keys, how)
    return cold.unionByName(df.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], hot_rows: int | None = None, hot=CHECK) -> DataFrame:
    """Linear-interpolated quantiles per group, exact for any group size.

    Ordinary groups use Spark's ``percentile``; groups over ``hot_rows`` go through two counting passes.
    A caller that already knows the oversized groups (of this table or of one that contains it) passes them as ``hot``.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())

    def plain(d: DataFrame) -> DataFrame:
        all_at_once = F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs.values()]))
        return d.groupBy(*keys).agg(all_at_once.alias("_q")).select(*keys, *[F.get("_q", i).alias(n) for i, n in enumerate(probs)])

    if not keys:
        if rows.count() <= hot_rows:
            return plain(rows)
        return _refined(rows, keys, probs)
    hot = hot_groups(rows, keys, hot_rows) if hot is CHECK else hot
    if hot is None:
        return plain(rows)
    return plain(rows.join(F.broadcast(hot), keys, "left_anti")).unionByName(
        _refined(rows.join(F.broadcast(hot), keys, "left_semi"), keys, probs)
    )


def exact_medians(df: DataFrame, keys: list[str], values: list[str], suffix: str = "_med", hot_rows: int | None = None, hot=CHECK) -> DataFrame:
    """Exact median of several columns per group in one shuffle; oversized groups as in ``exact_quantiles``."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    rows = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values])
    plain = lambda d: d.groupBy(*keys).agg(*[F.median(v).alias(f"{v}{suffix}") for v in values])
    hot = hot_groups(rows, keys, hot_rows) if hot is CHECK else hot
    if hot is None:
        return plain(rows)
    big = rows.join(F.broadcast(hot), keys, "left_semi")
    slow = None
    for v in values:
        one = _refined(big.select(*keys, F.col(v).alias("_v")).where(F.col("_v").isNotNull()), keys, {f"{v}{suffix}": 0.5})
        slow = one if slow is None else slow.join(one, keys, "full_outer")
    return plain(rows.join(F.broadcast(hot), keys, "left_anti")).unionByName(slow)


def quantiles_long(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles as rows (*keys, name, value), for any number of probabilities and any group size."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = with_bucket(rows, "_v", quantile_edges(rows, "_v"))
    cells = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_hi", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in probs.items()]))
    place = (F.col("_all") - 1) * F.col("p.q")
    ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), f(place).cast("long").alias("rank")) for side, f in (("lo", F.floor), ("hi", F.ceil))]))
    wanted = cells.withColumn("p", asked).select(
        *keys, "_b", (F.col("_hi") - F.col("_n")).alias("_o"), "_hi", F.col("p.name").alias("name"), (place - F.floor(place)).alias("frac"), ends.alias("w"))
    wanted = wanted.where((F.col("w.rank") >= F.col("_o")) & (F.col("w.rank") < F.col("_hi")))
    need = wanted.select(*keys, "_b").distinct()
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        rows.join(F.broadcast(need), [*keys, "_b"], "left_semi")
        .groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_upto", F.sum("_c").over(inside))
    )
    picked = wanted.join(values, [*keys, "_b"]).where(
        (F.col("w.rank") - F.col("_o") >= F.col("_upto") - F.col("_c")) & (F.col("w.rank") - F.col("_o") < F.col("_upto"))
    )
    at = lambda side: F.max(F.when(F.col("w.side") == side, F.col("_v")))
    ends = picked.groupBy(*keys, "name").agg(at("lo").alias("_l"), at("hi").alias("_h"), F.max("frac").alias("_f"))
    return ends.select(*keys, "name", (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_f")).alias("value"))


def _refined(rows: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    long = quantiles_long(rows, keys, "_v", probs)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in probs])
