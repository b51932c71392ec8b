"""Duplicates, collisions and inventory of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.scale import attach, hot_groups
from lotwise.session import cut_lineage


def keep_first(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """First row of every digest. A min over a struct combines on the map side, so a digest that a third of all
    rows share costs one row per task."""
    rest = [c for c in df.columns if c != digest and c not in order]
    first = df.groupBy(digest).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_r"))
    return first.select(digest, "_r.*").select(*df.columns)


def precedence_dedupe(df: DataFrame, reference: DataFrame | None, *, source: str, order: str, path: str, src_hash: str, crop_hash: str) -> DataFrame:
    """Exact duplicates with source precedence. Adds keep and reason: src_cross, src_within, crop_cross, crop_within.

    Rules per row, in order: its file hash was kept in an earlier source (or is in the reference set); the hash was
    first met in this source under another file; its crop hash was kept in an earlier source (or reference); its crop
    hash was already kept in this source.

    The state of the sequential pass is a set of kept hashes, so the pass is solved over distinct
    (source, file hash, crop hash) cells: a cell is decided as soon as every earlier cell it could lose to is decided.
    Copies never meet each other in a join, and the number of rounds is the depth of the deepest chain, not the
    number of sources.
    """
    s, m, c = source, src_hash, crop_hash
    hot_file, hot_m, hot_c = hot_groups(df, [s, m]), hot_groups(df, [m]), hot_groups(df, [c])
    first_path = df.groupBy(s, m).agg(F.min_by(path, order).alias("_p0"))
    rows = attach(df, first_path, [s, m], hot_file).withColumn("_other", F.col(path) != F.col("_p0"))
    cells = rows.where(~F.col("_other")).groupBy(s, m, c).agg(F.min(order).alias("_pos"))
    if reference is not None:
        cells = cells.join(reference.select(F.col(m), F.lit(True).alias("_rm")).distinct(), m, "left")
        cells = cells.join(reference.select(F.col(c), F.lit(True).alias("_rc")).distinct(), c, "left")
    else:
        cells = cells.withColumns({"_rm": F.lit(None).cast("boolean"), "_rc": F.lit(None).cast("boolean")})
    # state: 0 undecided, 1 kept, 2 dropped
    at = F.struct(F.col(s), F.col("_pos"))
    state = F.when(F.coalesce("_rm", "_rc", F.lit(False)), 2).otherwise(0)
    cells = cut_lineage(cells.withColumn("_st", state))
    while True:
        alive, kept = F.col("_st") < 2, F.col("_st") == 1
        by_c = cells.groupBy(c).agg(F.min(F.when(alive, at)).alias("_ca"), F.min(F.when(kept, at)).alias("_ck"))
        by_m = cells.groupBy(m).agg(F.min(F.when(alive, F.col(s))).alias("_ma"), F.min(F.when(kept, F.col(s))).alias("_mk"))
        x = attach(attach(cells, by_c, [c], hot_c), by_m, [m], hot_m)
        lost = F.coalesce(F.col("_ck") < at, F.lit(False)) | F.coalesce(F.col("_mk") < F.col(s), F.lit(False))
        free = (F.col("_ca") == at) & (F.col("_ma") == F.col(s))
        new = F.when(F.col("_st") > 0, F.col("_st")).when(lost, 2).when(free, 1).otherwise(0)
        cells = cut_lineage(x.select(s, m, c, "_pos", "_rm", "_rc", new.alias("_st")))
        if cells.where("_st = 0").isEmpty():
            break
    # reasons: what had been kept before the row, by source for "cross" and by position for "within"
    kept = cells.where("_st = 1")
    km = kept.groupBy(m).agg(F.min(s).alias("_ms"))
    kc = kept.groupBy(c).agg(F.min(F.struct(F.col(s), F.col("_pos"))).alias("_cs"))
    # crop hash kept in this source: the earliest position per (source, crop hash)
    if reference is not None:
        km = km.join(reference.select(F.col(m), F.lit(True).alias("_rm")).distinct(), m, "full_outer")
        kc = kc.join(reference.select(F.col(c), F.lit(True).alias("_rc")).distinct(), c, "full_outer")
    out = attach(attach(rows, km, [m], hot_m, "left"), kc, [c], hot_c, "left")
    if reference is None:
        out = out.withColumns({"_rm": F.lit(None).cast("boolean"), "_rc": F.lit(None).cast("boolean")})
    yes = lambda x: F.coalesce(x, F.lit(False))
    reason = (
        F.when(yes(F.col("_rm")) | yes(F.col("_ms") < F.col(s)), "src_cross")
        .when(F.col("_other"), "src_within")
        .when(yes(F.col("_rc")) | yes(F.col(f"_cs.{s}") < F.col(s)), "crop_cross")
        .when(yes((F.col(f"_cs.{s}") == F.col(s)) & (F.col("_cs._pos") < F.col(order))), "crop_within")
        .otherwise("")
    )
    owner = F.when(reason == "src_within", F.col("_p0").cast("string")).when(reason == "src_cross", F.coalesce(F.col("_ms").cast("string"), F.lit("reference"))).when(
        reason == "crop_cross", F.coalesce(F.col(f"_cs.{s}").cast("string"), F.lit("reference"))).when(reason == "crop_within", F.col(s).cast("string"))
    return out.withColumns({"reason": reason, "keep": reason == "", "dup_of": owner}).select(*df.columns, "keep", "reason", "dup_of")


def hash_cross_source(df: DataFrame, digest: str, source: str) -> DataFrame:
    """Digests met in more than one source, counted per set of sources."""
    pairs = df.select(digest, source).distinct()
    sets = pairs.groupBy(digest).agg(F.array_join(F.sort_array(F.collect_set(source)), "+").alias("sources"), F.count(F.lit(1)).alias("n_src"))
    return sets.where("n_src > 1").groupBy("sources").agg(F.count(F.lit(1)).alias("buckets"))


def hash_within(df: DataFrame, digest: str, source: str, path: str, order: str) -> DataFrame:
    """Rows per source whose digest was first met in another file of the same source."""
    cells = df.groupBy(source, digest, path).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("o"))
    per = cells.groupBy(source, digest).agg(F.sum("n").alias("n"), F.min_by("n", "o").alias("own"))
    return per.groupBy(source).agg(F.sum(F.col("n") - F.col("own")).alias("rows")).where("rows > 0")


def rounds_until(df: DataFrame, step, undecided: Column) -> DataFrame:
    """Repeats ``step`` on a checkpointed table until no row is undecided."""
    df = cut_lineage(df)
    while not df.where(undecided).isEmpty():
        df = cut_lineage(step(df))
    return df
