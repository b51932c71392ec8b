"""From per-item calls to one verdict per lot, and the tallies built on verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn


def tally_calls(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Counts of every call per group: one partial + final hash aggregation whatever the group sizes."""
    n = lambda c: F.count_if(F.col(code) == c)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        n(C.GOOD).alias("good"),
        n(C.DEFECT).alias("defects"),
        n(C.UNSURE).alias("unsure"),
        F.count_if(F.col(code) != C.UNSURE).alias("answered"),
    )


def decide(counts: DataFrame, handfuls: Column | int = 1) -> DataFrame:
    """Verdict columns for a table of call counts."""
    p, lo, hi = fn.wilson("defects", "answered")
    hf = handfuls if isinstance(handfuls, Column) else F.lit(handfuls)
    uf = F.when(F.col("total") > 0, F.col("unsure") / F.col("total")).otherwise(1.0)
    out = counts.withColumns({"p": p, "lo": lo, "hi": hi, "unsure_frac": uf})
    out = out.withColumn(
        "reason",
        F.when(F.col("answered") == 0, "too_many_unsure")
        .when(F.col("p") > C.IMPLAUSIBLE_DEFECT_FRAC, "implausible")
        .when(F.col("unsure_frac") > C.MAX_UNSURE_FRAC, "too_many_unsure")
        .otherwise(""),
    )
    ok = F.col("reason") == ""
    out = out.withColumns({
        "band": F.when(ok, fn.band_of_rate("p")).otherwise("unsure"),
        "about": F.when(ok, fn.crosses_edge("p", "lo", "hi")).otherwise(False),
    })
    return out.withColumn("can_add", (F.col("band") != "unsure") & F.col("about") & (hf < C.MAX_HANDFULS))


def lot_verdict(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    return decide(tally_calls(df, keys, code))


def lot_verdict_v0(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """The older verdict: a band only when the whole interval lies in it."""
    return decide_v0(tally_calls(df, keys, code))


def decide_v0(counts: DataFrame) -> DataFrame:
    p, lo, hi = fn.wilson("defects", "answered")
    uf = F.when(F.col("total") > 0, F.col("unsure") / F.col("total")).otherwise(1.0)
    out = counts.withColumns({"p": p, "lo": lo, "hi": hi, "unsure_frac": uf})
    stop = (F.col("answered") == 0) | (F.col("unsure_frac") > C.MAX_UNSURE_FRAC)
    band = F.when(stop, "unsure").otherwise(fn.band_of_interval("lo", "hi"))
    return out.withColumns({
        "band": band,
        "reason": F.when(stop, "too_many_unsure").when(band == "unsure", "interval_spans_bands").otherwise(""),
    })


COUNTS = ["total", "good", "defects", "unsure", "answered"]


def pooled_verdict(df: DataFrame, lot: list[str], handful: str, code: str = "code") -> DataFrame:
    """All handfuls of a lot pooled; the first unsure handful vetoes the band with its own reason."""
    each = decide(tally_calls(df, [*lot, handful], code))
    bad = F.col("band") == "unsure"
    pooled = each.groupBy(*lot).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.count(F.lit(1)).alias("handfuls"),
        F.min(F.when(bad, F.struct(F.col(handful), F.col("reason")))).alias("_veto"),
    )
    out = decide(pooled, F.col("handfuls"))
    veto = (F.col("band") != "unsure") & F.col("_veto").isNotNull()
    return out.select(
        *lot, "handfuls", *COUNTS, "p", "lo", "hi", "unsure_frac",
        F.when(veto, F.col("_veto.reason")).otherwise(F.col("reason")).alias("reason"),
        F.when(veto, "unsure").otherwise(F.col("band")).alias("band"),
        (F.col("about") & ~veto).alias("about"),
        (F.col("can_add") & ~veto).alias("can_add"),
    )


def ledger(counts: DataFrame) -> DataFrame:
    """found = sure + not sure, sure = defects + sound; the dot list is kept run-length coded."""
    out = counts.withColumns({
        "found": F.col("total"), "sound": F.col("good"), "not_sure": F.col("unsure"),
        "sure": F.col("defects") + F.col("good"),
    })
    return out.withColumns({
        "adds_up": (F.col("found") == F.col("sure") + F.col("not_sure")) & (F.col("sure") == F.col("defects") + F.col("sound")),
        "dots": F.format_string("defect:%d sound:%d unsure:%d", "defects", "good", "unsure"),
    })


def outcome(gate: Column, band: Column, reason: Column) -> Column:
    """One text per photo: retake:<gate>, notsure:<reason> or the band."""
    return (
        F.when(F.coalesce(gate, F.lit("")) != "", F.concat(F.lit("retake:"), gate))
        .when(band == "unsure", F.concat(F.lit("notsure:"), reason))
        .otherwise(band)
    )


def outcome_kind(o: Column) -> Column:
    return F.when(o.startswith("retake"), "retake").when(o.startswith("notsure"), "notsure").otherwise("band")


def outcome_tally(df: DataFrame, group: str, out: str = "outcome") -> DataFrame:
    """Per group and over all groups: photos by kind, share with a band, outcome counts as text."""
    k = outcome_kind(F.col(out))
    base = df.select(F.col(group).cast("string").alias("grp"), F.col(out).alias("o"), k.alias("k"))
    by = base.groupBy("grp", "o", "k").agg(F.count(F.lit(1)).alias("n"))
    both = by.unionByName(by.withColumn("grp", F.lit("all")))
    both = both.groupBy("grp", "o", "k").agg(F.sum("n").alias("n"))
    kind = lambda v: F.sum(F.when(F.col("k") == v, F.col("n")).otherwise(0))
    return both.groupBy("grp").agg(
        F.sum("n").alias("photos"),
        kind("band").alias("given_band"), kind("notsure").alias("not_sure"), kind("retake").alias("retake"),
        fn.r6(100.0 * kind("band") / F.sum("n")).alias("pct_band"),
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "o", F.col("n").cast("string")))), " ").alias("outcomes"),
    )


def lot_score(df: DataFrame, keys: list[str], truth: str = "truth", out: str = "outcome") -> DataFrame:
    """Bands given, right, wrong, and dangerous both ways."""
    t, o = F.col(truth), F.col(out)
    band = outcome_kind(o) == "band"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("lots"),
        F.count_if(band).alias("bands"),
        F.count_if(band & (t == o)).alias("correct"),
        F.count_if(band & (t != o)).alias("wrong"),
        F.count_if((t == "clean") & (o == "many")).alias("clean_called_many"),
        F.count_if((t == "many") & (o == "clean")).alias("many_called_clean"),
    )
