"""What may leave the system: redacted records and the short slip text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C


def redact_unsure(df: DataFrame, keep: list[str], hide: list[str], band: str = "band") -> DataFrame:
    """An unsure verdict keeps only ``keep``; the other columns become NULL."""
    return df.select(*keep, *[F.when(F.col(band) != "unsure", F.col(c)).alias(c) for c in hide])


def script_digits(x: Column) -> Column:
    return F.translate(x.cast("string"), "0123456789", C.ARABIC_DIGITS)


def slip_text(day: Column, total: Column, defects: Column, unsure: Column, is_unsure: Column, prefix: str = "") -> Column:
    """Longest wording that fits the message; an unsure lot carries no counts at all."""
    long_day = F.concat(F.lit(prefix), script_digits(F.date_format(day, "d/M/yy")))
    short_day = F.concat(F.lit(prefix), script_digits(F.date_format(day, "d/M")))
    n = script_digits(total)
    none = F.concat(F.lit(f": {C.SLIP_UNSURE}، "), n, F.lit(f" حبة. {C.SLIP_TAG}"))
    bad = F.when(defects > 0, F.concat(script_digits(defects), F.lit(" فيها عيب"))).otherwise("ما فيه عيوب")
    vague = F.when(unsure > 0, F.concat(F.lit("، "), script_digits(unsure), F.lit(" مش واضحة"))).otherwise("")
    body = lambda d, extra: F.concat(d, F.lit(": "), n, F.lit(" حبة، "), bad, extra, F.lit(f". {C.SLIP_TAG}"))
    fits = lambda x: F.when(F.length(x) <= C.SLIP_MAX, x)
    sure = F.coalesce(fits(body(long_day, vague)), fits(body(short_day, vague)), body(short_day, F.lit("")))
    unsure_text = F.coalesce(fits(F.concat(long_day, none)), F.concat(short_day, none))
    return F.when(is_unsure, unsure_text).otherwise(sure)
