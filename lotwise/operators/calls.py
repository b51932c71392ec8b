"""One call per item from its class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn


def call_pair(p_good, touching=None, tg: float | None = C.T_GOOD, td: float | None = C.T_DEFECT) -> Column:
    """Two thresholds; None means that call is never made. NULL probability or touching gives unsure."""
    p = fn.col(p_good)
    tg, td = (2.0 if tg is None else tg), (2.0 if td is None else td)
    c = F.when(p.isNull(), C.UNSURE)
    if touching is not None:
        c = c.when(F.coalesce(fn.col(touching), F.lit(False)), C.UNSURE)
    return c.when(p >= tg, C.GOOD).when(1 - p >= td, C.DEFECT).otherwise(C.UNSURE)


def call_override(p_good, value, touching, tg=C.T_GOOD, td=C.T_DEFECT, dark_below: float = 0.30) -> Column:
    """Two thresholds, then: a dark value forces defect; touching still wins."""
    return (
        F.when(F.coalesce(fn.col(touching), F.lit(False)), C.UNSURE)
        .when(fn.col(value) < dark_below, C.DEFECT)
        .otherwise(call_pair(p_good, None, tg, td))
    )


def call_argmax(probs, touching, abstain_below: float) -> Column:
    """Class name of the first largest probability when it is large enough, else 'unsure'."""
    p = fn.col(probs)
    names = F.array(*[F.lit(c) for c in C.CLASSES])
    return (
        F.when(p.isNull() | F.coalesce(fn.col(touching), F.lit(False)) | (F.array_max(p) < abstain_below), "unsure")
        .otherwise(F.element_at(names, fn.argmax(p) + 1))
    )


def likely_type(probs) -> Column:
    """Most likely defect class, whatever P(good) says; the first wins a tie."""
    rest = F.slice(fn.col(probs), 2, len(C.DEFECTS))
    return F.element_at(F.array(*[F.lit(c) for c in C.DEFECTS]), fn.argmax(rest) + 1)


def finite_or(value: Column, default: float) -> Column:
    """A number from text; the default when it is missing, not a number or not finite."""
    x = fn.col(value).try_cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(default)).otherwise(x)
