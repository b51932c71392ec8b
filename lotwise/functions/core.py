"""Column functions: intervals, bands, array maths, colour and box geometry. All stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c) -> Column:
    """Rounded to 6 places for reports. The nudge keeps values that end in a 5 off the tie, so that the last bit of a
    sum does not decide; adding zero removes the sign of a rounded-away negative."""
    return F.round(col(c).cast("double") + F.lit(1e-10), 6) + F.lit(0.0)


def ratio(a, b) -> Column:
    """a / b, NULL where b is zero."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


# ---------------------------------------------------------------- intervals and bands

def wilson(k, n, z: float = C.Z95) -> tuple[Column, Column, Column]:
    """(p, lo, hi) of the Wilson score interval. Undefined input gives p NULL and the whole range."""
    k, n = col(k).cast("double"), col(n).cast("double")
    ok = (n > 0) & (k >= 0) & (k <= n)
    m = F.when(ok, n)
    z2 = z * z
    p = k / m
    den = 1 + z2 / m
    mid = (p + z2 / (2 * m)) / den
    half = z * F.sqrt(p * (1 - p) / m + z2 / (4 * m * m)) / den
    lo = F.coalesce(F.greatest(F.lit(0.0), mid - half), F.lit(0.0))
    hi = F.coalesce(F.least(F.lit(1.0), mid + half), F.lit(1.0))
    return p, F.when(ok, lo).otherwise(0.0), F.when(ok, hi).otherwise(1.0)


def band_of_rate(p) -> Column:
    p = col(p)
    return (
        F.when(p.isNull() | F.isnan(p), "unsure")
        .when(p < C.CLEAN_MAX, "clean")
        .when(p <= C.MANY_MIN, "some")
        .otherwise("many")
    )


def band_of_interval(lo, hi) -> Column:
    """A band only when both ends of the interval share it."""
    return F.when(band_of_rate(lo) == band_of_rate(hi), band_of_rate(lo)).otherwise("unsure")


def crosses_edge(p, lo, hi) -> Column:
    b = band_of_rate(p)
    return (b == "unsure") | (band_of_rate(lo) != b) | (band_of_rate(hi) != b)


def gauge_position(rate) -> Column:
    """Where a rate sits on a three-part axis whose parts end at 5 % and 20 %."""
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(rate)))
    third = F.lit(1.0) / 3
    t = (
        F.when(x <= C.CLEAN_MAX, x / C.CLEAN_MAX * third)
        .when(x <= C.MANY_MIN, third + (x - C.CLEAN_MAX) / (C.MANY_MIN - C.CLEAN_MAX) * third)
        .otherwise(2 * third + (x - C.MANY_MIN) / (1 - C.MANY_MIN) * third)
    )
    return F.greatest(F.lit(0.005), F.least(F.lit(0.995), t))


# ---------------------------------------------------------------- arrays

def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def asum(a) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return asum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x * x))


def unit(a, floor: float = 1e-9) -> Column:
    return let(F.greatest(l2norm(a), F.lit(floor)), lambda n: F.transform(col(a), lambda x: x / n))


def cosine(a, b, floor: float = 1e-9) -> Column:
    return dot(a, b) / (F.greatest(l2norm(a), F.lit(floor)) * F.greatest(l2norm(b), F.lit(floor)))


def softmax(z, t=1.0) -> Column:
    """Softmax of z / t with the maximum taken out first."""
    t = t if isinstance(t, Column) else F.lit(float(t))
    z = col(z)
    e = let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp((x - m) / t)))
    return let(e, lambda v: let(asum(v), lambda s: F.transform(v, lambda x: x / s)))


def argmax(a) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(col(a), F.array_max(col(a))) - 1).cast("int")


def energy(z) -> Column:
    """Minus the log of the summed exponentials, maximum taken out first."""
    z = col(z)
    return let(F.array_max(z), lambda m: -(m + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - m)))))


def retemper(p, t_old: float, t_new: float) -> Column:
    """Probabilities made at t_old re-read at t_new."""
    logs = F.transform(col(p), lambda x: F.log(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x))) * t_old)
    return softmax(logs, t_new)


def bits_to_hex(bits: Column) -> Column:
    return F.lower(F.conv(F.array_join(bits, ""), 2, 16))


# ---------------------------------------------------------------- colour

def with_hsv(df: DataFrame, r: str = "r", g: str = "g", b: str = "b") -> DataFrame:
    """Adds h (degrees), s and v of 0..255 channels. Built in steps so that no step is computed twice."""
    hi, lo = F.col("_hi"), F.col("_lo")
    span = F.nullif(hi - lo, F.lit(0.0))
    rc, gc, bc = (hi - F.col("_r")) / span, (hi - F.col("_g")) / span, (hi - F.col("_b")) / span
    h6 = F.when(F.col("_r") == hi, bc - gc).when(F.col("_g") == hi, 2.0 + rc - bc).otherwise(4.0 + gc - rc) / 6.0
    return (
        df.withColumns({"_r": F.col(r) / 255.0, "_g": F.col(g) / 255.0, "_b": F.col(b) / 255.0})
        .withColumns({"_hi": F.greatest("_r", "_g", "_b"), "_lo": F.least("_r", "_g", "_b")})
        .withColumn("_h6", F.coalesce(h6, F.lit(0.0)))
        .withColumns({
            "h": (F.col("_h6") - F.floor("_h6")) * 360,
            "s": F.coalesce((hi - lo) / F.nullif(hi, F.lit(0.0)), F.lit(0.0)),
            "v": hi,
        })
        .drop("_r", "_g", "_b", "_hi", "_lo", "_h6")
    )


def colour_class(h, s, v) -> Column:
    k = C.COLOUR_RULE
    h, s, v = col(h), col(s), col(v)
    return (
        F.when(v < k["dark_v"], "dark")
        .when((s < k["white_s"]) & (v >= k["white_v"]), "white")
        .when((h < k["hue_min"]) | (h > k["hue_max"]) | (s > k["sat_max"]), "off")
        .otherwise("pale")
    )


def luma(r, g, b) -> Column:
    return 0.299 * col(r) + 0.587 * col(g) + 0.114 * col(b)


def chroma(r, g, b) -> Column:
    return F.greatest(col(r), col(g), col(b)) - F.least(col(r), col(g), col(b))


def white_balance(value, ref) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), col(value) * (C.SHEET_TARGET / F.greatest(col(ref), F.lit(1.0)))))


# ---------------------------------------------------------------- boxes

def iou(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = (col(x) for x in (ax0, ay0, ax1, ay1, bx0, by0, bx1, by1))
    w = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    h = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    inter = w * h
    union = (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter
    return F.coalesce(inter / F.nullif(union, F.lit(0.0)), F.lit(0.0))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps up, then back by the recurrence."""
    z = x + 8.0
    series = 1.0 / (12.0 * z) - 1.0 / (360.0 * z**3) + 1.0 / (1260.0 * z**5) - 1.0 / (1680.0 * z**7) + 1.0 / (1188.0 * z**9)
    steps = x
    for i in range(1, 8):
        steps = steps * (x + float(i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(steps)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, term by term from the top (modified Lentz)."""
    terms = F.sequence(F.lit(1), (F.lit(200) + 8 * F.sqrt(F.greatest(a, b))).cast("int"))

    def step(acc, k):
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        t = F.when(k % 2 == 0, even).otherwise(odd)
        c, d = 1.0 + t / acc["c"], 1.0 / (1.0 + t * acc["d"])
        return F.struct(c.alias("c"), d.alias("d"), (acc["g"] * c * d).alias("g"))

    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(1.0).alias("g"))
    return 1.0 / F.aggregate(terms, start, step)["g"]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function for 0 <= x <= 1; the side of the two that converges fast is worked out."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    low = front * _beta_fraction(a, b, x) / a
    high = 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a t at least as far from zero with ``df`` degrees of freedom; null without any."""
    df = df.cast("double")
    return F.when(df > 0, beta_inc(df / 2, F.lit(0.5), df / (df + t * t)))
