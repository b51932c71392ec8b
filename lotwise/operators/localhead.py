"""Prototype heads fitted from labelled vectors, their answers, and ML baselines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise import constants as C
from lotwise.functions import core as fn
from lotwise.functions.scale import attach, exact_quantiles, hot_groups

HEAD_ROWS = 5000  # labelled items of one logistic head


def proto_fit(df: DataFrame, keys: list[str], vec: str, defect: str, min_per_class: int = C.HEAD_PER_CLASS, max_error: float = C.HEAD_MAX_LOO_ERROR) -> DataFrame:
    """One head per group: unit mean vectors, margin m_hi from leave-one-out scores, error count, refusal.

    The class sums are vector aggregates with map-side combine; leaving one item out is the sum minus its own vector."""
    hot = hot_groups(df, keys)
    cell = df.groupBy(*keys, defect).agg(F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(array_to_vector(F.col(vec)))).alias("s"))
    d = F.col(defect) == 1
    head = cell.groupBy(*keys).agg(
        F.max(F.when(~d, F.col("n"))).alias("n_good"), F.max(F.when(d, F.col("n"))).alias("n_defect"),
        F.first(F.when(~d, F.col("s")), ignorenulls=True).alias("sg"), F.first(F.when(d, F.col("s")), ignorenulls=True).alias("sd"))
    head = head.withColumns({"n_good": F.coalesce("n_good", F.lit(0)), "n_defect": F.coalesce("n_defect", F.lit(0)), "mu_good": fn.unit("sg", 1e-12), "mu_defect": fn.unit("sd", 1e-12)})
    x = attach(df, head.where("sg is not null and sd is not null"), keys, hot)
    rest = lambda s: fn.unit(F.zip_with(s, F.col(vec), lambda a, b: a - b), 1e-12)
    score = F.when(F.col(defect) == 1, fn.dot(vec, rest(F.col("sd"))) - fn.dot(vec, "mu_good")).otherwise(fn.dot(vec, "mu_defect") - fn.dot(vec, rest(F.col("sg"))))
    loo = x.select(*keys, defect, score.alias("_s")).withColumns({"_a": F.abs("_s"), "_wrong": (F.col("_s") >= 0) != (F.col(defect) == 1)})
    med = exact_quantiles(loo, keys, "_a", {"med": 0.5}, hot=hot)
    err = loo.groupBy(*keys).agg(F.count_if("_wrong").alias("loo_errors"), F.count(F.lit(1)).alias("loo_n"), F.coalesce(F.max(F.when(F.col("_wrong"), F.col("_a"))), F.lit(0.0)).alias("worst"))
    out = head.drop("sg", "sd").join(err, keys, "left").join(med, keys, "left")
    refused = (F.when((F.col("n_good") < min_per_class) | (F.col("n_defect") < min_per_class), "too_few")
               .when(F.col("loo_errors") / F.col("loo_n") > max_error, "loo_errors").otherwise(""))
    return out.withColumns({"m_hi": F.greatest("worst", "med"), "refused": refused}).drop("worst", "med")


def proto_answer(df: DataFrame, heads: DataFrame, keys: list[str], vec: str, base_defect: Column) -> DataFrame:
    """Adds score, code and how: the head answers when it agrees with the base call or its margin is high."""
    x = df.join(heads.select(*keys, "mu_good", "mu_defect", "m_hi"), keys).withColumn("score", fn.dot(vec, "mu_defect") - fn.dot(vec, "mu_good"))
    local = (F.col("score") >= 0).cast("int")
    agree, high = local == base_defect.cast("int"), F.abs("score") >= F.col("m_hi")
    return x.withColumns({
        "how": F.when(agree, "agree").when(high, "high_margin").otherwise("none"),
        "code": F.when(agree | high, local).otherwise(C.UNSURE),
    }).drop("mu_good", "mu_defect", "m_hi")


def encode_vector(vec: Column) -> Column:
    """JSON text in base 64: the stored form of a head's vectors."""
    return F.base64(F.to_json(vec).cast("binary"))


def decode_vector(text: Column) -> Column:
    return F.from_json(F.unbase64(text).cast("string"), "array<double>")


def _newton(x: np.ndarray, y: np.ndarray, theta: np.ndarray, c: float, rounds: int = 50) -> np.ndarray:
    """Weights and bias (last, not shrunk) of a logistic fit with balanced class weights, from ``theta`` on."""
    n, ones = len(y), int(y.sum())
    s = c * np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    shrink = np.append(np.ones(x.shape[1] - 1), 0.0)
    sign = np.where(y == 1, -1.0, 1.0)
    loss = lambda t: 0.5 * (shrink * t * t).sum() + (s * np.logaddexp(0.0, sign * (x @ t))).sum()
    now = loss(theta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ theta)))
        grad = x.T @ (s * (p - y)) + shrink * theta
        if np.abs(grad).max() < 1e-11:
            break
        move = np.linalg.solve((x * (s * p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-12), grad)
        step = 1.0
        while loss(theta - step * move) > now and step > 1e-6:
            step /= 2
        theta = theta - step * move
        now = loss(theta)
    return theta


def logit_fit(df: DataFrame, keys: list[str], item: str, vec: str, defect: str, c: float = 1.0, min_per_class: int = C.HEAD_PER_CLASS,
              max_error: float = C.HEAD_MAX_LOO_ERROR, most: int = HEAD_ROWS) -> DataFrame:
    """One logistic head per group: weights, bias, leave-one-out margins (probability less a half) of its items by id, margin
    m_hi, error count, refusal.

    Every group is a task of its own: a Newton solution over all its items, then one more per left-out item, started from
    the whole solution, with class weights of the remaining items. An item that is the only one of its class has no margin.
    A head learns from the items that one user labelled; a group of more than ``most`` is no such thing, so it is named
    with the refusal 'too_many' and not gathered in a task. A group of one class has no head ('too_few')."""
    size = df.groupBy(*keys).agg(F.count_if(F.col(defect) == 0).alias("n_good"), F.count_if(F.col(defect) == 1).alias("n_defect"))
    fits = size.where(F.col("n_good") + F.col("n_defect") <= most).where("n_good > 0 and n_defect > 0").select(*keys)
    types = dict(df.dtypes)
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], f"weights array<double>, bias double, items array<{types[item]}>, margins array<double>"])

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item, kind="stable")
        x = np.column_stack([np.stack([np.asarray(v, float) for v in pdf["_vec"]]), np.ones(len(pdf))])
        y = pdf["_y"].to_numpy().astype(float)
        whole = _newton(x, y, np.zeros(x.shape[1]), c)
        margins = []
        for i in range(len(y)):
            rest = np.arange(len(y)) != i
            if y[rest].min(initial=1) == y[rest].max(initial=0):
                margins.append(None)
                continue
            z = x[i] @ _newton(x[rest], y[rest], whole, c)
            margins.append(float(1 / (1 + np.exp(-z)) - 0.5))
        return pd.DataFrame({**dict(zip(keys, ([k] for k in key))), "weights": [whole[:-1].tolist()], "bias": [float(whole[-1])], "items": [pdf[item].tolist()], "margins": [margins]})

    rows = df.where(F.col(defect).isin(0, 1)).join(fits, keys, "left_semi").select(*keys, item, F.col(vec).alias("_vec"), F.col(defect).cast("int").alias("_y"))
    rows = rows.where(F.col("_vec").isNotNull())
    heads = rows.groupBy(*keys).applyInPandas(solve, schema)
    loo = heads.join(rows.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(item, "_y"))).alias("_known")), keys)
    judged = F.filter(F.transform(F.arrays_zip("items", "margins"), lambda m: F.struct(m["margins"].alias("m"), ((m["margins"] >= 0) != (F.col("_known")[m["items"]] == 1)).alias("wrong"))), lambda m: m["m"].isNotNull())
    loo = loo.withColumn("_j", judged).drop("_known")
    size_of = lambda js: F.transform(js, lambda m: F.abs(m["m"]))
    ordered = F.array_sort(size_of(F.col("_j")))
    n = F.size("_j")
    median = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    worst = F.coalesce(F.array_max(size_of(F.filter("_j", lambda m: m["wrong"]))), F.lit(0.0))
    loo = loo.withColumns({"loo_errors": F.size(F.filter("_j", lambda m: m["wrong"])), "m_hi": F.greatest(worst, median), "_n": n}).drop("_j")
    out = size.join(loo, keys, "left")
    refused = (F.when(F.col("n_good") + F.col("n_defect") > most, "too_many").when((F.col("n_good") < min_per_class) | (F.col("n_defect") < min_per_class), "too_few")
               .when(F.col("loo_errors") > max_error * F.col("_n"), "loo_errors").otherwise(""))
    return out.withColumn("refused", refused).drop("_n")


def ml_baseline(train: DataFrame, features: list[str], label: str, kind: str):
    """Depth-2 tree or standardised logistic regression with balanced weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    n = train.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    x = train.join(n, label).withColumn("w", 1.0 / F.col("_n"))
    asm = VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip")
    if kind == "tree":
        stages = [asm, DecisionTreeClassifier(featuresCol="raw", labelCol=label, weightCol="w", maxDepth=2, seed=0)]
    else:
        stages = [asm, StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="w", maxIter=25)]
    return Pipeline(stages=stages).fit(x)
