"""Logistic heads against plain gradient descent."""

import numpy as np
import pytest

from lotwise.operators import localhead as H


def plain_fit(x, y, rounds=20000):
    n, ones = len(y), y.sum()
    s = np.where(y == 1, n / (2 * ones), n / (2 * (n - ones)))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = s * (p - y)
        w, b = w - 0.05 * (x.T @ g + w), b - 0.05 * g.sum()
    return w, b


def test_logit_fit(spark):
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g, n in (("a", 24), ("b", 31)):
        x = rng.normal(size=(n, 3))
        y = ((x[:, 0] + rng.normal(0, 1.0, n)) > 0.4).astype(int)
        rows += [(g, i, [float(v) for v in x[i]], int(y[i])) for i in range(n)]
        loo = []
        for i in range(n):
            m = np.arange(n) != i
            w, b = plain_fit(x[m], y[m], 3000)
            loo.append(1 / (1 + np.exp(-(x[i] @ w + b))) - 0.5)
        loo = np.array(loo)
        wrong = (loo >= 0).astype(int) != y
        want[g] = (*plain_fit(x, y, 3000), loo, max(np.abs(loo[wrong]).max(initial=0.0), np.median(np.abs(loo))), int(wrong.sum()))
    rows += [("one", 1, [1.0, 0.0, 0.0], 1), ("one", 2, [0.5, 0.0, 0.0], 1), ("two", 1, [1.0, 0.0, 0.0], 1), ("two", 2, [0.5, 0.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>, d int")
    got = {r.g: r for r in H.logit_fit(df, ["g"], "id", "v", "d").collect()}
    for g, (w, b, loo, m_hi, errors) in want.items():
        r = got[g]
        assert r.weights == pytest.approx(w.tolist(), abs=1e-6) and r.bias == pytest.approx(b, abs=1e-6)
        assert r["items"] == list(range(len(loo))) and r.margins == pytest.approx(loo.tolist(), abs=1e-6)
        assert r.m_hi == pytest.approx(m_hi, abs=1e-6) and r.loo_errors == errors
    assert got["one"].refused == "too_few" and got["one"].weights is None
    assert got["two"].refused == "too_few" and got["two"].margins == [None, None]
    few = {r.g: r.refused for r in H.logit_fit(df, ["g"], "id", "v", "d", most=30).collect()}
    assert few["b"] == "too_many" and few["a"] != "too_many"
