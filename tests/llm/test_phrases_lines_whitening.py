"""The phrase search, the line field and the whitening, each against a plain version of its definition."""

import math
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest

from lotwise.llm import line_labels, phrases, whitening


def plain_phrases(rows, least, top):
    """Rows of (lang, text); counts everything, then applies the rules one after the other."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in (1, 2, 3):
                for i in range(len(w) - size + 1):
                    f[lang][tuple(w[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            longer = [b for q, b in cand.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 50 * a for b in longer):
                kept.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(2, 25), (3, 2000)])
def test_phrases(spark, odd_docs, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "LEAST", least)
    monkeypatch.setattr(phrases, "HELD_WORDS", 3000)
    docs = odd_docs.where("doc_id % 4 = 0 or doc_id >= 9000000").selectExpr("*", "1 AS a", "2 AS rank", "3 AS phrase").drop("lang", "score")
    docs = docs.selectExpr("*", "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'und' ELSE 'en' END AS lang")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0"))
    want = plain_phrases([(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()], least, top)
    assert sorted(map(tuple, phrases.phrases(docs, top).collect())) == want


def test_phrases_later_rounds(spark, monkeypatch):
    """Pairs at the top all lie in triples, so the first frontier doesn't settle and the next is taken."""
    monkeypatch.setattr(phrases, "LEAST", 2)
    rows = [("en", f"q{i} r{i} s{i}") for i in range(30) for _ in range(3)] + [("en", f"u{i} v{i}") for i in range(40) for _ in range(2)] + [("en", f"u{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    for top in (35, 60, 2000):
        assert sorted(map(tuple, phrases.phrases(docs, top).collect())) == plain_phrases(rows, 2, top)


def test_phrases_of_no_rows_and_large_counts(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert phrases.phrases(docs).count() == 0
    big = spark.createDataFrame([(9 * 10**12 + 7, 9 * 10**12 + 8, 9 * 10**12 + 9)], "a long, l long, r long")
    a, l, r = big.first()
    assert big.select(phrases.score("a", "l", "r")).first()[0] == 1000000 * a * a // (l * r)


def plain_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_line_rules(spark, odd_docs):
    more = spark.createDataFrame([(None, "a b c d e a b c d e\nx\nx\r\nx"), (None, None), (7, "one two " * 30)], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more).selectExpr("*", "1 AS id", "2 AS n_words", "true AS kept")
    field = line_labels.Field(np.zeros((2, len(line_labels.FEATURES))), np.zeros(2), np.zeros((2, 2)))
    got = line_labels.judge(docs, field).drop("content_words", "kept").collect()
    want = [(r["doc_id"], *plain_rules(r["text"])) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = {r["kept"] == (not r["base_failed"]) for r in line_labels.judge(docs, field).collect()}
    assert kept == {True}  # without weights every line is content
    assert line_labels.judge(docs.limit(0), field).count() == 0


def test_field_against_all_paths():
    rng = np.random.default_rng(3)
    field = line_labels.Field(rng.normal(size=(2, 4)), rng.normal(size=2), rng.normal(size=(2, 2)))
    lengths = np.array([3, 0, 5, 1])
    x, labels = rng.normal(size=(9, 4)), rng.integers(0, 2, 9)
    emit, best, value, at = x @ field.emit.T, [], 0.0, 0
    for n in lengths:
        if n:
            e = emit[at : at + n]
            total = lambda p: field.start[p[0]] + sum(e[i, p[i]] for i in range(n)) + sum(field.move[p[i], p[i + 1]] for i in range(n - 1))
            paths = {p: total(p) for p in product((0, 1), repeat=int(n))}
            best += max(paths, key=paths.get)
            value += paths[tuple(labels[at : at + n])] - math.log(sum(map(math.exp, paths.values())))
        at += n
    assert line_labels.viterbi(field, x, lengths).tolist() == best
    some = lengths[lengths > 0]
    got, grads = line_labels.likelihood(field, x, some, labels)
    assert got == pytest.approx(value)
    for name, g in zip(("emit", "start", "move"), grads):
        w = getattr(field, name)
        for i in np.ndindex(w.shape):
            w[i] += 1e-6
            up = line_labels.likelihood(field, x, some, labels)[0]
            w[i] -= 2e-6
            down = line_labels.likelihood(field, x, some, labels)[0]
            w[i] += 1e-6
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_line_field_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.unionByName(labels.limit(3)).unionByName(labels.selectExpr("cast(null AS long) AS doc_id", "0 AS quality", "0 AS toxic").limit(2))
    rows = line_labels.keep_content(docs, labels.dropDuplicates()).join(labels.dropDuplicates(["doc_id"]), "doc_id").where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 and not base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert good and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)
    none = line_labels.keep_content(docs, labels.limit(0)).where("kept = base_failed").count()
    assert none == 0


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, component int, whitened double")
    return whitening.whiten(df, **kw).collect()


@pytest.mark.parametrize("dims, n", [(5, 40), (20, 300)])
def test_whitening(spark, dims, n):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(n, dims)) * np.linspace(2, 0.5, dims) + 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (None, x[1].tolist())]
    odd = [(900, None), (901, [1.0] * (dims - 1) + [float("nan")]), (902, [None] * dims), (903, [1.0]), (904, []), (905, [float("inf")] * dims)]
    got = whitened(spark, rows + odd)
    k = min(dims, 16)
    assert len(got) == (n + 2) * k
    whole = np.floor(64 * x) + 1000000
    fit = np.unique(whole, axis=0)
    cov = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / len(fit)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    ref = (whole - fit.mean(0)) @ v / np.sqrt(e)
    by = {(r["vec_id"], r["component"]): r for r in got}
    mine = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in range(n)])
    assert np.abs(mine - ref * np.sign((mine * ref).sum(0))).max() < 1e-8
    sums = [int(s) for s in fit.sum(0)]
    for i in range(0, n, 7):
        assert by[i, 1]["deviation"] == sum((len(fit) * int(a) - s) ** 2 for a, s in zip(whole[i], sums))
    assert [by[3, c + 1]["explained"] for c in range(k)] == pytest.approx((e / np.trace(cov)).tolist(), rel=1e-9)
    assert {r["n"] for r in got} == {len(fit)} and all(r["identity_error"] < 1e-9 for r in got)


def test_whitening_without_spread(spark):
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    flat = whitened(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [1.0, 2.0])])  # one direction only, three rows
    assert [(r["component"], abs(round(r["whitened"], 9)), r["explained"]) for r in flat] == [(1, 1.0, pytest.approx(1.0))] * 3
    huge = whitened(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])
    assert len(huge) == 3 and all(r["deviation"] is None for r in huge if r["vec_id"] < 3)  # the second direction is under 1e-12


def test_whitening_repeated_eigenvalues(spark):
    rows = [(i, [float(s if j == d else 0) for j in range(6)]) for i, (d, s) in enumerate(product(range(6), (-1, 1)))]
    got = whitened(spark, rows)
    assert len(got) == 12 * 6 and all(r["identity_error"] < 1e-9 for r in got)
    many = whitened(spark, rows, steps=3)
    assert len(many) == 12 * 3 or len(many) == 12
