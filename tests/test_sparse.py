"""Sparse weights and fits against plain Python and a dense Newton solver."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError
from evidentia.operators import sparse

own = random.Random(8)
WORDS = [f"w{k}" for k in range(30)] + ["a", "শহর", "b_c", "naïve", "It's"]
ROWS = [(k, " ".join(own.choice(WORDS[: 12 if k % 2 else 35]) for _ in range(own.randrange(1, 14))) if k % 9 else ("", None, " x ")[k % 3], own.random() * 3, float(k % 2 + own.random() < 1.2), own.randrange(2) if k % 4 else k % 2) for k in range(60)]
SMALL = {"word": sparse.Spec("word", 1, 2, min_df=2, top=25), "char": sparse.Spec("char_wb", 3, 5, min_df=2, top=70), "raw": sparse.Spec("char_wb", 2, 4, lower=True, sublinear=False)}


def grams(text, spec):
    text = (text or "").lower() if spec.lower else text or ""
    if spec.analyzer == "word":
        w = re.findall(r"\b\w+\b", text)
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    out = []
    for w in text.split():
        w = f" {w} "
        for n in range(spec.low, spec.high + 1):
            out += [w[i : i + n] for i in range(max(len(w) - n + 1, 1))]
            if len(w) <= n:
                break
    return out


def fitted(train, spec):
    df, total = Counter(), Counter()
    for t in train:
        c = Counter(grams(t, spec))
        df.update(c.keys())
        total.update(c)
    kept = sorted((t for t in df if df[t] >= spec.min_df), key=lambda t: (-total[t], t.encode()))[: spec.top]
    return {t: math.log((1 + len(train)) / (1 + df[t])) + 1 for t in kept}


def weighted(text, spec, idf):
    tf = Counter(grams(text, spec))
    x = {t: (1 + math.log(tf[t]) if spec.sublinear else tf[t]) * idf[t] for t in tf if t in idf}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {t: v / norm for t, v in x.items()}


def newton(x, y, c, penalized=True):
    """The exact optimum, by dense Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = c * np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    w, penalty = np.zeros(x.shape[1]), np.ones(x.shape[1])
    penalty[-1] = penalized
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(np.diag(penalty) + (x * (weight * p * (1 - p))[:, None]).T @ x, penalty * w + x.T @ (weight * (p - y)))
    return w


def dense(rows, train, blocks, numeric):
    """Matrices of the training rows and of all rows, and the names of the columns."""
    parts, names = [], []
    for b in blocks:
        idf = fitted([rows[i][1] for i in train], SMALL[b])
        order = sorted(idf)
        w = [weighted(r[1], SMALL[b], idf) for r in rows]
        parts.append(np.array([[x.get(t, 0.0) for t in order] for x in w]).reshape(len(rows), -1))
        names += [(b, t) for t in order]
    if numeric:
        n = np.array([[r[2], r[3]] for r in rows])
        sd = n[train].std(axis=0)
        parts.append((n - n[train].mean(axis=0)) / np.where(sd > 0, sd, 1))
    return np.hstack(parts), names


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "row_idx long, text string, n1 double, n2 double, label int").repartition(5)


@pytest.fixture(scope="module")
def scopes(spark):
    folds = spark.createDataFrame([(r[0], r[0] * 7 % 3) for r in ROWS], "row_idx long, fold int")
    return sparse.fold_scopes(folds)


def test_weights(rows, scopes):
    views = {b: F.col("text") for b in SMALL}
    terms = sparse.postings(rows, "row_idx", views, SMALL)
    vocabulary = sparse.vocabularies(terms, scopes, "row_idx", SMALL)
    idf, got = {}, {}
    for r in vocabulary.collect():
        idf.setdefault((r.scope, r.block), {})[r.term] = r.idf
    for r in sparse.tfidf(terms, vocabulary, "row_idx", SMALL).collect():
        got.setdefault((r.scope, r.row_idx, r.block), {})[r.term] = r.w
    for s in range(3):
        for b, spec in SMALL.items():
            want = fitted([r[1] for r in ROWS if r[0] * 7 % 3 != s], spec)
            assert idf[s, b] == pytest.approx(want)
            for r in ROWS:
                assert got.get((s, r[0], b), {}) == pytest.approx(weighted(r[1], spec, want))


MODELS = [(s, blocks, c, p) for s in range(3) for blocks, c, p in ((("word",), 1.0, True), (("char", "word"), 0.1, True), (("word", "char", "numeric"), 10.0, True), (("numeric",), 1.0, False))]


@pytest.mark.parametrize("weights", [sparse.WEIGHTS, 500])
def test_fit(rows, scopes, weights, monkeypatch):
    monkeypatch.setattr(sparse, "WEIGHTS", weights)
    packed, space = sparse.pack(rows, "row_idx", {b: F.col("text") for b in SMALL}, scopes, ["n1", "n2"], SMALL)
    fit = sparse.SparseFit(packed, "row_idx", space, [sparse.Model(s, b, c, p) for s, b, c, p in MODELS]).fit()
    got = {(r.row_idx, r.model): r.p for r in fit.predict().collect()}
    coefficients = {(r.model, r.block, r.term): r.weight for r in fit.coefficients().collect()}
    y = np.array([r[4] for r in ROWS])
    for m, (s, blocks, c, penalized) in enumerate(MODELS):
        train = [i for i, r in enumerate(ROWS) if r[0] * 7 % 3 != s]
        x, names = dense(ROWS, train, [b for b in blocks if b != "numeric"], "numeric" in blocks)
        w = newton(x[train], y[train], c, penalized)
        p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
        for i, r in enumerate(ROWS):
            assert ((r[0], m) in got) == (i not in train)
            if i not in train:
                assert got[r[0], m] == pytest.approx(p[i], abs=1e-6)
        for k, (b, t) in enumerate(names):
            assert coefficients[m, b, t] == pytest.approx(w[k], abs=1e-5)
    assert fit.passes < (150 if weights == sparse.WEIGHTS else 800)


def test_many_parts(rows, scopes, monkeypatch):
    """Partial gradients that tasks add give the same weights."""
    views = {"word": F.col("text")}
    packed, space = sparse.pack(rows, "row_idx", views, scopes, [], SMALL)
    models = [sparse.Model(s, ("word",)) for s in range(3)]
    one = sparse.SparseFit(packed, "row_idx", space, models).fit().weights
    monkeypatch.setattr(sparse, "PARTS", 2)
    many = sparse.SparseFit(packed.repartition(7), "row_idx", space, models).fit().weights
    assert np.abs(one - many).max() < 1e-6


def test_one_label(rows, scopes):
    with pytest.raises(DataValidationError):
        sparse.pack(rows.withColumn("label", F.lit(1)), "row_idx", {"word": F.col("text")}, scopes, [], SMALL)


@pytest.mark.parametrize("often", [0, 12, 4_096])
def test_gradients(rows, scopes, often, monkeypatch):
    """Steps by gradients give the weights of Newton steps, whichever terms are multiplied as a matrix, and need few passes."""
    packed, space = sparse.pack(rows, "row_idx", {b: F.col("text") for b in SMALL}, scopes, ["n1", "n2"], SMALL)
    models = [sparse.Model(s, b, c, p) for s, b, c, p in MODELS]
    one = sparse.SparseFit(packed, "row_idx", space, models).fit()
    monkeypatch.setattr(sparse, "SECOND", 0)
    monkeypatch.setattr(sparse, "OFTEN", often)
    many = sparse.SparseFit(packed, "row_idx", space, models).fit()
    assert np.abs(one.weights - many.weights).max() < 1e-5
    assert one.passes < 20 and many.passes < 150


@pytest.mark.parametrize("beside", [1, 2])
def test_scopes_in_turns(rows, scopes, beside, monkeypatch):
    """However many scopes are counted side by side, and wherever the list is cut, the terms are the same."""
    monkeypatch.setattr(sparse, "BESIDE", beside)
    specs = {"word": sparse.Spec("word", 1, 2, min_df=2, top=7), "char": sparse.Spec("char_wb", 3, 5, top=30)}
    terms = sparse.postings(rows, "row_idx", {b: F.col("text") for b in specs}, specs)
    got = {(r.scope, r.block, r.term): r.idf for r in sparse.vocabularies(terms, scopes, "row_idx", specs).collect()}
    want = {(s, b, t): v for s in range(3) for b, spec in specs.items() for t, v in fitted([r[1] for r in ROWS if r[0] * 7 % 3 != s], spec).items()}
    assert got == pytest.approx(want)


def test_weight_sums(rows, scopes):
    """Sums of weights are those of the weights themselves, and no shuffle has a row for each term."""
    terms = sparse.filed(sparse.postings(rows, "row_idx", {b: F.col("text") for b in SMALL}, SMALL))
    vocabulary = sparse.filed(sparse.vocabularies(terms, scopes, "row_idx", SMALL))
    want = sparse.tfidf(terms, vocabulary, "row_idx", SMALL).groupBy("scope", "row_idx", "block").agg(F.count("*").alias("terms"), F.sum("w").alias("total"), F.max("w").alias("largest"))
    sums = sparse.weight_sums(terms, vocabulary, "row_idx", SMALL)
    assert {r[:3]: pytest.approx(r[3:]) for r in want.collect()} == {r[:3]: r[3:] for r in sums.collect()}
    assert "Window" not in sums._jdf.queryExecution().executedPlan().toString()


def test_alike_numbers(spark, scopes, monkeypatch):
    """Numbers that say nearly the same, with few large ones, take few passes; weights are those of dense Newton steps."""
    many = [(*r[:2], *[r[2] ** k + own.random() * 1e-3 for k in range(1, 9)], r[4]) for r in ROWS]
    names = [f"n{k}" for k in range(1, 9)]
    rows = spark.createDataFrame(many, "row_idx long, text string, " + ", ".join(f"{c} double" for c in names) + ", label int").repartition(5)
    packed, space = sparse.pack(rows, "row_idx", {"word": F.col("text")}, scopes, names, SMALL)
    models = [sparse.Model(s, ("word", "numeric"), 1000.0) for s in range(3)]
    want = sparse.SparseFit(packed, "row_idx", space, models).fit().weights
    monkeypatch.setattr(sparse, "SECOND", 0)
    fit = sparse.SparseFit(packed, "row_idx", space, models).fit()
    assert np.abs(fit.weights - want).max() < 1e-5 * max(1, np.abs(want).max())
    assert fit.passes < 200
