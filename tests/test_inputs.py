"""Examples, layouts, token budgets and checks of tables, on small cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError
from evidentia.functions import text as X
from evidentia.functions import tokens as T
from evidentia.operators import audits, exemplars

own = random.Random(2)
ROWS = [(k, bool(k % 2), k // 2 % 2, own.choice([5, 7, 7, 9, 20, 33])) for k in range(60)] + [(99, False, 1, 7)]


def test_exemplars(spark):
    rows = spark.createDataFrame(ROWS, "row_idx long, present boolean, label int, text_length int").repartition(5)
    want = {}
    for kind in exemplars.KINDS:
        part = [r for r in ROWS if (r[1], r[2]) == kind]
        lengths = sorted(r[3] for r in part)
        n = len(lengths)
        median = (lengths[(n - 1) // 2] + lengths[n // 2]) / 2
        want[kind] = [r[0] for r in sorted(part, key=lambda r: (abs(r[3] - median), r[3], r[0]))[:8]]
    pool = exemplars.pool(rows)
    got = {}
    for r in sorted(pool.collect(), key=lambda r: r["rank"]):
        got.setdefault((r.present, r.label), []).append(r.row_idx)
    assert got == want
    shown = {}
    for r in exemplars.shown(rows, pool).collect():
        shown.setdefault(r.row_idx, {})[r["at"]] = r.example
    for k, *_ in ROWS:
        assert shown[k] == {i: next(x for x in want[kind] if x != k) for i, kind in enumerate(exemplars.KINDS)}
    few = spark.createDataFrame([(1, True, 1, 4)], "row_idx long, present boolean, label int, text_length int")
    assert exemplars.shown(few, exemplars.pool(few)).count() == 0  # its only example would be itself
    blocks = rows.select("row_idx", F.concat(F.lit("b"), F.col("row_idx").cast("string")).alias("block"))
    texts = {r.row_idx: r.examples for r in exemplars.prompts(blocks, exemplars.shown(rows, pool)).collect()}
    assert texts == {k: "\n\n".join(f"b{shown[k][i]}" for i in range(4)) for k in shown}


def words(t):
    return re.findall(r"\w+", t)


def cut(xs, limit):
    if limit <= 0:
        return []
    if len(xs) <= limit:
        return xs
    head = round(limit * 0.5)
    return xs[:head] + xs[len(xs) - (limit - head) :]


BUDGETS = [(p, c, r, present) for p in ("", "q " * 5, "q1 " * 200) for r in ("", "r " * 300) for c, present in (("", False), ("c " * 3, True), ("c9 d8 " * 400, True), ("hidden " * 9, False))]


@pytest.mark.parametrize("layout", ["compatible", "structured", "routed"])
@pytest.mark.parametrize("maximum, prompt, response", [(256, 80, 96), (41, 7, 9)])
def test_budget(spark, layout, maximum, prompt, response):
    rows = spark.createDataFrame([(k, *b) for k, b in enumerate(BUDGETS)], "k int, p string, c string, r string, present boolean")
    x = X.field_budget(F.col("p"), F.col("c"), F.col("r"), F.col("present"), layout, T.tokens, maximum, prompt, response)
    got = {r.k: r.x for r in rows.select("k", x.alias("x")).collect()}
    for k, (p, c, r, present) in enumerate(BUDGETS):
        before = {
            "compatible": (["PROMPT"], ["CONTEXT", "PRESENT", str(int(present)), "CONTEXT"], ["RESPONSE"]),
            "structured": (["QUESTION"], ["CONTEXT"] + ["NULL"] * (not present), ["ANSWER"]),
            "routed": (["QUESTION"], ["EVIDENCE"] * present, ["CLAIM"]),
        }[layout]
        kp, kr = cut(words(p), prompt), cut(words(r), response)
        kc = cut(words(c) if present else [], maximum - 3 - sum(map(len, before)) - len(kp) - len(kr))
        assert got[k].a == before[0] + kp + before[1] + kc and got[k].b == before[2] + kr
        assert len(got[k].a) + len(got[k].b) + 3 <= maximum
        assert (got[k].context_original, got[k].context_retained) == (len(words(c)) if present else 0, len(kc))
    with pytest.raises(Exception, match="do not fit"):
        rows.select(X.field_budget(F.col("p"), F.col("c"), F.col("r"), F.col("present"), layout, T.tokens, 20, 80, 96)).collect()


def test_layouts(spark):
    rows = spark.createDataFrame([("p", "c", "r", True), ("p", "c", "r", False)], "p string, c string, r string, present boolean")
    parts = lambda layout: [tuple(r.x) for r in rows.select(X.prepared(F.col("p"), F.col("c"), F.col("r"), F.col("present"), layout).alias("x")).collect()]
    assert parts("structured") == [("[QUESTION]\np\n\n[CONTEXT]\nc", "[ANSWER]\nr"), ("[QUESTION]\np\n\n[CONTEXT]\n[NULL]", "[ANSWER]\nr")]
    assert parts("routed") == [("[QUESTION]\np\n\n[EVIDENCE]\nc", "[CLAIM]\nr"), ("[QUESTION]\np", "[CLAIM]\nr")]
    assert parts("compatible")[1] == ("[PROMPT]\np\n\n[CONTEXT_PRESENT]\n0\n\n[CONTEXT]\n", "[RESPONSE]\nr")
    for f in (X.prepared, X.markers):
        with pytest.raises(ValueError):
            f(*[F.col("p")] * (4 if f is X.prepared else 1), "other")


def test_composition(spark):
    rows = [("abc",), ("é",), (None,), ("",), ("é x",)]
    assert [r.x for r in spark.createDataFrame(rows, "t string").coalesce(1).select(X.nfc(F.col("t")).alias("x")).collect()] == ["abc", "é", None, "", "é x"]


def one(df):
    return df.first().asDict()


def test_test_frame(spark):
    kind = "id long, context string, prompt_bn string, response_bn string"
    good = spark.createDataFrame([(1, None, "p", "r"), (2, "c", "p", "r")], kind)
    audits.require(audits.test_frame(good))
    bad = spark.createDataFrame([(1, None, None, "r"), (1, "c", "p", None), (None, "c", "p", "r")], kind)
    assert one(audits.test_frame(bad)) == {"wrong_columns": 0, "null_ids": 1, "null_prompts": 1, "null_responses": 1, "empty": 0, "repeated_ids": 1}
    for other in (good.select("context", "id", "prompt_bn", "response_bn"), good.where("false"), bad):
        with pytest.raises(DataValidationError):
            audits.require(audits.test_frame(other))


def test_fold_assignments(spark):
    good = [(s, k % 3, k, k % 2, k) for s in (1, 2) for k in range(12)]
    kind = "seed int, fold int, row_idx long, label int, root long"
    ids = spark.createDataFrame([(k,) for k in range(12)], "row_idx long")
    audits.require(audits.fold_assignments(spark.createDataFrame(good, kind), ids, (1, 2), 3))
    spoiled = [r for r in good if not (r[0] == 2 and r[1] == 2)] + [(1, 0, 2, 0, 2), (3, 0, 50, 1, 50)]
    found = one(audits.fold_assignments(spark.createDataFrame(spoiled, kind), ids, (1, 2, 4), 3))
    assert found == {"missing_seeds": 1, "unknown_seeds": 1, "other_folds": 1 + 2 + 3, "repeated": 1, "missing": 4 + 12, "unknown": 1, "one_label_folds": 1, "split_groups": 1}


def test_partition_safety(spark):
    rows = [("a", "x", 1), ("official", "x", 1), ("b", "y", 1), ("b", "y", 0), ("official", "z", 1)]
    assert one(audits.partition_safety(spark.createDataFrame(rows, "part string, t string, label int"), "part", "t", "official")) == {"shared_with_protected": 1, "conflicting_texts": 1}


def test_fold_artifact(spark):
    folds = spark.createDataFrame([(1, k % 2, k, 1) for k in range(5)], "seed int, fold int, row_idx long, label int")
    good = folds.withColumns({"p0": F.lit(0.25), "p1": F.lit(0.75)})
    audits.require(audits.fold_artifact(good, folds))
    rows = [(1, 1, 0, 1, 0.5, 0.5), (1, 1, 1, 0, 0.5, 0.5), (1, 0, 2, 1, 0.5, 0.6), (1, 0, 2, 1, math.nan, 1.0), (1, 0, 9, 1, 0.0, 1.0)]
    found = one(audits.fold_artifact(spark.createDataFrame(rows, good.schema), folds))
    assert found == {"unknown": 1, "missing": 2, "misplaced": 1, "other_labels": 1, "repeated": 1, "bad_probabilities": 2}


def test_not_finite(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (math.nan, 1.0), (math.inf, None)], "a double, b double")
    assert one(audits.not_finite(rows, ["a", "b"])) == {"a": 2, "b": 1}
