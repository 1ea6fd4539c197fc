"""Artifact sets and discovery on trees of copies."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError, DiscoveryError
from evidentia.operators import sparse
from evidentia.sources import artifacts, discovery
from tests.test_sparse import MODELS, ROWS, SMALL

FOLDS = [(s, k % 3, k, k // 2 % 2) for s in (1, 2) for k in range(24)]


@pytest.fixture
def folds(spark):
    return spark.createDataFrame(FOLDS, "seed int, fold int, row_idx long, label int")


@pytest.fixture
def oof(folds):
    return folds.withColumn("p1", (F.col("row_idx") % 7) / 7.0).withColumn("p0", 1 - F.col("p1"))


def test_digest_of_a_multiset(spark, folds):
    a = artifacts.content_digest(folds).first()
    assert artifacts.content_digest(folds.repartition(5).select("label", "row_idx", "fold", "seed")).first() == a
    assert artifacts.content_digest(folds.union(folds.limit(1))).first() != a
    assert artifacts.content_digest(folds.withColumn("label", F.when(F.col("row_idx") != 3, F.col("label")))).first().digest != a.digest
    assert artifacts.content_digest(folds.where("false")).first().rows == 0


def test_experiment(spark, folds, oof, tmp_path):
    stack = folds.join(spark.range(3).select(F.col("id").cast("int").alias("target_fold"))).where("fold != target_fold").select("seed", "target_fold", "row_idx")
    found = artifacts.commit_experiment("e9", oof, f"{tmp_path}/a", {"stack": stack})
    got = artifacts.verify_experiment(found, folds).first()
    assert (got.experiment, got.oof_rows) == ("e9", 48)
    for k, (bad, extra) in enumerate([
        (oof.where("row_idx != 5"), {}), (oof.withColumn("fold", (F.col("fold") + 1) % 3), {}), (oof.withColumn("p0", F.lit(0.3)), {}), (oof.withColumn("label", 1 - F.col("label")), {}),
        (oof, {"stack": stack.where("row_idx != 4")}), (oof, {"stack": stack.union(stack.limit(1))}), (oof, {"stack": folds.select("seed", F.col("fold").alias("target_fold"), "row_idx")}),
    ]):
        with pytest.raises(DataValidationError):
            artifacts.verify_experiment(artifacts.commit_experiment("bad", bad, f"{tmp_path}/bad{k}", extra), folds)
    other = artifacts.Artifacts({**found.tables, "metrics": found.tables["metrics"].withColumn("brier", F.col("brier") + 1e-9)}, found.facts)
    with pytest.raises(DataValidationError, match="brier"):
        artifacts.verify_experiment(other, folds)


def test_torn_writes(spark, oof, tmp_path):
    artifacts.commit({"one": oof, "two": oof.limit(3)}, f"{tmp_path}/set", {"n": 1})
    assert artifacts.open_set(spark, f"{tmp_path}/set").facts == {"n": 1}
    with pytest.raises(Exception, match="exist"):
        artifacts.commit({"one": oof}, f"{tmp_path}/set")
    for name, spoil in {
        "no manifest": lambda p: shutil.move(p / "manifest", p / "gone"), "no table": lambda p: shutil.move(p / "tables/two", p / "gone"),
        "other rows": lambda p: (shutil.move(p / "tables/one", p / "gone"), spark.read.parquet(f"{p}/gone").limit(5).write.parquet(f"{p}/tables/one")),
        "other kind": lambda p: (shutil.move(p / "tables/two", p / "gone"), spark.read.parquet(f"{p}/gone").withColumn("label", F.col("label").cast("long")).write.parquet(f"{p}/tables/two")),
    }.items():
        copy = Path(shutil.copytree(f"{tmp_path}/set", f"{tmp_path}/{name}"))
        spoil(copy)
        with pytest.raises(DataValidationError):
            artifacts.open_set(spark, str(copy))


def test_reload(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, "row_idx long, text string, n1 double, n2 double, label int")
    scopes = sparse.fold_scopes(spark.createDataFrame([(r[0], r[0] * 7 % 3) for r in ROWS], "row_idx long, fold int"))
    for name, views, numeric in (("text", {b: F.col("text") for b in SMALL}, ["n1", "n2"]), ("numbers", {}, ["n1", "n2"])):
        packed, space = sparse.pack(rows, "row_idx", views, scopes, numeric, SMALL)
        models = [sparse.Model(s, b, c, p) for s, b, c, p in MODELS if name == "text" or b == ("numeric",)]
        fit = sparse.SparseFit(packed, "row_idx", space, models).fit()
        sparse.save(fit, f"{tmp_path}/{name}")
        again = sparse.load(packed, "row_idx", f"{tmp_path}/{name}")
        both = fit.predict().join(again.predict().withColumnRenamed("p", "q"), ["row_idx", "model"])
        assert both.count() == fit.predict().count() and both.where(F.abs(F.col("p") - F.col("q")) > artifacts.TOLERANCE).isEmpty()
        assert again.models == fit.models


NAMES = ("train.json", "valid.json", "all.json", "official.json", "test.csv")


def put(root, **files):
    for name, text in files.items():
        path = root / name.replace("__", "/").replace("_dot_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def public(root, folder, text="x"):
    for n in NAMES[:3]:
        (root / folder).mkdir(parents=True, exist_ok=True)
        (root / folder / n).write_text(text + n)


def official(root, folder, text="o", sample="sample_submission.csv"):
    (root / folder).mkdir(parents=True, exist_ok=True)
    for n in (*NAMES[3:], sample):
        (root / folder / n).write_text(text + ("sample" if n == sample else n))


def test_roles(spark, tmp_path):
    for folder in ("b/public", "a/deep/public"):
        public(tmp_path, folder)
    official(tmp_path, "z/comp")
    official(tmp_path, "c/comp", sample=discovery.SAMPLE_NAMES[0])
    official(tmp_path, "b/public/inner", text="other")  # below a public folder: never taken
    official(tmp_path, "b/publicly", text="o")  # only its name begins alike
    found = discovery.roles(spark, str(tmp_path), *NAMES)
    assert found.public_train.endswith("/a/deep/public/train.json") and found.test.endswith("/c/comp/test.csv") and found.sample.endswith(f"/c/comp/{discovery.SAMPLE_NAMES[0]}")
    public(tmp_path, "d/public", "unlike")
    with pytest.raises(DiscoveryError):
        discovery.roles(spark, str(tmp_path), *NAMES)


def test_unlike_competitions(spark, tmp_path):
    public(tmp_path, "public")
    with pytest.raises(DiscoveryError):
        discovery.roles(spark, str(tmp_path), *NAMES)
    official(tmp_path, "a")
    assert discovery.roles(spark, str(tmp_path), *NAMES).official.endswith("/a/official.json")
    official(tmp_path, "b", "unlike")
    with pytest.raises(DiscoveryError):
        discovery.roles(spark, str(tmp_path), *NAMES)


def corpus_at(root, folder, text="c", sections=discovery.SECTIONS, n=2):
    for s in sections:
        for k in range(n):
            path = root / folder / s
            path.mkdir(parents=True, exist_ok=True)
            (path / f"wiki_{k:02d}").write_text(f"{text}{s}{k}")


def test_corpus(spark, tmp_path):
    corpus_at(tmp_path, "x/y/deep")
    corpus_at(tmp_path, "x/flat")
    corpus_at(tmp_path, "half", sections=("AA", "AB", "AC"), n=9)
    (tmp_path / "x/flat/AA/readme.txt").write_text("not a part")
    root, parts = discovery.corpus(spark, str(tmp_path), least=8)
    assert root.endswith("/x/flat") and parts.count() == 8
    files = discovery.listing(spark, str(tmp_path))
    deep = root.replace("x/flat", "x/y/deep")
    assert discovery.tree_digest(files.where("name != 'readme.txt'"), root) == discovery.tree_digest(files, deep) != discovery.tree_digest(files, root)
    with pytest.raises(DiscoveryError):
        discovery.corpus(spark, str(tmp_path), least=9)
    (tmp_path / "x/y/deep/AD/wiki_01").write_text("changed")
    with pytest.raises(DiscoveryError):
        discovery.corpus(spark, str(tmp_path), least=8)
