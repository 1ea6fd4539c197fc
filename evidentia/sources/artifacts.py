"""Sets of tables that are committed at once and verified when they are opened."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError
from evidentia.operators import audits, metrics

#: How far metrics that are computed again, or predictions of a model that is read again, may be off.
TOLERANCE = 1e-12
METRICS = ("macro_f1", "f1_label0", "f1_label1", "accuracy", "brier")


def content_digest(table: DataFrame) -> DataFrame:
    """(rows, digest), one row: a digest of the rows as a multiset, whatever their order and parts. Sums of the rows' own digests, in
    four parts of 60 bits, are exact and need no row to meet another."""
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = table.select(row.alias("_h"))
    part = lambda k: F.sum(F.conv(F.substring("_h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)"))
    sums = hashed.agg(F.count("*").alias("rows"), *[F.coalesce(part(k), F.lit(0)).cast("string").alias(f"_{k}") for k in range(4)])
    return sums.select("rows", F.sha2(F.concat_ws("-", F.col("rows").cast("string"), *[f"_{k}" for k in range(4)]), 256).alias("digest"))


def commit(tables: dict[str, DataFrame], path: str, facts: dict | None = None) -> "Artifacts":
    """Writes each table below `path`, then a manifest of their digests, as they are read again, with `facts`. The manifest is what
    makes the set: a run that ends before it leaves none, and `open_set` refuses what is there. A path in use is an error."""
    spark, entries = next(iter(tables.values())).sparkSession, []
    for name, table in tables.items():
        table.write.mode("error").parquet(f"{path}/tables/{name}")
        written = spark.read.parquet(f"{path}/tables/{name}")
        rows, digest = content_digest(written).first()
        entries.append((name, rows, digest, written.schema.json()))
    manifest = spark.createDataFrame([(*e, json.dumps(facts or {}, sort_keys=True)) for e in entries], "name string, rows long, digest string, schema string, facts string")
    manifest.coalesce(1).write.mode("error").json(f"{path}/manifest")
    return open_set(spark, path)


@dataclass
class Artifacts:
    """The tables of a set, by name, and its facts."""

    tables: dict[str, DataFrame]
    facts: dict


def open_set(spark: SparkSession, path: str) -> Artifacts:
    """The set at `path`; raises if it has no manifest, or if a table is missing or is not what was committed."""
    try:
        entries = spark.read.schema("name string, rows long, digest string, schema string, facts string").json(f"{path}/manifest").collect()  # a row for each table
    except AnalysisException as e:
        raise DataValidationError(f"no manifest at {path}") from e
    out, facts = {}, {}
    for e in entries:
        try:
            table = spark.read.parquet(f"{path}/tables/{e['name']}")
        except AnalysisException as error:
            raise DataValidationError(f"{e['name']} is missing") from error
        if table.schema.json() != e["schema"] or tuple(content_digest(table).first()) != (e["rows"], e["digest"]):
            raise DataValidationError(f"{e['name']} is not what was committed")
        out[e["name"]], facts = table, json.loads(e["facts"])
    return Artifacts(out, facts)


def commit_experiment(name: str, oof: DataFrame, path: str, extra: dict[str, DataFrame] | None = None) -> Artifacts:
    """Out-of-fold rows (seed, fold, row_idx, label, p0, p1) with the metrics that they give, and other tables, as one set."""
    record = metrics.metric_record(oof.withColumn("p", F.col("p1")))
    return commit({"oof": oof, "metrics": record, **(extra or {})}, path, {"experiment": name})


def verify_experiment(found: Artifacts, folds: DataFrame) -> DataFrame:
    """(experiment, oof_rows, macro_f1, brier), one row; raises unless the out-of-fold rows are exactly those of the folds, give the stored
    metrics again, and the rows that a stack learns from (table `stack`: seed, target_fold, row_idx), if any, are those outside each
    target fold."""
    oof = found.tables["oof"]
    audits.require(audits.fold_artifact(oof, folds))
    again, stored = metrics.metric_record(oof.withColumn("p", F.col("p1"))).first(), found.tables["metrics"].first()
    for m in METRICS:
        if abs(again[m] - stored[m]) > TOLERANCE:
            raise DataValidationError(f"{m} is {again[m]}, stored as {stored[m]}")
    if "stack" in found.tables:
        audits.require(stack_rows(found.tables["stack"], folds))
    return oof.sparkSession.createDataFrame([(found.facts["experiment"], oof.count(), again["macro_f1"], again["brier"])], "experiment string, oof_rows long, macro_f1 double, brier double")


def stack_rows(stack: DataFrame, folds: DataFrame) -> DataFrame:
    """Of rows (seed, target_fold, row_idx) that a stack learns from: those of the target fold itself, repeats, and rows missing."""
    targets = folds.select("seed", F.col("fold").alias("target_fold")).distinct()
    want = folds.join(targets, "seed").where("fold != target_fold").select("seed", "target_fold", "row_idx")
    keys = ["seed", "target_fold", "row_idx"]
    outside = stack.join(want, keys, "left_anti").agg(F.count("*").alias("leaked"))
    repeats = stack.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("repeated"))
    missing = want.join(stack.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("missing"))
    return outside.crossJoin(repeats).crossJoin(missing)  # one row each
