"""Checks of tables, as one-row tables of counts of what is wrong; `require` raises if any is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError


def require(audit: DataFrame, error: type[Exception] = DataValidationError) -> None:
    wrong = {k: v for k, v in audit.first().asDict().items() if v}
    if wrong:
        raise error(str(wrong))


def labeled_frame(rows: DataFrame) -> DataFrame:
    """Nulls in prompt or response, labels that are not 0 or 1, labels that do not occur, and emptiness."""
    return rows.agg(
        F.count_if(F.col("prompt").isNull()).alias("null_prompts"), F.count_if(F.col("response").isNull()).alias("null_responses"),
        F.count_if(F.col("label").isNull() | ~F.col("label").isin(0, 1)).alias("bad_labels"),
        (2 - F.countDistinct(F.when(F.col("label").isin(0, 1), F.col("label")))).alias("missing_labels"), (F.count("*") == 0).cast("int").alias("empty"))


def probability_frame(rows: DataFrame, ids: DataFrame, key: str = "row_idx") -> DataFrame:
    """Values out of range, pairs that do not add up to 1, repeated ids, and ids missing or unknown, over all seeds."""
    p0, p1 = F.col("p0"), F.col("p1")
    bad = lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1)
    values = rows.agg(F.count_if(bad(p0) | bad(p1)).alias("out_of_range"), F.count_if(F.abs(p0 + p1 - 1.0) > 1e-9).alias("bad_sums"))
    repeats = rows.groupBy("seed", key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    want = rows.select("seed").distinct().crossJoin(ids.select(key).distinct())  # a few seeds
    missing = want.join(rows.select("seed", key).distinct(), ["seed", key], "left_anti").agg(F.count("*").alias("missing"))
    unknown = rows.join(ids.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("unknown"))
    return values.crossJoin(repeats).crossJoin(missing).crossJoin(unknown)  # one row each


def submission(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of `rows` (ordinal, id, label) against `wanted` (ordinal, id): other ids, other number of rows, bad labels."""
    both = wanted.select("ordinal", F.col("id").alias("_want"), F.lit(1).alias("_w")).join(rows.select("ordinal", "id", "label", F.lit(1).alias("_r")), "ordinal", "full")
    return both.agg(
        F.count_if(F.col("_w").isNull() | F.col("_r").isNull()).alias("unmatched"), F.count_if(F.col("_w").isNotNull() & F.col("_r").isNotNull() & ~F.col("_want").eqNullSafe(F.col("id"))).alias("other_ids"),
        F.count_if(F.col("_r").isNotNull() & (F.col("label").isNull() | ~F.col("label").isin(0, 1))).alias("bad_labels"))


def partition_statistics(rows: DataFrame, by: str, key: str) -> DataFrame:
    repeats = rows.groupBy(by, key).agg(F.count("*").alias("n"))
    repeats = repeats.groupBy(by).agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated_rows"))
    base = rows.groupBy(by).agg(F.count("*").alias("rows"), F.count_if(F.col("label") == 0).alias("label_0"), F.count_if(F.col("label") == 1).alias("label_1"), F.count_if(F.col("context").isNull()).alias("null_contexts"))
    return base.join(repeats, by)


def partition_overlaps(rows: DataFrame, by: str, key: str) -> DataFrame:
    """(a, b, n): keys that two partitions share. Keys in one partition only are dropped before any pair is made."""
    each = rows.select(by, key).distinct()
    parts = each.groupBy(key).agg(F.array_sort(F.collect_set(by)).alias("_p")).where(F.size("_p") > 1)
    pairs = parts.select(F.explode("_p").alias("a"), "_p").select("a", F.explode("_p").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def not_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))).alias(c) for c in columns])


TEST_COLUMNS = ("id", "context", "prompt_bn", "response_bn")


def test_frame(rows: DataFrame) -> DataFrame:
    """Of unlabelled rows: other columns or another order, ids missing or repeated, texts missing, and emptiness."""
    wrong = int(tuple(rows.columns) != TEST_COLUMNS)
    repeats = rows.groupBy("id").count().where("id IS NOT NULL AND count > 1").agg(F.count("*").alias("repeated_ids"))
    return rows.agg(
        F.lit(wrong).alias("wrong_columns"), F.count_if(F.col("id").isNull()).alias("null_ids"), F.count_if(F.col("prompt_bn").isNull()).alias("null_prompts"),
        F.count_if(F.col("response_bn").isNull()).alias("null_responses"), (F.count("*") == 0).cast("int").alias("empty")).crossJoin(repeats)  # one row each


def fold_assignments(folds: DataFrame, ids: DataFrame, seeds: tuple[int, ...], k: int, key: str = "row_idx") -> DataFrame:
    """Of (seed, fold, key, label, root): seeds missing or unknown, rows repeated, missing or unknown in a seed, folds that a seed lacks,
    folds with one label, and families in more than one fold of a seed."""
    by_seed = folds.groupBy("seed").agg(F.countDistinct("fold").alias("folds"))
    wanted = folds.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
    seeds_ = wanted.join(by_seed, "seed", "full").agg(F.count_if(F.col("folds").isNull()).alias("missing_seeds"), F.count_if(~F.col("seed").isin(*seeds)).alias("unknown_seeds"), F.sum(F.abs(F.lit(k) - F.coalesce("folds", F.lit(0)))).alias("other_folds"))
    repeats = folds.groupBy("seed", key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    want = folds.select("seed").distinct().crossJoin(ids.select(key).distinct())  # a few seeds
    missing = want.join(folds.select("seed", key).distinct(), ["seed", key], "left_anti").agg(F.count("*").alias("missing"))
    unknown = folds.join(ids.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("unknown"))
    labels = folds.groupBy("seed", "fold").agg(F.countDistinct("label").alias("n")).agg(F.count_if(F.col("n") < 2).alias("one_label_folds"))
    split = folds.groupBy("seed", "root").agg(F.countDistinct("fold").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_groups"))
    return seeds_.crossJoin(repeats).crossJoin(missing).crossJoin(unknown).crossJoin(labels).crossJoin(split)  # one row each


def partition_safety(rows: DataFrame, by: str, text_key: str, protected: str) -> DataFrame:
    """What must not be: texts of the partition `protected` in others, and texts with unlike labels, within a partition or across."""
    each = rows.groupBy(text_key).agg(F.max((F.col(by) == protected).cast("int")).alias("_in"), F.max((F.col(by) != protected).cast("int")).alias("_out"), F.countDistinct("label").alias("_labels"))
    return each.agg(F.count_if((F.col("_in") == 1) & (F.col("_out") == 1)).alias("shared_with_protected"), F.count_if(F.col("_labels") > 1).alias("conflicting_texts"))


def fold_artifact(rows: DataFrame, folds: DataFrame, key: str = "row_idx") -> DataFrame:
    """Of out-of-fold rows (seed, fold, key, label, p0, p1) against the folds (seed, fold, key, label): rows that the folds lack, rows
    missing, in another fold, or with another label, repeated keys and probabilities that are none."""
    a = rows.select("seed", key, F.col("fold").alias("_f"), F.col("label").alias("_l"), F.lit(1).alias("_a"))
    both = a.join(folds.select("seed", key, "fold", "label", F.lit(1).alias("_b")), ["seed", key], "full")
    here = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    out = both.agg(F.count_if(F.col("_b").isNull()).alias("unknown"), F.count_if(F.col("_a").isNull()).alias("missing"), F.count_if(here & (F.col("_f") != F.col("fold"))).alias("misplaced"), F.count_if(here & ~F.col("_l").eqNullSafe(F.col("label"))).alias("other_labels"))
    repeats = rows.groupBy("seed", key).count().where("count > 1").agg(F.count("*").alias("repeated"))
    bad = lambda p: F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    values = rows.agg(F.count_if(bad("p0") | bad("p1") | (F.abs(F.col("p0") + F.col("p1") - 1) > 1e-9)).alias("bad_probabilities"))
    return out.crossJoin(repeats).crossJoin(values)  # one row each
