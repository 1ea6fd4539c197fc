"""Classification metrics, threshold sweeps and selections over (label, p) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _f1(hit: str, *misses: str) -> Column:
    return F.coalesce(F.try_divide(2.0 * F.col(hit), 2.0 * F.col(hit) + sum(F.col(m) for m in misses)), F.lit(0.0))


def classification_metrics(rows: DataFrame, by: list[str] = [], label: str = "label", prediction: str = "prediction") -> DataFrame:  # noqa: B006
    """One row a group: the four counts, both F1s (0 when undefined), their mean, and accuracy. One partial aggregation."""
    t, p = F.col(label), F.col(prediction)
    cells = rows.groupBy(*by).agg(*[F.count_if((t == a) & (p == b)).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    out = cells.withColumns({"f1_label0": _f1("tn", "fp", "fn"), "f1_label1": _f1("tp", "fp", "fn")})
    accuracy = F.try_divide((F.col("tn") + F.col("tp")).cast("double"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("double"))
    return out.withColumns({"macro_f1": (F.col("f1_label0") + F.col("f1_label1")) / 2.0, "accuracy": accuracy})


def at_threshold(p: Column, threshold: Column) -> Column:
    return (p >= threshold).cast("int")


def threshold_table(rows: DataFrame, grid: list[float], by: list[str] = [], p: str = "p") -> DataFrame:  # noqa: B006
    """The metrics at each threshold of a grid. Counts by the number of thresholds that a row passes come first, so the sweep
    costs one aggregation of the rows and a join of some `len(grid)` counts, not a copy of the rows for each threshold."""
    passed = sum((F.col(p) >= F.lit(x)).cast("int") for x in grid)
    counts = rows.groupBy(*by, passed.alias("_passed"), "label").agg(F.count("*").alias("_n"))
    each = counts.withColumn("_t", F.explode(F.array(*[F.struct(F.lit(x).alias("threshold"), F.lit(k).alias("k")) for k, x in enumerate(sorted(grid))])))
    hit = (F.col("_passed") > F.col("_t.k")).cast("int")
    cell = lambda a, b: F.sum(F.when((F.col("label") == a) & (F.col("_hit") == b), F.col("_n")).otherwise(0))
    cells = each.withColumns({"threshold": F.col("_t.threshold"), "_hit": hit}).groupBy(*by, "threshold").agg(*[cell(a, b).alias(n) for n, a, b in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    out = cells.withColumns({"f1_label0": _f1("tn", "fp", "fn"), "f1_label1": _f1("tp", "fp", "fn")})
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    share = F.greatest(F.col("tp") + F.col("fp"), F.col("tn") + F.col("fn")) / total
    return out.withColumns({"macro_f1": (F.col("f1_label0") + F.col("f1_label1")) / 2.0, "accuracy": (F.col("tn") + F.col("tp")) / total, "max_share": share})


def grid(low: int, high: int, step: int = 1, of: float = 100.0) -> list[float]:
    return [i / of for i in range(low, high + 1, step)]


def best(table: DataFrame, order: list[Column], by: list[str] = []) -> DataFrame:  # noqa: B006
    """The first row of each group by a total order."""
    w = W.partitionBy(*by).orderBy(*order)
    return table.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def select_threshold(table: DataFrame, strategy: str, by: list[str] = [], guard: float | None = None, middle: float = 0.5) -> DataFrame:  # noqa: B006
    """The threshold with the best macro (or class 0) F1; ties by the other one, nearness to the middle, and its own value."""
    first = ["macro_f1", "f1_label0"] if strategy == "macro" else ["f1_label0", "macro_f1"]
    t = table if guard is None else table.where(F.col("max_share") <= guard)
    return best(t, [*map(F.desc, first), F.abs(F.col("threshold") - F.lit(middle)), F.col("threshold")], by)


def metric_record(rows: DataFrame, by: list[str] = [], threshold: float = 0.5) -> DataFrame:  # noqa: B006
    """The metrics with Brier score, mean and spread of the probability, and counts of predictions."""
    t = rows.withColumn("prediction", at_threshold(F.col("p"), F.lit(threshold)))
    more = t.groupBy(*by).agg(
        F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"), F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"),
        F.count_if(F.col("prediction") == 0).alias("predicted_0"), F.count_if(F.col("prediction") == 1).alias("predicted_1"),
    )
    base = classification_metrics(t, by)
    return base.join(more, by) if by else base.crossJoin(more)  # one row each


def calibration_table(rows: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, low, high, n, mean_p, rate) for bins closed on the left, the last on both sides; empty ones with nulls."""
    edges = [k * (1.0 / bins) for k in range(bins + 1)]
    index = F.least(sum((F.col("p") >= F.lit(e)).cast("int") for e in edges[1:]), F.lit(bins - 1))
    found = rows.groupBy(index.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("label").cast("double")).alias("rate"))
    all_bins = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.element_at(F.array(*map(F.lit, edges)), (F.col("id") + 1).cast("int")).alias("low"), F.element_at(F.array(*map(F.lit, edges)), (F.col("id") + 2).cast("int")).alias("high"))
    return all_bins.join(found, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def probability_diagnostics(rows: DataFrame) -> DataFrame:
    q = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    names = [f"q{round(x * 100):02d}" for x in q]
    out = rows.agg(
        F.count("*").alias("n"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.avg("p").alias("mean_p"), F.stddev_pop("p").alias("std_p"),
        F.avg(F.col("label").cast("double")).alias("prevalence"), F.percentile("p", F.array(*map(F.lit, q))).alias("_q"),
    )
    return out.withColumns({n: F.col("_q")[k] for k, n in enumerate(names)}).drop("_q")


def auc(rows: DataFrame) -> DataFrame:
    """Area under the ROC curve by mid-ranks. Ranks run over the counts by distinct probability, not over rows."""
    counts = rows.groupBy("p").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("wins", F.col("pos") * (below + F.col("neg") / 2.0))
    return wins.agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def route_rules(p0: Column, p1: Column, present: Column) -> dict[str, Column]:
    """The five ways to blend two models by route."""
    return {
        "e0": p0, "e1": p1, "e1_present_e0_absent": F.when(present, p1).otherwise(p0),
        "half": F.when(present, p1).otherwise(0.5 * p0 + 0.5 * p1), "quarter": F.when(present, p1).otherwise(0.25 * p0 + 0.75 * p1),
    }
