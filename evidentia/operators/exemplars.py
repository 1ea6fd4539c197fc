"""Labelled examples of middle length, and which of them each row is shown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.operators.relations import small

#: Examples kept of each kind of row, and the kinds in the order in which they are shown.
KEPT = 8
KINDS = ((False, 0), (False, 1), (True, 0), (True, 1))


def pool(rows: DataFrame, kept: int = KEPT) -> DataFrame:
    """(present, label, rank, row_idx) of the `kept` rows of each kind whose length is nearest to the kind's median; ties by length, then row.

    rows: (row_idx, present, label, text_length). The medians are exact and come from counts by length; the ranks are taken in each
    task first, so no kind is sorted by one task."""
    medians = rows.groupBy("present", "label").agg(F.percentile("text_length", F.lit(0.5)).alias("_median"))
    near = rows.join(F.broadcast(medians), ["present", "label"])  # a row for each kind
    order = W.partitionBy("present", "label").orderBy(F.abs(F.col("text_length") - F.col("_median")), "text_length", "row_idx")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept).select("present", "label", "rank", "row_idx")


def shown(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(row_idx, at, example): for each row the first example of each kind that is not the row itself, in the order of KINDS."""
    first = chosen.where("rank <= 2").groupBy("present", "label").agg(F.min_by("row_idx", "rank").alias("_one"), F.when(F.count("*") > 1, F.max_by("row_idx", "rank")).alias("_two"))
    at = F.coalesce(*[F.when((F.col("present") == p) & (F.col("label") == y), F.lit(k)) for k, (p, y) in enumerate(KINDS)])
    each = rows.select("row_idx").crossJoin(F.broadcast(first.select(at.alias("at"), "_one", "_two")))  # four rows
    example = F.when(F.col("row_idx") == F.col("_one"), F.col("_two")).otherwise(F.col("_one"))
    return each.select("row_idx", "at", example.alias("example")).where("example IS NOT NULL")


def prompts(rows: DataFrame, examples: DataFrame) -> DataFrame:
    """(row_idx, examples): the texts of a row's examples in order, a blank line between them. rows: (row_idx, block), the text that shows a
    row as an example."""
    texts = examples.join(small(rows.select(F.col("row_idx").alias("example"), "block").join(examples.select("example").distinct(), "example", "left_semi")), "example")
    return texts.groupBy("row_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda x: x["block"]), "\n\n").alias("examples"))  # four at most
