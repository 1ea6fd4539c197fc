"""Submissions and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.errors import SubmissionError
from evidentia.operators import audits

#: Names that a shared summary must not have at any depth.
PRIVATE = ("id", "ids", "text", "texts", "probabilities", "predictions", "rows")


def build_submission(test: DataFrame, predictions: DataFrame) -> DataFrame:
    """(ordinal, id, label) in the order of `test` (ordinal, id), checked."""
    out = test.select("ordinal", "id").join(predictions.select("ordinal", "label"), "ordinal", "left")
    audits.require(audits.submission(out, test), SubmissionError)
    return out.orderBy("ordinal")


def write_submissions(scores: DataFrame, thresholds: dict[str, float], path: str) -> None:
    """One folder of (ordinal, id, label) for each strategy."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.lit(t).alias("t")) for n, t in thresholds.items()]))
    out = scores.withColumn("_s", each).select("ordinal", "id", F.col("_s.strategy").alias("strategy"), (F.col("p") >= F.col("_s.t")).cast("int").alias("label"))
    out.write.partitionBy("strategy").mode("error").parquet(path)


def write_artifacts(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet below a folder that must not have it yet."""
    for name, table in tables.items():
        table.write.mode("error").parquet(f"{folder}/{name}")


def private_fields(schema: T.DataType, at: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in [*([f"{at}{f.name}"] if f.name.lower() in PRIVATE else []), *private_fields(f.dataType, f"{at}{f.name}.")]]
    if isinstance(schema, T.ArrayType):
        return private_fields(schema.elementType, at)
    return private_fields(schema.valueType, at) if isinstance(schema, T.MapType) else []


def write_summary(summary: DataFrame, path: str) -> None:
    """A summary as JSON, refused if it has a private field."""
    if found := private_fields(summary.schema):
        raise SubmissionError(f"private fields {found}")
    summary.coalesce(1).write.mode("error").json(path)
