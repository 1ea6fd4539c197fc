"""The engine's inputs, derived from the test tables; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labeled rows: a document's first line as prompt, a last line (of every third row, the next document's) as response."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_idx"), F.col("quality").alias("label"))
    # Lines and contexts are cut where a document is read; only rows that show their text as context move it, once.
    m, n = F.col("doc_id"), F.substring("source", 4, 9).cast("int")
    context = F.when((m % 5).isin(0, 1), F.lit(None)).when(m % 5 == 2, "[NULL]").otherwise(F.col("text"))
    lines = docs.select(m.alias("row_idx"), F.substring_index("text", "\n", 1).alias("prompt"), F.substring_index("text", "\n", -1).alias("last"), context.alias("context"), "source", n.alias("n"))
    nexts = docs.select(m.alias("row_idx"), F.substring_index("text", "\n", -1).alias("next")).join(labels.select("row_idx"), "row_idx").select((F.col("row_idx") - 1).alias("row_idx"), "next")
    m, n, last = F.col("row_idx"), F.col("n"), F.col("last")
    return lines.join(labels, "row_idx").join(nexts, "row_idx", "left").select(
        "row_idx", "prompt", F.when(m % 3 == 0, F.coalesce("next", last)).otherwise(last).alias("response"), "context", "label", "source",
        F.when(n <= 13, "public_train").when(n <= 16, "public_validation").otherwise("official").alias("partition"),
        ((m * 7919) % 1000 / F.lit(1000.0)).alias("p_e0"), ((m * 104729) % 1000 / F.lit(1000.0)).alias("p_e1"),
    )


QA = """
l AS (SELECT d.doc_id AS row_idx, d.text, d.source, l.quality AS label, string_split(d.text, chr(10)) AS ls FROM documents d JOIN labels l USING (doc_id)),
qa AS (
    SELECT a.row_idx, a.ls[1] AS prompt, CASE WHEN a.row_idx % 3 = 0 THEN coalesce(b.ls[-1], a.ls[-1]) ELSE a.ls[-1] END AS response,
        CASE WHEN a.row_idx % 5 IN (0, 1) THEN NULL WHEN a.row_idx % 5 = 2 THEN '[NULL]' ELSE a.text END AS context, a.label, a.source,
        CASE WHEN a.source[4:]::INT <= 13 THEN 'public_train' WHEN a.source[4:]::INT <= 16 THEN 'public_validation' ELSE 'official' END AS partition,
        ((a.row_idx * 7919) % 1000)::DOUBLE / 1000::DOUBLE AS p_e0, ((a.row_idx * 104729) % 1000)::DOUBLE / 1000::DOUBLE AS p_e1
    FROM l a LEFT JOIN l b ON b.row_idx = a.row_idx + 1
)
"""

#: Rows in Bengali and edge cases of the predicates, which the tables lack.
FIXTURE = (
    (0, None, "ঢাকা ২০২৪"), (1, "", "ঢাকা 2024"), (2, "   ", "না"), (3, "[NULL]", "3.5 x"), (4, " null ", "a_b c"), (5, "None", "একটি ১২"), (6, "N/A", "who?"), (7, "NaN", "x"),
    (8, "<NA>", "y"), (9, "na", "z"), (10, "[no_context]", "w"), (11, "0", "০.৫"), (12, "False", "v"), (13, "ঢাকা ২০২৪ সালে বড় শহর", "ঢাকা 2024"), (14, "[NULL] কিন্তু তথ্য আছে", "তথ্য"),
    (15, "a b  c", "b  c"), (16, "été 1,5 «x»", "été"), (17, "Tab\tend\r\nnew", "\x1b[31mred\x1b[0m"),
)


def fixture(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXTURE, "row_idx long, context string, response string")


def sql_string(s: str | None) -> str:
    if s is None:
        return "NULL"
    parts = ["'" + "".join("''" if c == "'" else c for c in s) + "'"]
    for c in ("\n", "\r", "\x1b", "\t"):
        parts = [q for p in parts for q in ([p] if c not in p else (f"' || chr({ord(c)}) || '".join(p.split(c)),))]
    return "(" + parts[0] + ")"


FIXTURE_SQL = "fx(row_idx, context, response) AS (VALUES " + ", ".join(f"({i}::BIGINT, {sql_string(c)}, {sql_string(r)})" for i, c, r in FIXTURE) + ")"

#: All labeled rows and the fixture's, under ids below zero, in place of the fixture.
WHOLE_SQL = QA + ", " + FIXTURE_SQL.replace("fx(", "few(", 1) + ", fx AS (SELECT row_idx, context, response FROM qa UNION ALL SELECT -1 - row_idx, context, response FROM few)"


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = fixture(spark).withColumn("row_idx", -1 - F.col("row_idx"))
    return qa(spark, sf_dir).select("row_idx", "context", "response").unionByName(few)
