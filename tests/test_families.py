"""Families and folds: texts are normalised once, and no task ranks all families of a seed."""

import re

from pyspark.sql import functions as F

from evidentia.operators import folds, relations, selection

ROWS = [(0, "a", "é x", "r", 1), (1, " a ", "é  x", "s", 0), (2, "b", None, "r", 1), (3, "b", "nan", "q", 0), (4, "c", "é x", "r", 1), (7, "é", "y", "é", 0)]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_normalised_once(spark):
    """What is returned has no Python step over texts left in its plan, and further columns go along."""
    rows = spark.createDataFrame(ROWS, "row_idx long, prompt string, context string, response string, label int")
    out = relations.duplicate_groups(rows, also=("label",))
    assert "ArrowEvalPython" not in plan(out)
    assert {r.row_idx: (r.root, r.label) for r in out.collect()} == {0: (0, 1), 1: (0, 0), 2: (2, 1), 3: (2, 0), 4: (4, 1), 7: (7, 0)}


def test_components_of_rows_with_edges(spark):
    nodes, edges = spark.range(6).withColumnRenamed("id", "row_idx"), spark.createDataFrame([(3, 1), (4, 3)], "src long, dst long")
    assert {r.row_idx: r.root for r in relations.components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 5}
    assert relations.components(nodes, edges.limit(0)).where("row_idx != root").count() == 0


def test_places(spark):
    """Places are those of one rank over each seed; windows over rows are cut by size and digest. A family without labels has a place."""
    groups = spark.range(3000).select(F.col("id").alias("root"), (F.col("id") % 3 + 1).alias("n"), F.when(F.col("id") % 7 > 0, F.col("id") % 2 == 0).alias("major"), F.explode(F.array(F.lit(17), F.lit(29))).alias("seed"))
    out = folds._placed(groups, ["seed", "major"], F.col("seed"))
    want = "row_number() OVER (PARTITION BY seed, major ORDER BY n DESC, md5(concat_ws('-', cast(seed as string), cast(root as string))), root) - 1"
    assert out.withColumn("want", F.expr(want)).where("want != _rank").count() == 0
    assert out.count() == 6000
    assert re.search(r"row_number\(\) windowspecdefinition\(seed#\d+, major#\d+, n#\w+, _b#", plan(out))


def test_scopes_within_rows(spark):
    """Counts of each scope, and no shuffle of a row for each key and scope: families are summed at once."""
    scopes = spark.createDataFrame([(1, [0, 1], [2]), (2, [0, 2], [0]), (3, [1, 1], [])], "row_idx long, train array<int>, test array<int>")
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "row_idx long, root long")
    out = selection.scope_audit(scopes, groups)
    assert "first(root" not in plan(out)
    assert {r.scope: tuple(r[1:]) for r in out.collect()} == {0: (2, 1, 1, 1), 1: (2, 0, 0, 0), 2: (1, 1, 0, 1)}
