"""Families of related rows: a table of typed edges, components by alternating stars, and what the families are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.errors import LabelConflictError
from evidentia.functions import text as X
from evidentia.operators import relations, retrieval
from evidentia.operators.relations import fingerprint, numbered_by, small
from evidentia.operators.sparse import filed


def chain_edges(rows: DataFrame, kind: str, key: Column, row: str = "row_idx") -> DataFrame:
    """(kind, src, dst) from the least row of each key to its others; a null key links nothing."""
    return relations.star_edges(rows, key, row).select(F.lit(kind).alias("kind"), "src", "dst")


def star_components(edges: DataFrame) -> DataFrame:
    """(v, root): the least row that each end of `edges` (src, dst) reaches.

    Large and small stars in turn: each row's larger neighbours go to the least row next to it, then each row and its smaller ones
    do. Each round aggregates to one least neighbour a row and joins that back, so a hub's edges, however many, meet a single row
    of the other side, and a skewed join can split them. Rounds are written to the shared folder; they end when the edges are
    stars, after a number that grows with the logarithm of the largest component."""
    own = filed(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct())
    while True:
        both = own.select(F.col("a").alias("u"), F.col("b").alias("v")).union(own.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = filed(both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct())
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        joined = large.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u")
        new = filed(joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(joined.select("m", "u")).where("a < b").distinct())
        # Stars: no row is both the centre of one and a point of another, and each point has one centre.
        if new.select("a").join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and new.groupBy("b").count().where("count > 1").isEmpty():
            return new.select(F.col("b").alias("v"), F.col("a").alias("root")).union(new.select("a", "a").distinct())
        own = new


def families(rows: DataFrame, edges: DataFrame, row: str = "row_idx") -> DataFrame:
    """(row, root) for every row: rows without an edge are families of their own."""
    found = star_components(edges)
    return rows.select(row).join(found.withColumnRenamed("v", row), row, "left").select(row, F.coalesce("root", row).alias("root"))


def name_families(groups: DataFrame, prefix: str, row: str = "row_idx") -> DataFrame:
    """(row, root, group_id), numbered by their least rows."""
    named = filed(numbered_by(groups.select("root").distinct(), ["root"], "_n"))
    return groups.join(small(named), "root").select(row, "root", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), 4, "0")).alias("group_id"))


def conflicts(rows: DataFrame, key: Column, label: str = "label") -> DataFrame:
    """(key, n) of the keys whose rows have unlike labels."""
    return relations.label_conflicts(rows.withColumn("_key", key), "_key", label).withColumnRenamed("_key", "key")


def _no_conflict(rows: DataFrame, key: Column) -> None:
    n = conflicts(rows, key).count()
    if n:
        raise LabelConflictError(f"{n} exact texts with conflicting labels")


def official_edges(rows: DataFrame, rule: str = "v3", strict: bool = True) -> DataFrame:
    """(kind, src, dst) of `rows` (row_idx, prompt, context, response, label): the same row (`exact`), the same prompt and context
    (`pair`), and texts nearly alike (`near`). strict: equal rows with unlike labels raise."""
    p, r = X.normalize_text(F.col("prompt")), X.normalize_text(F.col("response"))
    c = X.normalize_text(X.clean_context(F.col("context"), rule))
    t = filed(rows.select("row_idx", "label", p.alias("p"), c.alias("c"), r.alias("r")))
    exact = fingerprint(F.col("p"), F.col("c"), F.col("r"))
    if strict:
        _no_conflict(t, exact)
    both = X.transformer_pair(F.col("p"), F.col("c"), F.col("r"))
    texts = t.select(F.col("row_idx").alias("id"), F.concat(both["a"], F.lit("\n\x1e\n"), both["b"]).alias("text"))
    near = retrieval.near_classes(texts)
    return chain_edges(t, "exact", exact).union(chain_edges(t, "pair", fingerprint(F.col("p"), F.col("c")))).union(near.select(F.lit("near").alias("kind"), F.col("l").alias("src"), F.col("r").alias("dst")))


def v5_edges(rows: DataFrame, rule: str = "v4", strict: bool = True) -> DataFrame:
    """(kind, src, dst): the official edges, with absent contexts by `rule`, and the same row (`v5_exact`), prompt (`prompt`) or context
    (`context`, present ones only) in the fifth normalisation."""
    present = ~X.is_absent(F.col("context"), rule)
    routed = rows.withColumn("context", F.when(present, F.col("context")))
    p, r = X.normalize_v5(F.col("prompt")), X.normalize_v5(F.col("response"))
    c = F.when(present, X.normalize_v5(F.col("context"))).otherwise("")
    t = filed(rows.select("row_idx", "label", p.alias("p"), c.alias("c"), r.alias("r"), present.alias("present")))
    exact = fingerprint(F.col("p"), F.col("c"), F.col("r"))
    if strict:
        _no_conflict(t, exact)
    out = official_edges(routed, "v3", strict)
    for kind, key in (("v5_exact", exact), ("prompt", fingerprint(F.col("p"))), ("context", F.when(F.col("present"), fingerprint(F.col("c"))))):
        out = out.union(chain_edges(t, kind, key))
    return out


def group_audit(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: families, those of more than one row, rows of the largest, and edges of each kind."""
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    kinds = edges.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}_links") for k in ("exact", "pair", "near", "v5_exact", "prompt", "context")])
    return sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("larger"), F.max("n").alias("largest")).crossJoin(kinds)  # one row each
