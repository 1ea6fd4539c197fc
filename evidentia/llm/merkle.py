"""Merkle manifest of a dataset: a tree a group, a tree over the groups' roots, and a proof for each row (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm._common import filed, numbered, small

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: Levels that are made of one block of nodes at once: 2^10 nodes of 64 characters.
TIER = 10


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*values), 256)


def framed(c: Column) -> Column:
    """A value with its size in bytes before it, or `-` for null: no two rows give one string."""
    s = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` (written to the shared folder) with their place, from 0, in `order`. Rows are dealt out by ranges of the order and
    numbered where they lie; only one count for each part meets in one place."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = filed(parts.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    starts = parts.groupBy("_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each partition
    starts = starts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"))
    return parts.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def _height(n: Column) -> Column:
    """Levels above n nodes of which every two become one."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _parents(nodes: Column) -> Column:
    pair = lambda i: digest(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) + 1) / 2).cast("int") - 1), pair)


def tree(rows: DataFrame, tier: int = TIER) -> tuple[DataFrame, DataFrame]:
    """The trees over `rows` (tree, idx, n, node), and the way up for each row: (tree, idx, steps) and (tree, root).

    Blocks of 2^tier neighbours become a table of their nodes, by level and place, and one top. Each row explodes the coordinates of
    the siblings that it needs within its block, which follow from idx and n, and joins them with that table; above, the way of
    the block is the way of all its rows, so no node is asked for by more rows than a block has. Tops go through the same.
    steps: from below, the side (1: the row's own node stands on the right) and the sibling, null where a node is alone."""
    most = rows.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return rows.select("tree", "idx", F.expr("cast(array() as array<struct<side:int,node:string>>)").alias("steps")), rows.select("tree", F.col("node").alias("root"))
    block, levels = F.shiftright("idx", tier).alias("block"), F.least(F.lit(tier), _height(F.col("n"))).alias("levels")
    packs = rows.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("_own"))
    packs = packs.select("tree", "n", "block", levels, F.transform("_own", lambda x: x["node"]).alias("_0"))
    for k in range(1, tier + 1):
        packs = packs.withColumn(f"_{k}", F.when(F.col("levels") >= k, _parents(F.col(f"_{k - 1}"))))
    top = F.coalesce(*[F.col(f"_{k}") for k in range(tier, -1, -1)])[0].alias("top")
    packs = filed(packs.select("tree", "n", "block", top, *[f"_{k}" for k in range(tier)]))
    table = packs.select("tree", "block", F.posexplode(F.array(*[f"_{k}" for k in range(tier)])).alias("level", "nodes"))
    table = table.select("tree", "level", F.posexplode("nodes").alias("at", "node"), "block")
    table = table.select("tree", "level", F.expr(f"block * shiftleft(1L, {tier} - level) + at").alias("at"), "node")

    asked = rows.select("tree", "idx", "n", levels).where("levels > 0").select("tree", "idx", "n", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    asked = asked.select("tree", "idx", "level", F.expr("shiftright(idx, level) ^ 1L").alias("at"), F.expr("shiftright(n - 1, level)").alias("last")).where("at <= last")
    found = asked.join(table, ["tree", "level", "at"]).groupBy("tree", "idx").agg(F.map_from_entries(F.collect_list(F.struct("level", "node"))).alias("_found"))
    own = F.expr("transform(sequence(0, levels - 1), k -> struct(cast(shiftright(idx, k) & 1 as int) as side, _found[k] as node))")
    none = F.expr("cast(array() as array<struct<side:int,node:string>>)")
    mine = rows.select("tree", "idx", block, levels).join(found, ["tree", "idx"], "left").select("tree", "idx", "block", F.when(F.col("levels") > 0, own).otherwise(none).alias("_own"))

    tops = packs.select("tree", F.col("block").alias("idx"), F.shiftright(F.col("n") + ((1 << tier) - 1), tier).alias("n"), F.col("top").alias("node"))
    above, roots = tree(tops, tier)
    above = above.select("tree", F.col("idx").alias("block"), F.col("steps").alias("_above"))
    return mine.join(above, ["tree", "block"]).select("tree", "idx", F.concat("_own", "_above").alias("steps")), roots


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    up = lambda own, s: digest(F.when(s["side"] == 1, F.coalesce(s["node"], F.lit(""))).otherwise(""), own, F.when(s["side"] == 0, F.coalesce(s["node"], F.lit(""))).otherwise(""))
    return F.aggregate(steps, leaf, up)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", change=None, tier: int = TIER) -> DataFrame:
    """One row per document: id, leaf, changed_leaf, subroot, root, steps (siblings from the leaf to the root, see `tree`).

    A leaf is the digest of the fields, each with its size before it. Leaves of a group stand by id (null first), ties by their
    digest; the groups' roots by group, null first. A lone leaf is its group's root; a lone group's root is the root.
    change: from the columns by field to those that differ, for the leaf that a tampered row would have. Null fields, repeated rows and
    other columns, whatever their names, are fine: rows alike in all fields stand next to each other. No rows give none."""
    rows, *own = numbered(docs, *fields)
    at = dict(zip(fields, map(F.col, own)))
    leaf = lambda columns: digest(*[framed(columns[f]) for f in fields])
    new = change(at) if change else {}
    changed, same = at | new, F.lit(True)
    for f in new:
        same = same & new[f].cast("string").eqNullSafe(at[f].cast("string"))
    leaves = rows.select(at[id_col].alias("id"), at[group_col].alias("grp"), leaf(at).alias("leaf"), F.when(~same, leaf(changed)).alias("changed"), F.monotonically_increasing_id().alias("tie"))
    leaves = filed(ranked(filed(leaves), ["grp", "id", "leaf", "tie"], "place").drop("tie"))
    groups = ranked(leaves.groupBy("grp").agg(F.min("place").alias("start"), F.count("*").alias("n")), ["grp"], "tree")
    groups = filed(groups)
    key = F.coalesce(F.concat(F.lit("="), "grp"), F.lit("-"))
    known = leaves.withColumn("_k", key).join(small(groups.select(key.alias("_k"), "start", "n", "tree")), "_k")
    placed = filed(known.select("id", "leaf", "changed", "tree", (F.col("place") - F.col("start")).alias("idx"), "n"))
    steps, subroots = tree(placed.select("tree", "idx", "n", F.col("leaf").alias("node")), tier)
    subroots = filed(subroots)
    count = groups.count()
    above, root = tree(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(count).cast("long").alias("n"), F.col("root").alias("node")), tier)
    tops = subroots.select("tree", F.col("root").alias("subroot")).join(above.select(F.col("idx").alias("tree"), F.col("steps").alias("_above")), "tree").crossJoin(F.broadcast(root.select("root")))  # one row
    out = placed.join(steps, ["tree", "idx"]).join(small(filed(tops), count), "tree")
    return out.select("id", "leaf", F.coalesce("changed", "leaf").alias("changed_leaf"), "subroot", "root", F.concat("steps", "_above").alias("steps"))


def proofs(rows: DataFrame) -> DataFrame:
    """Of rows of `manifest`: doc_id, leaf, subroot, root, proof_sha256 (the digest of the siblings in turn), folded_root (of the
    changed leaf and the siblings), verified (whether that is the root)."""
    siblings = F.array_join(F.transform("steps", lambda s: s["node"]), "")
    out = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("changed_leaf"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
