"""Fingerprints, duplicates, guarded joins, set operations and groups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.errors import DataValidationError
from evidentia.functions import text as X

SEPARATOR = "\n\x1f\n"


def fingerprint(*values: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, *[F.coalesce(v, F.lit("")) for v in values]), 256)


def add_fingerprints(rows: DataFrame) -> DataFrame:
    """`rows` (prompt, context, response, label) with text_fp and labeled_fp."""
    marked = X.marked_text(X.normalize_text(F.col("prompt")), X.normalize_context(F.col("context")), X.normalize_text(F.col("response")))
    t = rows.withColumn("_marked", marked)
    labeled = F.sha2(F.concat("_marked", F.lit("\n\n__LABEL__\n"), F.col("label").cast("string")), 256)
    return t.withColumns({"text_fp": F.sha2("_marked", 256), "labeled_fp": labeled}).drop("_marked")


def _json(c: Column) -> Column:
    """A string as JSON has it, other characters than ASCII as they are."""
    return F.substring(F.to_json(F.struct(c.alias("v"))), 6, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def stable_row_id(prompt: Column, context: Column, response: Column, label: Column, present: Column) -> Column:
    """`train-` and the digest of the row as JSON with sorted keys."""
    body = F.concat(F.lit('{"context":'), _json(context), F.lit(',"context_present":'), present.cast("string"), F.lit(',"label":'), label.cast("string"), F.lit(',"prompt_bn":'), _json(prompt), F.lit(',"response_bn":'), _json(response), F.lit("}"))
    return F.concat(F.lit("train-"), F.sha2(body, 256))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregation of whole rows: no key is sorted by one task."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*rows.columns)


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs more than once."""
    many = rows.groupBy(*keys).count().where("count > 1").drop("count")
    return rows.join(many, keys, "left_semi")


def label_conflicts(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    return rows.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("n")).where("low != high").select(key, "n")


def deduplicate_by_precedence(rows: DataFrame, partition: str, precedence: list[str], text_key: str, labeled_key: str, order: list[str]) -> DataFrame:
    """Each partition without the rows whose text an earlier one has, and without repeats of a labeled row."""
    out = seen = None
    for name in precedence:
        own = rows.where(F.col(partition) == name)
        own = keep_first(own if seen is None else own.join(seen, text_key, "left_anti"), [labeled_key], order)
        out = own if out is None else out.unionByName(own)
        seen = out.select(text_key).distinct()
    return out


def aligned_merge(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A one-to-one join on `keys`; raises if a key repeats or has no partner."""
    for name, side in (("left", left), ("right", right)):
        if not side.groupBy(*keys).count().where("count > 1").isEmpty():
            raise DataValidationError(f"repeated keys on the {name}")
    counts = left.select(*keys, F.lit(1).alias("_l")).join(right.select(*keys, F.lit(1).alias("_r")), keys, "full")
    if not counts.where("_l IS NULL OR _r IS NULL").isEmpty():
        raise DataValidationError("keys without a partner")
    return left.join(right, keys)


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct keys both sides have."""
    return left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, n): rows that one side has more often than the other. Equal tables give no row."""
    both = left.withColumn("_k", F.lit(1)).unionByName(right.withColumn("_k", F.lit(-1)))
    net = both.groupBy(*left.columns).agg(F.sum("_k").alias("_d")).where("_d != 0")
    return net.groupBy(F.when(F.col("_d") > 0, "left").otherwise("right").alias("side")).agg(F.sum(F.abs("_d")).alias("n"))


def star_edges(rows: DataFrame, key: Column, row: str = "row_idx") -> DataFrame:
    """(src, dst) from each key's first row to its others."""
    t = rows.select(F.col(row).alias("dst"), key.alias("_key")).where("_key IS NOT NULL")
    first = t.groupBy("_key").agg(F.min("dst").alias("src"))
    return t.join(first, "_key").where("src != dst").select("src", "dst")


#: The largest number of rows of a few short columns that is broadcast (about 50 MB).
BROADCAST_ROWS = 500_000


def small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if it is counted to have few rows; else joins shuffle it. Give a table that is written already."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def checkpoint_folder(spark) -> str:
    """The folder that the cluster shares; one is made only where the session names none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def filed(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet to the shared checkpoint folder and read again."""
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 500):
    """Within it, Arrow batches have `rows` rows at most, for steps over whole texts that are written there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def components(nodes: DataFrame, edges: DataFrame, row: str = "row_idx") -> DataFrame:
    """(row, root): the least row that each reaches. Labels pass along edges, then to the label's own label, each round written
    as Parquet to the session's checkpoint folder, until nothing changes. Only rows with an edge take part; the others are their own roots."""
    both = filed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct())
    labels = filed(both.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct())
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("c").alias("m"))
        new = labels.join(near, labels["v"] == near["a"], "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("c").alias("j"))
        new = filed(new.join(jump, "m").select("v", "c", F.least("m", "j").alias("m")))
        if new.where("m < c").isEmpty():
            return nodes.select(row).join(labels.withColumnRenamed("v", row), row, "left").select(row, F.coalesce("c", row).alias("root"))
        labels = new.select("v", F.col("m").alias("c"))


def duplicate_groups(rows: DataFrame, context_rule: str = "v4a", also: tuple[str, ...] = ()) -> DataFrame:
    """(row_idx, root, also) of families that share the whole row or prompt and context. Texts are normalised once, some hundred rows at
    a time; what is written and used from there on are their fingerprints and the columns `also`."""
    p, c, r = X.normalize_text(F.col("prompt")), X.normalize_text(X.clean_context(F.col("context"), context_rule)), X.normalize_text(F.col("response"))
    with short_batches(rows.sparkSession):
        t = filed(rows.select(p.alias("p"), c.alias("c"), r.alias("r"), "row_idx", *also).select("row_idx", *also, fingerprint(F.col("p"), F.col("c"), F.col("r")).alias("exact"), fingerprint(F.col("p"), F.col("c")).alias("pair")))
    found = components(t, star_edges(t, F.col("exact")).union(star_edges(t, F.col("pair"))))
    return found.join(t.select("row_idx", *also), "row_idx") if also else found


def numbered_by(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows` with their places, from 0, in `order`. Rows are dealt out by ranges of the order and numbered where they lie; only a count
    for each part meets in one place."""
    path = f"{checkpoint_folder(rows.sparkSession)}/table-{uuid.uuid4().hex}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    parts = rows.sparkSession.read.parquet(path)
    starts = parts.groupBy("_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))  # a row for each part
    starts = starts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"))
    return parts.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_at") + F.col("_shift")).alias(name))


def group_ids(groups: DataFrame, prefix: str = "group-") -> DataFrame:
    """(row_idx, group_id): groups numbered by their first rows."""
    roots = numbered_by(groups.select("root").distinct(), ["root"], "_n")
    return groups.join(roots, "root").select("row_idx", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), 4, "0")).alias("group_id"))


def group_audit(groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    return sizes.agg(F.count("*").alias("groups"), F.count_if(F.col("size") > 1).alias("larger"), F.max("size").alias("largest"), F.sum(F.col("size") - 1).alias("links"))
