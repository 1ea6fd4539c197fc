"""Helpers shared by the training-text operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: The largest number of rows of a few short columns that is broadcast (about 50 MB).
BROADCAST_ROWS = 500_000
#: The largest estimated size of rows with arrays that is broadcast.
BROADCAST_BYTES = 32_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where none is configured (tests on one machine) is one made here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder: later steps do not make it again, and a lost executor takes nothing with it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def filed(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder as Parquet. For loops: unlike a checkpoint, what is read back carries neither the
    estimates nor the constraints of the plan that made it, which grow from round to round."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def lower_az(c: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if it is counted to have few rows; else joins shuffle it. Give a saved `df`."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def light(df: DataFrame, row_bytes: Column) -> DataFrame:
    """`df` with a broadcast hint if its rows, by `row_bytes`, come to `BROADCAST_BYTES` at most. Give a saved `df`."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def release() -> None:
    """Gives memory that a worker has freed back to the system: the worker stays for later tasks, maybe of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system has it
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """`run`, a function of a task's batches, that calls `release` when it is through: its last batch is gone by then too."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 500):
    """Within it, Arrow batches have `rows` rows at most, for steps over whole texts that are run (saved or filed) there."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def numbered(docs: DataFrame, *names: str) -> tuple:
    """`docs` with columns named by their places, which clash with no name used inside, and the new names of `names`."""
    new, old = [f"_column{k}" for k in range(len(docs.columns))], [c.lower() for c in docs.columns]
    return (docs.toDF(*new), *[new[old.index(x.lower())] for x in names])


def keep_only(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that `decisions` leaves.

    decisions: (id, text_md5, stays) for every row that goes (stays = 0) or is one of several like rows of which one stays
    (stays = 1). Rows without a decision stay. Nulls match nulls; a null text counts as its own value; any column names will do."""
    decisions = saved(decisions.select(F.col("id").alias("_id"), F.col("text_md5").alias("_md5"), F.col("stays").alias("_stays")).distinct())
    rows, own_id, own_text = numbered(docs, id_col, text_col)
    marked = rows.withColumn("_text_md5", F.md5(F.col(own_text)))
    d = small(decisions)
    marked = marked.join(d, marked[own_id].eqNullSafe(d["_id"]) & marked["_text_md5"].eqNullSafe(d["_md5"]), "left")
    out = marked.where(F.col("_stays").isNull())
    if not decisions.where("_stays = 1").isEmpty():
        w = W.partitionBy("_id", "_md5").orderBy(F.lit(1))
        once = marked.where("_stays = 1").withColumn("_n", F.row_number().over(w)).where("_n = 1")
        out = out.unionByName(once.drop("_n"))
    return out.select(*rows.columns).toDF(*docs.columns)
