"""Mixing of sources to target weights by weighted sampling without replacement (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm._common import WORD, numbered, saved, small

#: Weights of the sources in the order of their names, repeated.
CYCLE = (1, 2, 3)

#: Rows that one task sorts.
SORT_ROWS = 20_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, cap: int = 3) -> DataFrame:
    """(source, source_size) with target added.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes; a target is `cap` times
    its source's size at most and the excess goes to the others by weight. At the end, target = min(level * weight, limit)
    with one level: with sources sorted by limit / weight, those before some place are full and the level is what they leave
    over, by the weights of the rest. The windows run over the table of sources, a row each."""
    full = W.partitionBy().orderBy("ratio", "source")
    total = W.partitionBy()
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.pmod(F.row_number().over(W.partitionBy().orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(CYCLE))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("limit", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("limit") / F.col("weight"))
    before = full.rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("left", F.sum("source_size").over(total) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).withColumn("share", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.max(F.when(F.col("left") / F.col("share") <= F.col("ratio"), F.col("left") / F.col("share"))).over(total)
    return ranked.withColumn("level", level).select("source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def uniform(*c: Column) -> Column:
    """A number over 0 and under 1 from the columns' digest."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("")) for x in c]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def mix(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (source, size, quality, draw, ...) with source_size, target, epochs (whole passes over the source) and part
    (words taken in the last, fractional pass; less than size for one document of a source).

    The fractional pass takes documents by ascending key -ln(draw) / quality (Efraimidis and Spirakis' order) until the words
    left over from the whole passes are used up; the last one gives the words still needed. Only sums by source and piece of
    the key range are built for all rows; just the piece in which a source's budget ends is sorted."""
    rows = saved(rows.withColumn("key", -F.log("draw") / F.col("quality")))
    pieces = rows.count() // SORT_ROWS + 1
    piece = F.floor((1 - F.exp(-F.col("key"))) * pieces).cast("int")  # rises with the key, in pieces of some equal size
    sums = saved(rows.groupBy("source", piece.alias("piece")).agg(F.sum("size").alias("words")))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)).cast("long"))
    goals = saved(goals.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 1e-6).cast("long")))
    sums = sums.withColumnsRenamed({"source": "_source", "piece": "_piece"}).withColumn("_before", F.sum("words").over(W.partitionBy("_source").orderBy("_piece")) - F.col("words"))
    plan = saved(sums.join(F.broadcast(goals) if goals.count() <= 100_000 else goals, F.col("source").eqNullSafe(F.col("_source"))).drop("source"))
    p = small(plan)
    staged = rows.withColumn("piece", piece).join(p, F.col("source").eqNullSafe(F.col("_source")) & (F.col("piece") == F.col("_piece")))
    ends = (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("words") > F.col("rest"))
    inner = staged.where(ends)
    at = F.sum("size").over(W.partitionBy("source", "piece").orderBy("key", *order).rowsBetween(W.unboundedPreceding, -1))
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("_before") - F.coalesce(at, F.lit(0))))
    outer = staged.where(~ends).withColumn("part", F.when(F.col("_before") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(F.lit(0).cast("long")))
    both = inner.withColumn("part", part).unionByName(outer)
    return both.select(*[c for c in rows.columns if c not in ("key",)], "source_size", "target", "epochs", "part")


def _rows(docs: DataFrame, labels: DataFrame | None, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Quality: 1 for documents labelled as good, 0.5 for bad ones, 0.75 without a label; with several labels, the best."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.md5(F.col(text_col)).alias("text_md5"))
    rows = rows.withColumn("draw", uniform(F.col("doc_id"), F.lit("mix")))
    if labels is None:
        return rows.withColumn("quality", F.lit(0.75))
    best = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    rows = rows.join(best, F.col("doc_id") == F.col("_id"), "left")
    return rows.withColumn("quality", F.when(F.col("_q") == 1, 1.0).when(F.col("_q") == 0, 0.5).otherwise(0.75)).drop("_id", "_q")


def mix_sources(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target, taken (words in the mix, repeats counted), text_md5,
    epochs, part.

    taken = epochs * size + part. A source's taken words are its target, rounded down. Null texts have no words and are never
    taken; null is a source of its own; draws come from the document's id, so reruns agree, and rows alike in id and key are
    ordered by their text. labels: (doc_id, quality) or None. Other columns are ignored."""
    mixed = mix(_rows(docs, labels, id_col, text_col, source_col), ["doc_id", "text_md5"])
    taken = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(F.col("epochs") * F.col("size") + F.col("part"))
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "text_md5", "epochs", "part")


def mixture(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself, in the columns of `docs`, of whole documents: one row for each whole pass, and one more if the fractional
    pass takes half of the document's words or more. So of each source one document at most, that in which its target ends, has
    up to half its words more or less than `mix_sources` takes. Any column names will do."""
    verdicts = mix_sources(docs, labels, id_col, text_col, source_col)
    copies = F.col("epochs") + F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    verdicts = saved(verdicts.where("size > 0").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), copies.alias("_copies")).where("_copies > 0"))
    # Rows alike in id and text may differ in what the fractional pass takes; each of them is matched with one verdict.
    nth = F.row_number().over(W.partitionBy("_id", "_md5").orderBy(F.desc("_copies")))
    repeated = not verdicts.groupBy("_id", "_md5").count().where("count > 1").isEmpty()
    verdicts = verdicts.withColumn("_nth", nth if repeated else F.lit(1))
    rows, own_id, own_text = numbered(docs, id_col, text_col)
    keyed = rows.withColumn("_text_md5", F.md5(F.col(own_text)))
    same = F.row_number().over(W.partitionBy(own_id, "_text_md5").orderBy(F.lit(1)))
    keyed = keyed.withColumn("_row", same if repeated else F.lit(1))
    taken = keyed.join(small(verdicts), keyed[own_id].eqNullSafe(F.col("_id")) & keyed["_text_md5"].eqNullSafe(F.col("_md5")) & (F.col("_row") == F.col("_nth")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies").cast("long")))).select(*rows.columns).toDF(*docs.columns)
