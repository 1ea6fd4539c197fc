"""Exact deduplication by content-defined chunk recipes (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm._common import keep_only, lower_az, saved, small

#: A chunk ends after "e " or a line end, 512 to 4096 characters after its start; the end of a text ends the last one.
CHUNK = r"(?s).{512,4094}?(?:e |\n)|.{1,4096}"

#: Ever longer identifiers of a chunk. The chunk itself, the last, needs no verification.
IDENTIFIERS = (
    lambda c: F.concat(F.hex(F.xxhash64(c)), F.lit("-"), F.octet_length(c)),
    lambda c: F.sha2(c, 256),
    lambda c: F.sha2(c, 512),
    lambda c: F.base64(F.encode(c, "UTF-8")),
)


def _verified(texts: DataFrame) -> Column:
    """The shortest kind of identifier by which no two chunks of `texts` (column t) are confused, as the recipe of t."""
    chunks = F.regexp_extract_all("t", F.lit(CHUNK), F.lit(0))
    for identify in IDENTIFIERS[:-1]:
        distinct = texts.select(F.explode(chunks).alias("c")).select(identify(F.col("c")).alias("i"), "c").distinct()
        if distinct.groupBy("i").count().where("count > 1").isEmpty():
            return F.array_join(F.transform(chunks, identify), ",")
    return F.array_join(F.transform(chunks, IDENTIFIERS[-1]), ",")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, text_md5 (of the text as it is).

    Texts are equal when identical after lower-casing A to Z; a null text counts as empty. Of equal texts the row with the
    largest doc_id stays (null ids are the smallest; of rows alike in id too, one stays). Any other columns are ignored.

    Lengths and 64-bit fingerprints, made where a document is read, tell which documents may have a copy. Only those are cut
    into chunks; chunks move once, collapsed before the shuffle, to verify that no identifier stands for two chunks. Then
    ordered lists of identifiers are compared instead of texts, so a long document moves as a few bytes for each chunk."""
    text = F.col(text_col)
    src = docs.select(F.col(id_col).alias("doc_id"), lower_az(F.coalesce(text, F.lit(""))).alias("t"), F.md5(text).alias("text_md5"))
    fingerprint = [F.xxhash64("t").alias("h"), F.octet_length("t").alias("n")]
    facts = saved(src.select("doc_id", "text_md5", *fingerprint, F.sha2("t", 256).alias("text_sha256")))
    suspects = saved(facts.groupBy("h", "n").count().where("count > 1").select("h", "n"))
    n = suspects.count()
    alone = facts.join(small(suspects, n), ["h", "n"], "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "text_md5"
    )
    if not n:
        return alone
    texts = src.select("*", *fingerprint).join(small(suspects, n), ["h", "n"], "left_semi")
    rows = saved(texts.select("doc_id", "text_md5", F.sha2("t", 256).alias("text_sha256"), _verified(texts).alias("recipe")))
    groups = saved(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    joined = rows.join(small(groups), "recipe")
    first = F.row_number().over(W.partitionBy("recipe", "doc_id").orderBy("text_md5")) == 1
    copies = joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = copies.where("kept").withColumn("kept", first)
    return alone.unionByName(kept.unionByName(copies.where("not kept")).select(*alone.columns))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_dedup` does not keep; all columns as they were."""
    verdicts = exact_dedup(docs, id_col, text_col).where("group_size > 1")
    by_row = verdicts.groupBy(F.col("doc_id").alias("id"), "text_md5").agg(F.count("*").alias("n"), F.max(F.col("kept").cast("int")).alias("stays"))
    return keep_only(docs, by_row.where("n > 1 or stays = 0"), id_col, text_col)
