"""Assignment of documents to shards by balanced label propagation."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm._common import saved, small

#: Rows that one task ranks.
RANK_ROWS = 50_000

#: Rounds in which no move is granted, each with its own draws, after which propagation ends.
QUIET = 3


def _fraction(*c: Column) -> Column:
    return F.pmod(F.xxhash64(*c), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _ask(wanted: dict, free: list[float], shards: int) -> dict:
    """The share of the moves wanted from shard i to j that is granted: swaps both ways first, then what is free in j."""
    granted = {ij: min(n, wanted.get(ij[::-1], 0)) for ij, n in wanted.items()}
    for j in range(shards):
        rest = {ij: n - granted[ij] for ij, n in wanted.items() if ij[1] == j}
        share = min(1.0, max(0.0, free[j]) / max(1, sum(rest.values())))
        for ij, n in rest.items():
            granted[ij] += n * share
    return {ij: granted[ij] / n for ij, n in wanted.items()}


def propagate(linked: DataFrame, shards: int, quota: float) -> DataFrame:
    """`linked` (link, seed, shard, ...) with new values of shard.

    In each round a document may move to the shard that holds the most of its neighbours (the rows with its link), of several
    such shards to one drawn by the link and the round, so that as many moves are wanted one way as the other. Groups beyond the
    quota move only to shards with room. Counts by link are aggregated before the shuffle and are one row a link, so a hot link
    costs no more than another; an `m x m` table of wanted moves is all that the driver reads. Moves are granted under `quota`:
    small groups move together, of groups beyond a tenth of the quota a share of the rows. Each move brings more of a group
    together; rounds end when `QUIET` of them, one after another, grant none."""
    k = quiet = 0
    while True:
        linked = saved(linked)
        held = dict(linked.groupBy("shard").count().collect())
        free = [quota - held.get(j, 0) for j in range(shards)]
        counts = linked.groupBy("link").agg(F.array(*[F.count_if(F.col("shard") == j) for j in range(shards)]).alias("near"), F.count("*").alias("group"))
        fits = [F.lit(True) if free[j] >= 1 else F.col("group") <= quota for j in range(shards)]
        room = F.array(*[F.struct(F.when(fits[j], F.col("near")[j]).otherwise(-1).alias("n"), _fraction(F.lit(k), F.lit(j), "link").alias("draw"), F.lit(j).alias("at")) for j in range(shards)])
        counts = saved(counts.select("link", "near", "group", F.array_max(room).alias("best")))
        better = (F.col("best.at") != F.col("shard")) & (F.col("best.n") >= F.col("near")[F.col("shard")])
        asked = saved(linked.join(small(counts), "link").withColumn("goal", F.when(better, F.col("best.at"))))
        wanted = {(i, j): n for i, j, n in asked.where("goal is not null").groupBy("shard", "goal").count().collect()}
        shares = _ask(wanted, free, shards)
        quiet = quiet + 1 if sum(shares[ij] * n for ij, n in wanted.items()) < 1 else 0
        if not wanted or quiet == QUIET:
            return linked
        grants = [F.when((F.col("shard") == i) & (F.col("goal") == j), F.lit(p)) for (i, j), p in shares.items()]
        who = F.when(F.col("group") > quota / 10, _fraction(F.lit(k), "link", "seed")).otherwise(_fraction(F.lit(k), "link"))
        linked = asked.withColumn("shard", F.when(who < F.coalesce(*grants, F.lit(0.0)), F.col("goal")).otherwise(F.col("shard"))).drop("near", "group", "best", "goal")
        k += 1


def assign_shards(rows: DataFrame, link: str, order: list[str], shards: int = 8) -> DataFrame:
    """`rows` with shard (0 to shards - 1) and slot (0, 1, ... within the shard).

    Rows with the same non-null `link` are linked; propagation brings them together. Counts of rows by shard differ by one at
    most: each shard keeps its linked rows first, up to its quota, and rows beyond the quota, whole groups next to
    each other, fill the shards with room. Ranks
    are taken within pieces of some 50,000 rows and shifted by the counts of the pieces before, so no shard is sorted by one
    task. `order` makes the result the same in every run; rows alike in it may trade places, nothing else."""
    base = rows.withColumn("link", F.col(link)).withColumn("seed", F.xxhash64(*order)).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), *order), F.lit(shards)).cast("int"))
    base = saved(base)
    total = base.count()
    groups = saved(base.where("link is not null").groupBy("link").count().where("count > 1").select("link", F.col("count").alias("mates")))
    mate = F.when(F.col("mates") > RANK_ROWS // 10, F.col("seed")).otherwise(F.xxhash64("link"))
    linked = base.join(small(groups), "link").withColumn("mate", mate).drop("mates")
    parts = [base.join(small(groups), "link", "left_anti").withColumn("mate", F.col("seed")).withColumn("alone", F.lit(1))]
    parts.append(propagate(linked, shards, total / shards).select(*base.columns, "mate").withColumn("alone", F.lit(0)))
    all_rows = parts[0].unionByName(parts[1]).withColumn("piece", F.pmod(F.col("mate"), F.lit(total // (shards * RANK_ROWS) + 1)))
    all_rows = saved(all_rows)
    pieces = all_rows.groupBy("shard", "alone", "piece").count()
    before = W.partitionBy("shard").orderBy("alone", "piece")
    pieces = saved(pieces.withColumn("before", F.sum("count").over(before) - F.col("count")))
    held = dict(pieces.groupBy("shard").agg(F.sum("count")).collect())
    quota = [total // shards + (j < total % shards) for j in range(shards)]
    load = [held.get(j, 0) for j in range(shards)]
    over = [0, *accumulate(max(0, n - q) for n, q in zip(load, quota))]
    room = [0, *accumulate(max(0, q - n) for n, q in zip(load, quota))]
    at = lambda values: F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col("shard") + 1)
    rank = F.row_number().over(W.partitionBy("shard", "alone", "piece").orderBy(F.when(F.col("alone") == 0, F.col("mate")), *order)) - 1 + F.col("before")
    ranked = all_rows.join(small(pieces), ["shard", "alone", "piece"]).withColumn("rank", rank)
    ranked = ranked.withColumn("extra", F.when(F.col("rank") >= at(quota), F.col("rank") - at(quota) + at(over)))
    moved = [F.when((F.col("extra") >= room[j]) & (F.col("extra") < room[j + 1]), F.struct(F.lit(j).alias("shard"), (F.col("extra") - room[j] + load[j]).alias("slot"))) for j in range(shards)]
    place = F.coalesce(*moved, F.struct(F.col("shard"), F.col("rank").alias("slot")))
    return ranked.withColumn("place", place).select(*rows.columns, F.col("place.shard").cast("int").alias("shard"), F.col("place.slot").cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes plus 1), text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Documents of equal text are linked. A null text has size 1, the checksum of the empty text and no link; documents alike in
    id and text are alike in all but the slot. Other columns are ignored; an empty table gives an empty result."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.md5(text).alias("text_md5"))
    placed = assign_shards(rows, "text_md5", ["doc_id", "text_md5"], shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
