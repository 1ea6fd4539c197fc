"""N-gram Jaccard join by grouped prefixes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm import _numeric
from evidentia.llm._common import filed, keep_only, released, saved, small

WIDTH, PERCENT = 4, 85

#: Counters of the frequency sketch (a power of two); it is the one thing broadcast, as a byte a counter.
SKETCH_BITS = 22
_PARTS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _texts(batch):
    """A batch's texts, some hundred at a time."""
    column = batch.column("text")
    for at in range(0, len(column), 200):
        yield from (t or "" for t in column.slice(at, 200).to_pylist())


def _groups(texts, limit: int = 250_000):
    """The texts' bytes in lower case, in lists of some `limit` bytes, of one text at least."""
    part, total = [], 0
    for t in texts:
        part.append(t.encode("utf-8", "surrogatepass").translate(_LOWER))
        total += len(part[-1])
        if total >= limit:
            yield part
            part, total = [], 0
    if part:
        yield part


def shingle_sets(texts, width: int):
    """The sorted distinct 64-bit hashes of each text's shingles, in turn."""
    roller = _numeric.Roller()
    keys = _numeric.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for part in _groups(texts):
        data = np.frombuffer(b"\n" + b"\n".join(part) + b"\n", np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = edges[::2], edges[1::2]
        words = roller.hashes(roller.sums(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(starts, np.cumsum([0, *[len(x) + 1 for x in part]]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = min(width, b - a)
            own = words[a:b]
            # A text of fewer words is one shingle, told from longer ones by its number of words.
            mixed = sum((own[k : len(own) - n + 1 + k] * keys[k] for k in range(n)), np.uint64(width - n)) if n else own
            yield np.unique(_numeric.mix(mixed)) if n else own


def _needed(n: int, percent: int) -> int:
    return (percent * n + 99) // 100


def frequency_levels(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    """For each counter of the sketch 0, or more for shingles that far more documents hold than a usual counter shows.

    A task counts its documents' shingles in 2^22 counters and gives them away in 64 parts, deflated; parts are summed some hundred at
    a time. The levels decide how fast the join is, not what it finds."""
    size = 1 << SKETCH_BITS

    def count(batches):
        counts = np.zeros(size, np.uint32)
        for batch in batches:
            for hashes in shingle_sets(_texts(batch), width):
                np.add.at(counts, hashes >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
        parts = np.minimum(counts, 65535).astype(np.uint16).reshape(_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts], pa.binary())], ["part", "counts"])

    def add(kind):
        def run(key, rows):
            total = sum(np.frombuffer(zlib.decompress(x), kind).astype(np.uint64) for x in rows.column("counts").to_pylist())
            return pa.table({"part": [key[0].as_py()], "counts": [zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)]})

        return run

    schema = pa.schema([("part", pa.int32()), ("counts", pa.binary())])
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(released(count), "part int, counts binary")
    few = rows.groupBy("part", F.expr("spark_partition_id() div 100").alias("hundred")).applyInArrow(lambda k, t: add(np.uint16)(k, t).cast(schema), "part int, counts binary")
    whole = few.groupBy("part").applyInArrow(lambda k, t: add(np.uint32)(k, t).cast(schema), "part int, counts binary")
    counts = np.zeros((_PARTS, size // _PARTS), np.float64)
    for part, x in whole.collect():  # 16 MB before deflation, whatever the corpus
        counts[part] = np.frombuffer(zlib.decompress(x), np.uint32)
    usual = counts.mean() + 6 * np.sqrt(counts.mean()) + 1
    return np.maximum(0, np.ceil(np.log2(np.maximum(counts.ravel(), 1) / usual))).astype(np.uint8)


def signatures(docs: DataFrame, levels: np.ndarray, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_md5, n, fp, gid, usual, prefix): the number of shingles, digests of the set and of prefix and size, the sum
    of the prefix's levels, and the prefix: shingles by level and hash, so many that two sets similar enough share one."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches):
        for batch in batches:
            n, fp, gid, usual, prefixes = [], [], [], [], []
            for s in shingle_sets(_texts(batch), width):
                level = shared.value[s >> np.uint64(64 - SKETCH_BITS)]
                ordered = s[np.argsort(level, kind="stable")] if level.any() else s
                p = ordered[: len(s) - _needed(len(s), percent) + 1] if len(s) else s
                usual.append(int(np.sort(level)[: len(p)].sum()))
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                gid.append(hashlib.blake2b(p.tobytes() + len(s).to_bytes(8, "big"), digest_size=16).digest() if len(s) else None)
                prefixes.append(p.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            made = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(gid, pa.binary()), pa.array(usual, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), *made], ["doc_id", "text_md5", "n", "fp", "gid", "usual", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_col).alias("text_md5"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {kind}, text_md5 string, n long, fp binary, gid binary, usual int, prefix array<long>")


def _sizes(a, b, percent: int):
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _common(a, b, percent: int):
    """How many shingles sets of sizes a and b must share to link."""
    return F.ceil(F.lit(percent) * (a + b) / float(100 + percent) - 1e-9)


def verified(pairs: DataFrame, facts: DataFrame, docs: DataFrame, width: int, percent: int, text_col: str) -> DataFrame:
    """The pairs (a, b) of digests in `facts` (fp, n, prefix, text_md5) that link.

    Prefixes come first: common shingles not in both prefixes lie behind one of them. Of what is left the whole sets are made
    again, one for each set that occurs, and intersected."""
    ends = saved(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    sets = saved(facts.join(small(ends), "fp").groupBy("fp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("text_md5").alias("text_md5")))
    left, right = (sets.select(F.col("fp").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "ab")
    need = _common(F.col("na"), F.col("nb"), percent)
    rest = F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    likely = pairs.join(left, "a").join(right, "b").where(_sizes(F.col("na"), F.col("nb"), percent)).where(F.size(F.array_intersect("pa", "pb")) + rest >= need).select("a", "b", "na", "nb")
    likely = saved(likely)
    wanted = saved(likely.select(F.col("a").alias("fp")).union(likely.select("b")).distinct().join(sets.select("fp", "text_md5"), "fp"))

    def make(batches):
        for batch in batches:
            made = [s.view(np.int64) for s in shingle_sets(_texts(batch), width)]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *made])))
            yield pa.RecordBatch.from_arrays([batch.column("fp"), lists], ["fp", "shingles"])

    texts = docs.select(F.md5(text_col).alias("text_md5"), F.col(text_col).alias("text")).join(small(wanted), "text_md5").select("fp", "text")
    # Not saved: both joins read one exchange by fp.
    whole = texts.mapInArrow(released(make), "fp binary, shingles array<long>").dropDuplicates(["fp"])
    a, b = (whole.select(F.col("fp").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    return likely.join(a, "a").join(b, "b").where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for each end of `edges` (a, b): the least v that it reaches. Labels pass along edges and then to the label's own
    label, till nothing changes; each round is saved."""
    both = filed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = filed(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("c")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        passed = labels.join(near, "v").select("v", "c", F.least("c", "m").alias("m"))
        jump = labels.select(F.col("v").alias("m"), F.col("c").alias("j"))
        new = filed(passed.join(jump, "m", "left").select("v", "c", F.least("m", F.coalesce("j", "m")).alias("m")))
        if new.where("m < c").isEmpty():
            return labels
        labels = new.select("v", F.col("m").alias("c"))


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `signatures`, and (fp, c) for each set that occurs: the least fp of its component, whatever the ids are.

    Equal sets are one from the start, and sets of equal prefix and size are one group for candidate search. Every
    pair that a shared prefix shingle suggests is either verified or already connected:
    1. In the postings of a shingle, sorted by size, groups next to each other tell whether any sizes there fit. Groups that
       have such a neighbour vote, in each posting, for the one of their size class whose prefix has the most usual shingles, as a
       text without edits has (which votes for that of the class before). Each set is compared with the group it gave most votes, and with its own group's first: two pairs a set
       at most, however large a group of copies.
    2. Pairs of sets that still lie in different components are compared in full if they share a shingle so early in both
       prefixes that enough of both can follow it.
    The sketch puts shingles that many documents hold behind the others, so they are in a prefix only if little else is."""
    levels = frequency_levels(docs, width, text_col)
    facts = saved(signatures(docs, levels, width, percent, id_col, text_col))
    filled = facts.where("n > 0")
    # A group goes by a 64-bit key; should two groups have one key, both are looked at.
    members = saved(filled.select(F.xxhash64("gid").alias("key"), "fp").distinct())
    groups = filled.groupBy("gid").agg((F.min("fp") != F.max("fp")).alias("many"), F.first("n").alias("n"), F.first("usual").alias("usual"), F.first("prefix").alias("prefix"))
    heads = saved(members.groupBy("key").agg(F.min("fp").alias("first")))
    # least() and greatest() pass over nulls: without a neighbour the comparison alone would hold.
    fits = lambda other: other.isNotNull() & _sizes(F.col("n"), other, percent)
    # One shuffle, by shingle, serves all windows.
    postings = groups.select(F.xxhash64("gid").alias("key"), "many", "usual", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token")).repartition("token")
    postings = postings.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int"))
    run = W.partitionBy("token").orderBy("class", "n", "key")
    postings = postings.withColumn("leader", F.min(F.struct(-F.col("usual"), "key")).over(W.partitionBy("token", "class"))["key"]).withColumns({"before": F.lag("leader").over(run), "beside": fits(F.lag("n").over(run)) | fits(F.lead("n").over(run)) | F.col("many")})
    postings = saved(postings.where("beside").select("token", "n", "at", "key", "leader", "before"))
    stars = postings.where("key != leader").select("leader", "key").union(postings.where("before != leader").select("before", "leader"))
    votes = stars.groupBy("key", "leader").count()
    best = votes.groupBy("key").agg(F.max_by("leader", F.struct("count", "leader")).alias("leader"))
    one = heads.select(F.col("key").alias("leader"), F.col("first").alias("a"))
    pairs = best.join(one, "leader").join(members, "key").select("a", F.col("fp").alias("b"))
    inside = heads.join(members, "key").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    ordered = lambda p: p.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = saved(ordered(pairs.union(inside)))
    edges = saved(verified(pairs, filled, docs, width, percent, text_col))
    found = saved(members.select("fp").distinct().join(components(edges).withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("c", "fp").alias("c")))

    # What is not yet connected: postings whose sets lie in different components.
    placed = saved(members.join(found, "fp").select("key", "fp", F.xxhash64("c").alias("c")))
    parts = saved(placed.select("key", "c").distinct())
    each = W.partitionBy("token")
    left = postings.select("token", "n", "at", "key").join(small(parts), "key").withColumns({"low": F.min("c").over(each), "high": F.max("c").over(each)})
    left = saved(left.where("low != high").select("token", "n", "at", "key", "c"))
    l, r = (left.select("token", *[F.col(x).alias(x + side) for x in ("n", "at", "key", "c")]) for side in "lr")
    # The first shingle that two linking sets share has enough of either set from its place on; all that follows is behind it.
    need = _common(F.col("nl"), F.col("nr"), percent)
    early = (F.col("nl") - F.col("atl") >= need) & (F.col("nr") - F.col("atr") >= need)
    more = l.join(r, "token").where("cl < cr").where(_sizes(F.col("nl"), F.col("nr"), percent)).where(early).select("keyl", "cl", "keyr", "cr").distinct()
    for x, side in zip("ab", "lr"):
        more = more.join(placed.select(F.col("key").alias("key" + side), F.col("c").alias("c" + side), F.col("fp").alias(x)), ["key" + side, "c" + side])
    more = saved(ordered(more).join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        extra = saved(verified(more, filled, docs, width, percent, text_col))
        if not extra.isEmpty():
            # However many pairs link two components, one edge joins them.
            for x in "ab":
                extra = extra.join(found.select(F.col("fp").alias(x), F.col("c").alias("c" + x)), x)
            wider = components(saved(extra.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()))
            found = saved(found.join(wider.select(F.col("v").alias("c"), F.col("c").alias("wider")), "c", "left").select("fp", F.coalesce("wider", "c").alias("c")))
    return facts, found


def ngram_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_md5.

    Documents without words, and null texts, have no shingle and are components of their own; null ids count for nothing unless
    a component has no other. component_id is the least id, which components may share where ids are null or repeated."""
    facts, found = _linked(docs, width, percent, id_col, text_col)
    ids = facts.groupBy("fp").agg(F.min("doc_id").alias("low")).join(found, "fp").select("fp", "low", "c")
    ids = saved(ids.where("fp is not null"))
    lows = ids.groupBy("c").agg(F.min("low").alias("component_id"))
    named = saved(ids.join(lows, "c").select("fp", "component_id"))
    return facts.select("doc_id", "text_md5", "n", "fp").join(small(named), "fp", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "text_md5"
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, that of the least id; documents without shingles stay. If no id of a
    component is known, or two of its rows share the least one, the row whose text has the least digest stays. Components
    are told apart by their sets, not by ids."""
    facts, found = _linked(docs, width, percent, id_col, text_col)
    rows = saved(facts.where("n > 0").join(small(found), "fp").select("doc_id", "text_md5", "c"))
    heads = rows.groupBy("c").agg(F.count("*").alias("rows"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_md5")).alias("head")).where("rows > 1")
    rows = rows.join(heads, "c")
    stays = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_md5") == F.col("head.text_md5"))
    by_row = rows.withColumn("stays", stays.cast("int")).groupBy(F.col("doc_id").alias("id"), "text_md5").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    return keep_only(docs, by_row.where("n > 1 or stays = 0"), id_col, text_col)
