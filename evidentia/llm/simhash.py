"""SimHash near-duplicates by an inverted index of byte positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import filed, numbered, released, short_batches, small
from evidentia.llm.ngram_join import components

WIDTH, DISTANCE, SEED = 3, 2, 42
BYTES = 8
#: Fingerprints that differ in so many bits at most share so many bytes at least.
LEAST_SHARED = BYTES - DISTANCE

#: Positions that together are the key of a posting. Two differing bytes leave one of three sets of positions whole, and one of
#: three parts of what is left: fingerprints that share six bytes meet under one of these keys.
KEYS = ((0, 1, 2, 3, 4), (0, 1, 2, 5, 6), (0, 1, 2, 7), (3, 4, 5, 0, 1), (3, 4, 5, 2, 6), (3, 4, 5, 7), (6, 7, 0, 1), (6, 7, 2, 3), (6, 7, 4, 5))

#: Longer postings are not paired: their fingerprints meet at points one bit away from them.
LONG = 64

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_STEP = 1 << 15


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The 64 bits that are set in over half the hashes of the shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    n = max(len(words) - width + 1, 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ends = starts[min(width, len(words)) :] - 1
    joined, of, counts = b" ".join(words), xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        spans = zip(starts[at : min(at + _STEP, n)].tolist(), ends[at : at + _STEP].tolist())
        hashes = np.array([of(joined[a:b], SEED) for a, b in spans], np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp as a signed long."""

    def run(batches):
        for batch in batches:
            column, out = batch.column("text"), []
            for at in range(0, len(column), 100):  # a hundred texts at a time beside the batch
                out += [fingerprint(t, width) for t in column.slice(at, 100).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows, own_id, own_text = numbered(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(F.col(own_id).alias("doc_id"), F.col(own_text).alias("text")).mapInArrow(released(run), f"doc_id {kind}, fp long")


def _mask(positions) -> int:
    """The bits of bytes, as a signed long."""
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def shared_bytes(a: Column, b: Column) -> Column:
    """How many positions have the same byte."""
    x = a.bitwiseXOR(b)
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(BYTES))


def links(prints: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b): edges between distinct fingerprints `prints` (fp) by which those at `DISTANCE` or fewer bits reach each other; all
    edges are such links.

    Each fingerprint stands in nine postings. In one of up to `long`, each pair's shared positional bytes are tallied; pairs with six
    are verified bit by bit. Pairs of a longer posting would grow with its square; there two fingerprints link when, and only when,
    some point is at one bit or none from both, so each is joined to the least one at each of its points outside the key."""
    keys = F.array(*[F.struct(F.lit(k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(p))).alias("key")) for k, p in enumerate(KEYS)])
    index = prints.select("fp", F.inline(keys))
    sizes = index.groupBy("slot", "key").agg(F.count("*").alias("size")).where("size > 1")
    postings = filed(index.join(sizes, ["slot", "key"]))
    short = postings.where(F.col("size") <= long)
    a, b = (short.select("slot", "key", F.col("fp").alias(x)) for x in "ab")
    tally, differ = shared_bytes(F.col("a"), F.col("b")), F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    on = (a["slot"] == b["slot"]) & (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (tally >= LEAST_SHARED) & (differ <= DISTANCE)
    pairs = a.join(b, on).select("a", "b")

    free = F.array(*[F.array(*[F.lit(8 * p + bit) for p in range(BYTES) if p not in own for bit in range(8)]) for own in KEYS])
    bits = F.concat(F.array(F.lit(-1)), F.element_at(free, F.col("slot") + 1))
    hot = postings.where(F.col("size") > long).select("fp", F.explode(bits).alias("bit")).distinct()
    points = hot.select("fp", F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("point", "a")
    stars = points.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).where(differ <= DISTANCE)
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", long: int = LONG) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable by links).

    Null and empty texts have no words and the fingerprint 0, which links like any other. Equal fingerprints are one from the
    start, however many documents have them. Null ids count for nothing unless a component has no other; repeated rows and ids are rows of
    their own; other columns, whatever their names, are left aside."""
    with short_batches(docs.sparkSession):
        facts = filed(fingerprints(docs, width, id_col, text_col))
    prints = filed(facts.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")))
    edges = filed(links(prints.select("fp"), long))
    found = components(edges).select(F.col("v").alias("fp"), "c")
    ids = filed(prints.join(found, "fp", "left").where("rows > 1 OR c IS NOT NULL").select("fp", "low", F.coalesce("c", "fp").alias("c")))
    lows = ids.groupBy("c").agg(F.min("low").alias("component_id"))
    named = filed(ids.join(lows, "c").select("fp", "component_id"))
    out = facts.join(small(named), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
