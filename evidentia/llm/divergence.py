"""How the sources of a language differ in their words, by tiles of groups over chunks of the vocabulary."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidentia.llm._common import filed, numbered, released, small

MIN_DOCS, TOP, SCALE, PRIOR = 10, 10, 1_000_000_000, 2

#: Groups of a block; terms of a chunk (about); chunks that one task goes through for a tile.
BLOCK, CHUNK, RUN = 16, 1 << 14, 8

#: Letters and all beyond ASCII, A to Z lower-cased; anything else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_PIECE, _HELD = 1 << 20, 200_000


def _pieces(data: bytes):
    """The terms of a text, some megabyte at a time."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split(b" ")
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of `docs` (lang, source, text): occurrences, and documents with the term. Each group also
    has a row with a null term. Texts are counted where they lie; one row for each group and term leaves a task, more only
    where a task sees more than `_HELD` of them."""

    def rows(held):
        for (lang, source), (n, docs) in held.items():
            terms = [t for t in n if t]
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), pa.array([*terms, None], pa.binary()).cast(pa.string()), [*(n[t] for t in terms), 0], [*(docs[t] for t in terms), 0]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "source", "term", "n", "docs"])

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for at in range(0, len(batch), 100):
                for row in batch.slice(at, 100).to_pylist():
                    n, docs = held.setdefault((row["lang"] or "", row["source"] or ""), (Counter(), Counter()))
                    size -= len(n)
                    seen = set()
                    for terms in _pieces((row["text"] or "").encode("utf-8", "surrogatepass").translate(_TERMS)):
                        n.update(terms)
                        seen.update(terms)
                    docs.update(seen)
                    size += len(n)
                    if size > _HELD:
                        yield from rows(held)
                        held, size = {}, 0
        yield from rows(held)

    found = docs.mapInArrow(released(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact at any size."""
    return f"1 + cast({SCALE} as decimal(10,0)) * cast({count} + {PRIOR} as decimal(20,0)) div cast({total} + {PRIOR} * {terms} as decimal(20,0))"


def shares(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same of many counts: long division by three digits a step, so nothing leaves 64 bits before 9e15 words of a group."""
    divisor = np.int64(total + PRIOR * terms)
    whole, rest = np.divmod(counts + np.int64(PRIOR), divisor)
    for _ in range(3):
        digits, rest = np.divmod(rest * np.int64(1000), divisor)
        whole = whole * np.int64(1000) + digits
    return whole + np.int64(1)


def tile(key: tuple, rows: pa.Table, block: int) -> pa.Table:
    """The pair submatrix of two blocks of groups over the successive chunks of a run: (lang, a, b, value, seen), where `seen` counts the
    terms that any group of the tile has."""
    low, high = key[1].as_py(), key[2].as_py()
    rows = rows.sort_by("chunk")
    chunk = rows.column("chunk").to_numpy()
    edges = [*np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)), len(chunk)]
    g, total, terms = (rows.column(c).to_numpy() for c in ("g", "total", "terms"))
    totals = dict(zip(g.tolist(), total.tolist()))
    groups = sorted(totals)
    place = {x: k for k, x in enumerate(groups)}
    left = [k for k, x in enumerate(groups) if x // block == low]
    right = np.array([k for k, x in enumerate(groups) if x // block == high], np.int64)
    sums, seen, vocabulary = np.zeros((len(groups), len(groups)), np.int64), 0, int(terms[0])
    for start, end in zip(edges[:-1], edges[1:]):
        packs = rows.slice(int(start), int(end - start)).column("pack").combine_chunks()
        packs = packs.chunk(0) if isinstance(packs, pa.ChunkedArray) else packs
        sizes = np.diff(packs.offsets.to_numpy())
        flat = packs.flatten()
        at, n = (flat.field(c).to_numpy() for c in ("at", "n"))
        used, column = np.unique(at, return_inverse=True)
        counts = np.zeros((len(groups), len(used)), np.int64)
        counts[np.repeat([place[x] for x in g[start:end].tolist()], sizes), column] = n
        p = np.stack([shares(counts[k], totals[x], vocabulary) for k, x in enumerate(groups)])
        seen += len(used)
        for k in left:
            other = right[right > k] if low == high else right
            d = p[other] - p[k]
            sums[k, other] += (d * d // (p[other] + p[k])).sum(axis=1)
    pairs = [(groups[k], groups[j], int(sums[k, j])) for k in left for j in right if low != high or j > k]
    columns = [[key[0].as_py()] * len(pairs), *([p[k] for p in pairs] for k in range(3)), [seen] * len(pairs)]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "a", "b", "value", "seen"])


def gap(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q))."""
    return f"({p} - {q}) * ({p} - {q}) div ({p} + {q})"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, chunk: int = CHUNK, run: int = RUN) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source of a language is from each other one (part `pair`, all ranks), and
    the terms that it has more of than the language (part `term`, ranks to 10).

    Null values are empty strings: such a language or source is one like others. Groups without terms count with no occurrences.
    Repeated rows count each; columns beyond the three, whatever their names, are left aside; an empty table gives no rows.
    A language's terms are dealt to chunks by hash. A group's counts in a chunk are one packed vector; each is replicated to the
    tiles of its block of groups with each other block, and a task computes a tile over the successive chunks of a run. Sums over
    runs are added by Spark. Terms that no group of a tile has count by their number.
    min_docs: documents of a language that a term needs; top: ranks of part `term`."""
    rows, lang, source, text = numbered(docs, lang_col, source_col, text_col)
    rows = rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts = filed(term_counts(rows))
    occurring = counts.where("term IS NOT NULL")
    kept = filed(occurring.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("in_lang")).where(F.col("docs") >= min_docs).drop("docs"))
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total")), "lang", "left")
    langs = filed(langs.na.fill(0).withColumn("chunks", F.greatest(F.lit(1), F.expr(f"(terms + {chunk - 1}) div {chunk}"))))
    dealt = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    terms = kept.join(small(langs), "lang").select("lang", "term", "in_lang", dealt)
    terms = terms.withColumn("at", (F.row_number().over(W.partitionBy("lang", "chunk").orderBy("term")) - 1).cast("int"))
    used = filed(occurring.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))

    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    g = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")  # a row for each group; pairs of them are returned
    groups = counts.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").na.fill(0, ["total"])
    groups = filed(groups.join(small(langs), "lang").select("*", g.alias("g"), F.count("*").over(W.partitionBy("lang")).alias("groups")))

    facts = used.join(small(groups.select("lang", "source", "total", "lang_total", "terms")), ["lang", "source"])
    facts = facts.withColumns({"p": F.expr(share("n", "total", "terms")), "q": F.expr(share("in_lang", "lang_total", "terms"))}).where("p > q")
    facts = facts.select("lang", "source", "chunk", F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))
    for keys in (["lang", "source", "chunk"], ["lang", "source"]):
        facts = facts.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)

    packs = used.join(small(groups.select("lang", "source", "g")), ["lang", "source"]).groupBy("lang", "g", "chunk").agg(F.collect_list(F.struct("at", "n")).alias("pack"))
    every = groups.select("lang", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(chunks - 1) div {run}"))).alias("run"))
    every = every.select("lang", "g", (F.col("run") * run).alias("chunk"), F.expr("cast(array() as array<struct<at:int,n:bigint>>)").alias("pack"))
    packs = packs.unionByName(every).join(small(groups.select("lang", "g", "total", "terms", "groups")), ["lang", "g"])
    own = F.expr(f"g div {block}")
    blocks = packs.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(groups - 1) div {block}"))))
    blocks = blocks.select("lang", F.least(own, "_o").alias("low"), F.greatest(own, "_o").alias("high"), F.expr(f"chunk div {run}").alias("run"), "chunk", "g", "total", "terms", "pack")
    tiles = blocks.groupBy("lang", "low", "high", "run").applyInArrow(lambda key, t: tile(key, t, block), "lang string, a long, b long, value long, seen long")
    sums = tiles.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    named = small(groups.select("lang", "g", "source", "total", "terms"))
    for x in "ab":
        sums = sums.join(named.select("lang", F.col("g").alias(x), F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), F.col("terms").alias(f"terms_{x}")), ["lang", x])
    bare = [f"({share('0', f'total_{x}', f'terms_{x}')})" for x in "ab"]
    value = F.when(F.col("terms_a") > 0, F.col("value") + (F.col("terms_a") - F.col("seen")) * F.expr(gap(*bare))).otherwise(0)
    sums = filed(sums.select("lang", "source_a", "source_b", value.alias("value")))
    pairs = sums.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), "value").union(sums.select("lang", "source_b", "source_a", "value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    part = lambda d, name: d.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").unionByName(part(facts, "term"))
