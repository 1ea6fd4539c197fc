"""Removal of repeated byte strings by suffix arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm import _numeric
from evidentia.llm._common import filed, light, release, saved, short_batches, small

LENGTH = 200
#: Bytes of the gram whose hash anchors a window.
GRAM = 32
#: Bits of the filter of sides that occur twice; a full filter costs time, not results.
FILTER_BITS = 26
#: Bits of a side's hash that are counted.
SIDE_BITS = 40
_PARTS = 64
#: Stretches of a piece, on average (a power of two).
PIECE = 4
#: Bytes of stretches that one suffix array holds, and different stretches of one anchor beyond which they are dealt to several.
SHARD_BYTES, HOT = 6_000_000, 20_000


def _sliding_min_last(x: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the place of its least value (by the leading 40 bits), the last one of equals."""
    low = np.uint64((1 << 24) - 1)
    least = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))  # blocks are shorter than 2^24
    span = 1
    while 2 * span <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: span - w], least[w - span :])
    return (low - (least & low)).astype(np.int64)


def stretches(text: bytes, roller: _numeric.Roller, length: int, block: int = _numeric.BLOCK):
    """(anchor's hash, start, windows, hash to the left, hash to the right, anchor's place) of a text's stretches, in order.

    A window of `length` bytes is anchored by the gram in it with the least hash, the last of equals: equal windows have equal
    anchors at equal places. A stretch is the run of windows with one anchor; each window is in one stretch (in two, where a
    block ends). Of the bytes that a window has besides its anchor, half lie on one side at least. So of two equal windows the
    anchors have either this many equal bytes before them or as many after them: the hashes of anchor and side, 0 where the text
    ends before."""
    out = tuple([np.zeros(0, kind)] for kind in (np.uint64, np.int64, np.int64, np.uint64, np.uint64, np.int64))
    gram = min(GRAM, length)
    side = (length - gram + 1) // 2
    for at in range(0, max(0, len(text) - length + 1), block):
        base = max(0, at - side)
        data = np.frombuffer(text[base : at + block + length - 1 + side], np.uint8)
        sums = roller.sums(data)
        places = np.arange(at - base, min(at + block + length - 1, len(text)) - gram - base + 1)
        hashes = roller.hashes(sums, places, places + gram)
        anchors = _sliding_min_last(hashes, length - gram + 1)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        place = places[anchors[first]]
        before, after = place >= side, place + gram + side <= len(data)
        left, right = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        left[before] = roller.hashes(sums, place[before] - side, place[before] + gram)
        # Told from those to the left: a stretch's right side may be the left side of another one.
        right[after] = _numeric.mix(roller.hashes(sums, place[after], place[after] + gram + side))
        for column, values in zip(out, (hashes[anchors[first]], first + at, np.diff(np.append(first, len(anchors))), left, right, place + base)):
            column.append(values)
    return tuple(map(np.concatenate, out))


def walk(texts: list[bytes], roller: _numeric.Roller, length: int, block: int = 60_000):
    """`stretches` of each text. Texts of some `block` bytes are walked as one buffer; longer ones for themselves, in blocks."""
    gram = min(GRAM, length)
    side = (length - gram + 1) // 2
    for _, group in _numeric.blocks(texts, block):
        lens = np.array(list(map(len, group)), np.int64)
        if len(group) == 1 or lens.max() > block or lens.sum() < length:
            yield from (stretches(t, roller, length) for t in group)
            continue
        data = np.frombuffer(b"".join(group), np.uint8)
        ends = np.cumsum(lens)
        begins = ends - lens
        sums = roller.sums(data)
        places = np.arange(len(data) - gram + 1)
        hashes = roller.hashes(sums, places, places + gram)
        anchors = _sliding_min_last(hashes, length - gram + 1)
        own = np.repeat(np.arange(len(group)), lens)[: len(anchors)]
        inside = np.flatnonzero(np.arange(len(anchors)) + length <= ends[own])  # windows that no text's end cuts
        anchors, own = anchors[inside], own[inside]
        first = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])])[: len(inside)])
        place, start, own = anchors[first], inside[first], own[first]
        before, after = place - side >= begins[own], place + gram + side <= ends[own]
        left, right = np.zeros(len(place), np.uint64), np.zeros(len(place), np.uint64)
        left[before] = roller.hashes(sums, place[before] - side, place[before] + gram)
        right[after] = _numeric.mix(roller.hashes(sums, place[after], place[after] + gram + side))
        columns = (hashes[place], start - begins[own], np.diff(np.append(first, len(inside))), left, right, place - begins[own])
        cuts = np.searchsorted(own, np.arange(len(group) + 1)).tolist()
        yield from (tuple(c[i:j] for c in columns) for i, j in zip(cuts, cuts[1:]))


def suffix_array(data: np.ndarray, upto: int) -> np.ndarray:
    """The order of the suffixes of `data` by their first `upto` values (Larsson and Sadakane's refinement).

    A first sort is by as many values as fit one number. Ranks by the first h values give those by 2h: members of a group of
    equals are sorted by the rank h places on. Groups of one are done and take no further part."""
    n = len(data)
    wide = int(data.max(initial=0)) + 2
    h = max(1, min(4, int(62 / np.log2(wide))))  # values that fit one number
    first = np.zeros(n, np.int64)
    for k in range(h):
        first *= wide
        first[: max(n - k, 0)] += data[k:] + 1
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of its group's first
    while h < upto:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        todo = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(todo):
            break
        members = order[todo]
        nexts = rank[np.minimum(members + h, n)] + 1
        key = rank[members] * (n + 2) + nexts
        by = np.argsort(key)
        order[todo] = members[by]
        key = key[by]
        split = np.concatenate([[True], key[1:] != key[:-1]])
        new[todo] = split
        rank[members[by]] = todo[np.flatnonzero(split)[np.cumsum(split) - 1]]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, starts: np.ndarray, ends: np.ndarray, upto: int) -> np.ndarray:
    """How many values each place's suffix shares with the one before it in `order`, up to `upto` (Kasai's method).

    The next place of a stretch shares one less at least than the place before; all stretches are walked side by side."""
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    out = np.zeros(n, np.int64)
    at, h = starts.copy(), np.zeros(len(starts), np.int64)
    live = np.flatnonzero(at < ends)
    while len(live):
        i = at[live]
        before = place[i]
        j = order[np.maximum(before - 1, 0)]
        k = np.where(before > 0, h[live], 0)
        grow = np.flatnonzero((before > 0) & (k < upto))
        while len(grow):
            a, b = i[grow] + k[grow], j[grow] + k[grow]
            same = (a < n) & (b < n)
            same[same] = data[a[same]] == data[b[same]]
            k[grow[same]] += 1
            grow = grow[same]
            grow = grow[k[grow] < upto]
        out[i] = k
        h[live] = np.maximum(k - 1, 0)
        at[live] += 1
        live = live[at[live] < ends[live]]
    return out


class Shard:
    """A suffix array over stretches, each closed by a value of its own so that no match runs over its end."""

    def __init__(self, texts: list[bytes], length: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.empty(int(sizes.sum()) + len(texts), np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.ends = self.starts + sizes
        mask = np.ones(len(self.data), bool)
        mask[self.ends] = False
        self.data[mask] = np.frombuffer(b"".join(texts), np.uint8)
        self.data[self.ends] = 256 + np.arange(len(texts))
        # Sorted in full, as Kasai's method needs.
        self.order = suffix_array(self.data, int(sizes.max(initial=0)) + 1)

    def repeated(self) -> np.ndarray:
        """Whether the window at each place occurs at another place too."""
        lcp = common_prefixes(self.data, self.order, self.starts, self.ends, self.length)
        along = lcp[self.order] >= self.length
        out = np.zeros(len(self.data), bool)
        out[self.order] = along | np.append(along[1:], False)
        return out

    def windows(self) -> np.ndarray:
        """The places where windows start, in the order of the suffixes."""
        room = np.repeat(self.ends, self.ends - self.starts + 1) - np.arange(len(self.data))
        return self.order[room[self.order] >= self.length]

    def _bytes(self, places: np.ndarray, at: int) -> np.ndarray:
        """Eight values from `at` on of the windows at `places`, as numbers in the same order."""
        out = np.zeros(len(places), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | (self.data[places + at + k].astype(np.uint64) if at + k < self.length else np.uint64(0))
        return out

    def find(self, other: "Shard") -> tuple[np.ndarray, np.ndarray]:
        """By binary search: which windows of this shard occur in the other, and which of the other here."""
        mine, theirs = self.windows(), other.windows()
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(mine), np.int64)

        def compare(probe: np.ndarray, which: np.ndarray) -> np.ndarray:
            sign = np.zeros(len(which), np.int8)
            left = np.arange(len(which))
            for at in range(0, self.length, 8):
                a, b = self._bytes(probe[left], at), other._bytes(theirs[which[left]], at)
                sign[left] = (a > b).astype(np.int8) - (a < b).astype(np.int8)
                left = left[a == b]
                if not len(left):
                    break
            return sign

        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) // 2
            less = compare(mine[middle], live) < 0
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        inside = np.flatnonzero(low < len(mine))
        hit = inside[compare(mine[low[inside]], inside) == 0]
        there, here = np.zeros(len(other.data), bool), np.zeros(len(self.data), bool)
        there[theirs[hit]] = True
        if len(mine):
            # Equal windows follow one another from the first, which the search has found.
            same = np.zeros(len(mine), bool)
            same[low[hit]] = True
            equal = np.ones(len(mine), bool)
            for at in range(0, self.length, 8):
                v = self._bytes(mine, at)
                equal[1:] &= v[1:] == v[:-1]
            equal[0] = False
            head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(mine))))
            here[mine[same[head]]] = True
        return here, there


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sides(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """(side, n): the leading bits of the hashes of anchors with one side, and how many stretches have them."""

    def run(batches):
        roller = _numeric.Roller()
        for batch in batches:
            copies = Counter(batch.column(0).to_pylist())  # equal texts of a batch are walked once
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in copies]
            sides = [np.concatenate(s[3:5]) >> np.uint64(64 - SIDE_BITS) for s in walk(texts, roller, length)]
            values, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sides]), return_inverse=True)
            n = np.bincount(at, np.repeat(list(copies.values()), list(map(len, sides))), len(values))
            known = values > 0
            yield pa.RecordBatch.from_arrays([pa.array(values[known].view(np.int64)), pa.array(n[known].astype(np.int64))], ["side", "n"])
        release()

    return docs.select(text_col).mapInArrow(run, "side long, n long").groupBy("side").agg(F.sum("n").alias("n"))


def _filter(twice: DataFrame) -> np.ndarray:
    """A bitmap (8 MB, whatever the corpus) of the sides' leading bits."""
    size = 1 << FILTER_BITS
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def mark(batches):
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[batch.column("side").to_numpy().view(np.uint64) >> np.uint64(SIDE_BITS - FILTER_BITS)] = True
        packed = np.packbits(bits).reshape(_PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in packed], pa.binary())], schema.names)

    def merge(key, table):
        rows = [zlib.decompress(x) for x in table.column("bits").to_pylist()]
        out = np.frombuffer(rows[0], np.uint8).copy()
        for x in rows[1:]:
            out |= np.frombuffer(x, np.uint8)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], schema=schema)

    rows = twice.select("side").mapInArrow(mark, "part int, bits binary")
    few = rows.groupBy("part", F.expr("spark_partition_id() div 100").alias("hundred")).applyInArrow(merge, "part int, bits binary")
    bits = np.zeros((_PARTS, size // _PARTS // 8), np.uint8)
    for k, x in few.groupBy("part").applyInArrow(merge, "part int, bits binary").collect():
        bits[k] = np.frombuffer(zlib.decompress(x), np.uint8)
    return bits.ravel()


def _flagged(texts: list[bytes], roller: _numeric.Roller, bits: np.ndarray, length: int):
    """(grams, starts, windows, whether a side may occur twice, first and end of the windows whose side may) of each text's
    stretches."""
    shift = np.uint64(64 - FILTER_BITS)
    reach = (length - min(GRAM, length) + 1) // 2
    for grams, starts, windows, *sides, places in walk(texts, roller, length):
        left, right = (((bits[slot >> np.uint64(3)] >> (np.uint64(7) - (slot & np.uint64(7))).astype(np.uint8)) & 1).astype(bool) & (side > 0) for side in sides for slot in [side >> shift])
        # Windows up to `reach` before the anchor hold its left side whole, those from there on its right side.
        low = np.where(left, starts, np.maximum(starts, places - reach))
        high = np.where(right, starts + windows, np.minimum(starts + windows, places - reach + 1))
        yield grams, starts, windows, (left | right) & (low < high), low, high


def _piece_rows(docs: DataFrame, bits, length: int) -> DataFrame:
    """(piece, n, text_md5, starts, windows) of the pieces with a stretch of which a side may occur twice, once for each batch
    and text. A piece is a run of stretches; where it ends is told from the next one's anchor alone. piece: a digest of its
    windows' bytes; n: how often it stands there."""

    def run(batches):
        roller = _numeric.Roller()
        for batch in batches:
            rows = []
            copied = Counter(zip(batch.column("text_md5").to_pylist(), batch.column("text").to_pylist()))
            texts = [text.encode("utf-8", "surrogatepass") for _, text in copied]
            for (md5, _), copies, text, (grams, starts, windows, maybe, *_) in zip(copied, copied.values(), texts, _flagged(texts, roller, bits.value, length)):
                if not maybe.any():
                    continue
                first = _piece_starts(grams, starts, windows)
                ends = starts[np.append(first[1:], len(starts)) - 1] + windows[np.append(first[1:], len(starts)) - 1]
                alive = np.logical_or.reduceat(maybe, first)
                own = {}
                for s, e in zip(starts[first[alive]].tolist(), ends[alive].tolist()):
                    own.setdefault(hashlib.blake2b(text[s : e + length - 1], digest_size=16).digest(), (e - s, []))[1].append(s)
                rows += [(i, copies * len(at), md5, at, n) for i, (n, at) in own.items()]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["piece", "n", "text_md5", "starts", "windows"])
        release()

    return docs.mapInArrow(run, "piece binary, n long, text_md5 binary, starts array<int>, windows int")


def _piece_starts(grams: np.ndarray, starts: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The stretches that a piece begins with."""
    ends = (_numeric.mix(grams) & np.uint64(PIECE - 1)) == 0
    ends[0] = True
    ends[1:] |= starts[1:] != starts[:-1] + windows[:-1]
    return np.flatnonzero(ends)


def _stretch_rows(texts: DataFrame, bits, length: int) -> DataFrame:
    """(gram, id, n, windows, text, text_md5, starts) of the stretches, cut to the windows with a side that may occur twice, in the given
    pieces of texts (text_md5, text, pieces). Whether a window stays is told from its own bytes. id: a digest of gram and text; n: how often it stands in the batch. A stretch of a piece that
    stands once has a row for each text with the places where it starts; of the others, no place is asked for, and they have
    two rows' weight."""

    def run(batches):
        roller = _numeric.Roller()
        for batch in batches:
            kept = {}
            # Of equal texts one will do: every piece stands more than once.
            own = {md5: (text.encode("utf-8", "surrogatepass"), k) for k, (md5, text) in enumerate(zip(batch.column("text_md5").to_pylist(), batch.column("text").to_pylist()))}
            texts, asked = [text for text, _ in own.values()], batch.column("pieces")
            for (md5, (text, k)), (grams, starts, _, maybe, low, high) in zip(own.items(), _flagged(texts, roller, bits.value, length)):
                pieces = asked[k].as_py()
                lows = np.array([p["start"] for p in pieces], np.int64)
                by = np.argsort(lows)
                lows, highs = lows[by], lows[by] + np.array([p["windows"] for p in pieces], np.int64)[by]
                once = np.array([p["once"] for p in pieces], bool)[by]
                at = np.searchsorted(lows, starts, "right") - 1
                found = np.flatnonzero(maybe & (at >= 0) & (starts < highs[np.maximum(at, 0)]))
                for g, s, e, alone in zip(grams[found].tolist(), low[found].tolist(), high[found].tolist(), once[at[found]].tolist()):
                    part = text[s : e + length - 1]
                    i = hashlib.blake2b(part, digest_size=16, key=g.to_bytes(8, "big")).digest()
                    row = kept.setdefault((i, md5 if alone else None), [g - (1 << 64) if g >> 63 else g, 0, part, []])
                    row[1] += 1 if alone else 2
                    if alone:
                        row[3].append(s)
            sent, out = set(), []
            for (i, md5), (g, n, part, at) in kept.items():
                out.append((g, i, n, len(part) - length + 1, None if i in sent else part, md5, at))  # its bytes once a batch
                sent.add(i)
            columns = list(zip(*out)) or [[]] * 7
            kinds = [("gram", pa.int64()), ("id", pa.binary()), ("n", pa.int64()), ("windows", pa.int32()), ("text", pa.binary()), ("text_md5", pa.binary()), ("starts", pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], [k for k, _ in kinds])
        release()

    return texts.mapInArrow(run, "gram long, id binary, n long, windows int, text binary, text_md5 binary, starts array<int>")


def _without_lone(stretched: DataFrame, shared: DataFrame) -> DataFrame:
    """(gram, id, n, windows, text), with a null text where the anchor, by a bitmap of the shared ones, has one stretch only:
    how often that stands is all there is to know."""
    leading = lambda bits: F.shiftrightunsigned(F.xxhash64("gram"), 64 - bits)
    bits = stretched.sparkSession.sparkContext.broadcast(_filter(shared.select(leading(SIDE_BITS).alias("side"))))

    def strip(batches):
        for batch in batches:
            slot = batch.column("slot").to_numpy()
            stays = ((bits.value[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
            text = pc.if_else(pa.array(stays), batch.column("text"), pa.scalar(None, batch.schema.field("text").type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], text], ["gram", "id", "n", "windows", "text"])

    return stretched.select("gram", "id", "n", "windows", "text", leading(FILTER_BITS).alias("slot")).mapInArrow(strip, "gram long, id binary, n long, windows int, text binary")


def _digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_col))


def repeated_windows(docs: DataFrame, length: int, text_col: str, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """(text_md5, starts, runs): stretches and pieces of distinct texts that have windows which occur elsewhere too, where they
    start in the text, and the runs (from, to) of those windows, counted from there.

    Stretches are first taken together to pieces of some four. A piece that stands twice repeats all its windows; one of its
    texts stands for it from there on, so a group of near copies gives its differences only. Stretches with one anchor meet in one shard. Equal stretches collapse before they move and in the shard; one that stands
    twice repeats all its windows. The rest is decided by the shard's suffix array. If an anchor has more than `hot` different
    stretches, they are dealt to several shards, and each two of those are merged by binary search in one task. What is found of
    a stretch becomes one row before it meets the texts again."""
    twice = saved(_sides(docs, length, text_col).where("n > 1"))
    bits = docs.sparkSession.sparkContext.broadcast(_filter(twice))
    texts = docs.select(_digest(text_col).alias("text_md5"), F.col(text_col).alias("text")).where("text is not null")
    placed = saved(_piece_rows(texts, bits, length))
    known = placed.groupBy("piece").agg(F.sum("n").alias("all"), F.min("text_md5").alias("by"))
    placed = saved(placed.join(known, "piece").select("text_md5", "starts", "windows", (F.col("all") == 1).alias("once"), (F.col("text_md5") == F.col("by")).alias("stands")))
    whole = placed.where("not once").select("text_md5", "starts", F.array(F.struct(F.lit(0).alias("from"), F.col("windows").alias("to"))).alias("runs"))
    asked = placed.where("stands").groupBy("text_md5").agg(F.collect_set(F.struct(F.element_at("starts", 1).alias("start"), "windows", "once")).alias("pieces"))
    asked = saved(asked)
    stretched = saved(_stretch_rows(texts.join(light(asked, F.size("pieces") * 16 + 48), "text_md5"), bits, length))
    shared = saved(stretched.groupBy("gram", "id").agg(F.lit(1)).groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    rows = _without_lone(stretched, shared)
    shards = int(stretched.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // shard_bytes) + 1
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    rows = rows.withColumns({"one": F.lit(0), "two": F.lit(0)})
    busy = saved(shared.select("gram", F.ceil(F.col("kinds") / float(hot)).cast("int").alias("salts")).where("salts > 1"))
    if not busy.isEmpty():
        rows = rows.join(small(busy), "gram", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int"))
        each = F.transform(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1), lambda s: F.struct(F.least(s, F.col("salt")).alias("one"), F.greatest(s, F.col("salt")).alias("two"), F.coalesce("salts", F.lit(1)).alias("of")))
        rows = rows.withColumn("pair", F.explode(each)).withColumns({"one": F.col("pair.one"), "two": F.col("pair.two"), "shard": F.when(F.col("pair.of") > 1, F.col("gram")).otherwise(F.col("shard"))})
    else:
        rows = rows.withColumn("salt", F.lit(0))

    def decide(key, table):
        one, two = key[1].as_py(), key[2].as_py()
        kept, hits = {}, {}
        for g, i, n, windows, text, salt in zip(*(table.column(c).to_pylist() for c in ("gram", "id", "n", "windows", "text", "salt"))):
            row = kept.setdefault(i, [g, 0, text, salt, windows])
            row[1] += n
            row[2] = row[2] or text
        by_gram = {}
        for i, row in kept.items():
            by_gram.setdefault(row[0], []).append(i)
        chosen = [i for ids in by_gram.values() if len(ids) > 1 for i in ids]
        if one == two:
            found, at, size = [], 0, 0
            for k, i in enumerate(chosen):  # suffix arrays of some `shard_bytes`, an anchor's stretches together
                size += len(kept[i][2])
                if k + 1 == len(chosen) or size >= shard_bytes and kept[i][0] != kept[chosen[k + 1]][0]:
                    found.append(chosen[at : k + 1])
                    at, size = k + 1, 0
            for ids in found:
                shard = Shard([kept[i][2] for i in ids], length)
                flags = shard.repeated()
                for i, a, b in zip(ids, shard.starts.tolist(), shard.ends.tolist()):
                    hits[i] = flags[a : b - length + 1]
            for i, row in kept.items():
                if row[1] > 1:
                    hits[i] = np.ones(row[4], bool)
        else:
            sides = [[i for i in chosen if kept[i][3] == s] for s in (one, two)]
            if all(sides):
                a, b = (Shard([kept[i][2] for i in ids], length) for ids in sides)
                for shard, ids, flags in zip((a, b), sides, a.find(b)):
                    for i, x, y in zip(ids, shard.starts.tolist(), shard.ends.tolist()):
                        hits[i] = flags[x : y - length + 1]
        out = [(i, [{"from": a, "to": b} for a, b in _runs(flags)]) for i, flags in hits.items() if flags.any()]
        columns = list(zip(*out)) or [[]] * 2
        release()
        return pa.Table.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))], names=["id", "runs"])

    found = rows.groupBy("shard", "one", "two").applyInArrow(decide, "id binary, runs array<struct<from:int,to:int>>")
    if not busy.isEmpty():
        found = found.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("runs"))).alias("runs"))
    found = saved(found)
    where = stretched.where("text_md5 is not null").select("id", "text_md5", "starts")
    return where.join(light(found, F.size("runs") * 16 + 64), "id").select("text_md5", "starts", "runs").unionByName(whole)


def spans(windows: DataFrame, length: int) -> DataFrame:
    """(text_md5, spans) of what `repeated_windows` gives: the maximal runs of bytes, as flat lists of starts and ends."""
    whole = windows.groupBy("text_md5").agg(F.collect_set(F.struct("starts", "runs")).alias("parts"))

    def merge(batches):
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                own = np.array(sorted((s + r["from"], s + r["to"] + length - 1) for p in parts for s in p["starts"] for r in p["runs"]), np.int64)
                reach = np.maximum.accumulate(own[:, 1])
                first = np.concatenate([[True], own[1:, 0] > reach[:-1]])
                out.append(np.stack([own[first, 0], reach[np.append(np.flatnonzero(first)[1:] - 1, len(own) - 1)]], 1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("text_md5"), pa.array(out, pa.list_(pa.int64()))], ["text_md5", "spans"])
        release()

    return whole.mapInArrow(merge, "text_md5 binary, spans array<long>")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **limits) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary).

    Removes each byte of a text's UTF-8 that some `length`-byte string covers that also starts elsewhere, in the same or
    another document; strings are judged on the input. Rows of equal text have equal results. A null text counts as empty;
    texts under `length` bytes lose nothing; long ones are walked in blocks; ids may be null or repeated; other columns are
    ignored, and an empty table gives an empty result."""
    with short_batches(docs.sparkSession):
        found = saved(spans(repeated_windows(docs, length, text_col, **limits), length))
    rows = docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("text_md5"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(light(found, F.size("spans") * 8 + 64), "text_md5", "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                text, gone = text.encode("utf-8", "surrogatepass"), gone or []
                edges = [0, *gone, len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((len(text), len(text) - len(kept), len(gone) // 2, hashlib.sha256(kept).hexdigest(), kept))
            columns = list(zip(*out)) or [[]] * 5
            made = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made[: 4 + with_text]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    if with_text:  # as large as the input: not written a second time
        return out
    with short_batches(docs.sparkSession):
        return filed(out)
