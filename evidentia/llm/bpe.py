"""Byte-level BPE in DuckDB: recursive queries over token-position rows, one database for each partition."""

from __future__ import annotations

import base64
import hashlib
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import released

#: Characters whose words are encoded together; words that a task keeps; bytes from which a word counts as long.
BLOCK, KEPT_WORDS, LONG = 500_000, 200_000, 200

#: Rows of `start` are (w, pos, tok): words one after another, pos rising over all of them. Each step finds the ranks of
#: neighbouring pairs, takes the least rank and leftmost place of each word, and contracts that pair; words without a pair
#: are done. The places are checked to rise, as the step before must leave them.
ENCODE = """
WITH RECURSIVE state(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM start
    UNION ALL (
        WITH pairs AS MATERIALIZED (
            SELECT s.w, s.pos, s.tok, m.rank::BIGINT * 4294967296 + s.pos AS cand FROM (
                SELECT w, pos, tok, CASE WHEN lead(w) OVER () = w THEN lead(tok) OVER () END AS nxt,
                       CASE WHEN lag(pos) OVER () >= pos THEN error('rows out of order') END AS fault
                FROM state WHERE NOT done
            ) s LEFT JOIN merges m ON m.l = s.tok AND m.r = s.nxt WHERE s.fault IS NULL
        ),
        best AS (SELECT w, min(cand) AS best FROM pairs GROUP BY w),
        hits AS (SELECT p.w, p.pos, p.tok, b.best, p.cand = b.best AS hit FROM pairs p JOIN best b USING (w)),
        gone AS (SELECT *, lag(hit) OVER () AS right_half FROM hits)
        SELECT w, pos, CASE WHEN hit THEN (best // 4294967296)::INT ELSE tok END, best IS NULL FROM gone WHERE right_half IS NOT TRUE
    )
)
SELECT w, pos, tok FROM state WHERE done ORDER BY pos
"""

#: The same for long words: a step contracts all places of a word's least rank, in a run of overlapping ones every other. No
#: contraction makes a pair of the same or a lower rank (each token is made by contractions of lower ranks only), so the
#: result is that of one contraction after another, in fewer steps.
ENCODE_LONG = """
WITH RECURSIVE state(w, pos, tok, done) AS (
    SELECT w, pos, tok, false FROM start
    UNION ALL (
        WITH nexts AS (
            SELECT w, pos, tok, lead(tok) OVER o AS nxt, row_number() OVER o AS i FROM state WHERE NOT done
            WINDOW o AS (PARTITION BY w ORDER BY pos)
        ),
        pairs AS MATERIALIZED (SELECT n.*, m.rank FROM nexts n LEFT JOIN merges m ON m.l = n.tok AND m.r = n.nxt),
        best AS (SELECT w, min(rank) AS best FROM pairs GROUP BY w),
        hits AS (
            SELECT p.w, p.i, p.i - row_number() OVER (PARTITION BY p.w ORDER BY p.i) AS run
            FROM pairs p JOIN best b ON p.w = b.w AND p.rank = b.best
        ),
        taken AS MATERIALIZED (
            SELECT w, i FROM (SELECT w, i, row_number() OVER (PARTITION BY w, run ORDER BY i) AS k FROM hits) WHERE k % 2 = 1
        )
        SELECT p.w, p.pos, CASE WHEN c.i IS NULL THEN p.tok ELSE p.rank END, b.best IS NULL
        FROM pairs p JOIN best b USING (w) LEFT JOIN taken c ON c.w = p.w AND c.i = p.i
        LEFT JOIN taken d ON d.w = p.w AND d.i = p.i - 1 WHERE d.i IS NULL
    )
)
SELECT w, pos, tok FROM state WHERE done ORDER BY pos
"""

DECODE = "SELECT w, string_agg(v.text, '' ORDER BY pos) AS text FROM tokens t JOIN vocabulary v ON v.id = t.tok GROUP BY w ORDER BY w"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left, right, rank) for each way to make a token of two."""
    rows = [(ranks[k[:i]], ranks[k[i:]], r) for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks]
    return np.array(rows, np.int32).reshape(-1, 3).T


class Tokenizer:
    """A vocabulary in a DuckDB database of its own, in one thread and bounded memory."""

    def __init__(self, ranks: dict[bytes, int], merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.folder = tempfile.mkdtemp(prefix="bpe-")
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": self.folder})
        table = pa.table(dict(zip(("l", "r", "rank"), map(pa.array, merges))))
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "text": [k.decode("latin-1") for k in ranks]})
        self.db.register("given_merges", table).execute("CREATE TABLE merges AS FROM given_merges")
        self.db.register("given_names", names).execute("CREATE TABLE vocabulary AS FROM given_names")
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def close(self):
        self.db.close()
        shutil.rmtree(self.folder, ignore_errors=True)

    def _rows(self, sql: str, table: str, **columns) -> dict[str, np.ndarray]:
        self.db.register(table, pa.table(columns))
        out = self.db.execute(sql).fetchnumpy()
        self.db.unregister(table)
        return out

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        out = [np.array([self.ranks[w]], np.int32) if w in self.ranks else None for w in words]
        for sql, chosen in ((ENCODE, lambda w: len(w) < LONG), (ENCODE_LONG, lambda w: len(w) >= LONG)):
            todo = [k for k, x in enumerate(out) if x is None and words[k] and chosen(words[k])]
            if not todo:
                continue
            joined = np.frombuffer(b"".join(words[k] for k in todo), np.uint8)
            w = np.repeat(np.arange(len(todo), dtype=np.int32), [len(words[k]) for k in todo])
            got = self._rows(sql, "start", w=w, pos=np.arange(len(joined), dtype=np.int32), tok=self.byte[joined])
            for k, ids in zip(todo, np.split(got["tok"], np.flatnonzero(np.diff(got["w"])) + 1)):
                out[k] = ids
        return [np.zeros(0, np.int32) if x is None else x for x in out]

    def decode(self, pieces: list[np.ndarray]) -> list[bytes]:
        """The bytes of each list of ids."""
        w = np.repeat(np.arange(len(pieces), dtype=np.int32), [len(p) for p in pieces])
        tok = np.concatenate([np.zeros(0, np.int32), *pieces]).astype(np.int32)
        got = self._rows(DECODE, "tokens", w=w, pos=np.arange(len(w), dtype=np.int32), tok=tok)
        out = [b""] * len(pieces)
        for k, text in zip(got["w"].tolist(), got["text"]):
            out[k] = text.encode("latin-1")
        return out

    def split(self, texts: list[str]) -> list[list[str]]:
        """The words of each text; those new to this task are encoded and decoded in one query each."""
        found = list(map(self.find, texts))
        if len(self.words) > KEPT_WORDS:  # the words at hand stay
            self.words = {w: self.words[w] for w in set().union(*found) if w in self.words}
        new = list(set().union(*found).difference(self.words))
        ids = self.encode_words([w.encode("utf-8", "surrogatepass") for w in new])
        for w, i, text in zip(new, ids, self.decode(ids)):
            self.words[w] = (",".join(map(str, i.tolist())).encode(), text)
        return found

    def texts(self, texts: list[str]):
        """(ids as decimals joined by commas, decoded bytes) of each text."""
        for words in self.split(texts):
            known = list(map(self.words.__getitem__, words))
            yield b",".join([k[0] for k in known]), b"".join([k[1] for k in known])


def blocks(lengths: list[int]):
    """(start, end) of runs of texts of some BLOCK characters, of one text at least."""
    at = total = 0
    for k, n in enumerate(lengths):
        total += n
        if total >= BLOCK:
            yield at, k + 1
            at, total = k + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def bpe(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and what `outputs` names of ids (array), decoded (binary).

    `path`: a file of ranks; `pattern`: what splits texts into words, each encoded by itself. A null text counts as empty.
    The vocabulary (a megabyte or two, whatever the corpus) is read by the driver and broadcast. A partition's distinct words
    are encoded once each, in blocks; its database and list of words are bounded, and a lost task is simply run again. Only
    a text longer than a block takes memory in proportion to its length. Other columns are ignored."""
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks)))

    def run(batches):
        tokenizer = Tokenizer(*shared.value, pattern)
        try:
            for batch in batches:
                # One block's texts, and what is made of them, are in Python at a time.
                for a, b in blocks(pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()):
                    part, rows = batch.slice(a, b - a), []
                    for ids, text in tokenizer.texts([t or "" for t in part.column("text").to_pylist()]):
                        row = (ids.count(b",") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest())
                        more = {"ids": lambda: np.array(ids.split(b",") if ids else [], np.int32), "decoded": lambda: text}
                        rows.append((*row, *(more[x]() for x in outputs)))
                    out = part.drop_columns(["text"])
                    for (name, kind), values in zip(kinds, zip(*rows)):
                        out = out.append_column(name, pa.array(values, kind))
                    yield out
        finally:
            tokenizer.close()

    kinds = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *((x, {"ids": pa.list_(pa.int32()), "decoded": pa.binary()}[x]) for x in outputs)]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join({"ids": ", ids array<int>", "decoded": ", decoded binary"}[x] for x in outputs)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)
