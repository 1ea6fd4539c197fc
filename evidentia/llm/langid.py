"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.llm._common import numbered, released

BITS = 16
ORDERS = (1, 2, 3)
#: Training uses so many labelled rows of a language at most, chosen by a hash of the row, and their whole texts.
SAMPLE_ROWS = 5_000
#: Added to every count.
ALPHA = 0.5
UNDETERMINED = "und"
#: Characters that are scored at a time.
BLOCK = 1_000_000
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint32)


def letters() -> np.ndarray:
    """For each code point: of a letter, its lower case; of anything else, a space."""
    points = range(0x110000)
    return np.fromiter((ord(low) if (c := chr(p)).isalpha() and len(low := c.lower()) == 1 else p if c.isalpha() else 32 for p in points), np.uint32, 0x110000)


def _blocks(texts: list[str]):
    """Pieces of about BLOCK characters in all: (documents' numbers, code points, first place of each, places each owns).
    A piece of a longer text also holds the characters that n-grams from its own last places need."""
    ahead = max(ORDERS) - 1
    pieces, total = [], 0
    for k, text in enumerate(texts):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for at in range(0, len(points), BLOCK):
            pieces.append((k, points[at : at + BLOCK + ahead], min(BLOCK, len(points) - at)))
            total += len(pieces[-1][1])
            if total >= BLOCK:
                yield pieces
                pieces, total = [], 0
    if pieces:
        yield pieces


def _features(pieces: list, table: np.ndarray):
    """For each order: the features at all places and whether an n-gram of the piece starts there."""
    lens = np.array([len(p) for _, p, _ in pieces])
    own = np.array([n for _, _, n in pieces])
    points = table[np.concatenate([p for _, p, _ in pieces])]
    starts = np.cumsum(lens) - lens
    at = np.arange(len(points)) - np.repeat(starts, lens)
    hashed = np.zeros(len(points), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        hashed[: len(points) - n + 1] = (hashed[: len(points) - n + 1] ^ points[n - 1 :]) * _MULTIPLIERS[(n - 1) % 3]
        hashed ^= hashed >> np.uint32(15)
        if n in ORDERS:
            yield hashed >> np.uint32(32 - BITS), at < np.repeat(np.minimum(own, lens - n + 1), lens), starts


def fit(labelled: DataFrame, table, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, matrix of log probabilities by feature and language, with a last row of zeros) from (text, lang).

    Counting runs on the executors; counts of a language and a range of features meet in one task, whatever the input."""
    spark = labelled.sparkSession
    rows = labelled.where("lang is not null and text is not null")
    seen = dict(rows.groupBy("lang").count().collect())
    langs = sorted(seen)
    if not langs:
        return [], np.zeros((2**BITS + 1, 0), np.float32)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample_rows / seen[x]))) for x in langs])
    rows = rows.where(F.pmod(F.xxhash64("lang", "text"), F.lit(1 << 30)) < share * float(1 << 30))
    features = 2**BITS

    def count(batches):
        counts = {}
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                own = counts.setdefault(lang, np.zeros(features, np.int64))
                for pieces in _blocks(list(texts)):
                    for idx, valid, _ in _features(pieces, table.value):
                        own += np.bincount(idx[valid], minlength=features)
        for lang, own in counts.items():
            parts = own.reshape(16, -1)
            yield pd.DataFrame({"lang": lang, "part": range(16), "counts": [list(x) for x in parts]})

    parts = rows.select("lang", "text").mapInPandas(released(count), "lang string, part int, counts array<long>")
    sums = parts.select("lang", "part", F.posexplode("counts").alias("at", "n")).groupBy("lang", "part", "at").agg(F.sum("n").alias("n"))
    total = np.zeros((len(langs), features))
    for r in sums.where("n > 0").toLocalIterator():
        total[langs.index(r.lang), r.part * (features // 16) + r["at"]] = r.n
    total += ALPHA
    matrix = np.zeros((features + 1, len(langs)), np.float32)
    matrix[:features] = np.log(total / total.sum(1, keepdims=True)).T
    return langs, matrix


def predict(docs: DataFrame, langs: list[str], matrix: np.ndarray, table, text_col: str = "text", names=("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its posterior probability under equal priors, in columns of the given names."""
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    model = docs.sparkSession.sparkContext.broadcast(matrix)
    und = UNDETERMINED

    def score(batches):
        weights, zero = model.value, len(model.value) - 1
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            sums = np.zeros((len(texts), len(langs)))
            for pieces in _blocks(texts) if langs else ():
                where = [k for k, _, _ in pieces]
                for idx, valid, starts in _features(pieces, table.value):
                    np.add.at(sums, where, np.add.reduceat(weights[np.where(valid, idx, zero)], starts, axis=0, dtype=np.float64))
            if langs:
                odds = np.exp(sums - sums.max(1, keepdims=True))
                best, p = sums.argmax(1), 1 / odds.sum(1)
            else:
                best, p, found = np.zeros(len(texts), int), np.zeros(len(texts)), found & False
            best = pa.array([langs[b] if ok else und for b, ok in zip(best, found)], pa.string())
            yield batch.append_column(names[0], best).append_column(names[1], pa.array(np.where(found, p, 0.0)))

    return docs.mapInArrow(released(score), schema)


def _trained(docs: DataFrame, id_col: str, text_col: str, lang_col: str):
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(4)) == 2
    table = docs.sparkSession.sparkContext.broadcast(letters())
    return held, table, *fit(docs.where(~held).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), table)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Trains on the non-null languages of rows that are not held out (crc32 of the id as text, mod 4, is 2; a null id counts as
    empty text) and uses nothing but the text to predict. A text that is null or without a letter is `und`, with score 0, and
    so is any text if no row is labelled. Texts are scored whole, in blocks; the matrix that is broadcast has 2^16 rows
    whatever the corpus. Repeated rows get the same verdict; other columns are ignored."""
    held, table, langs, matrix = _trained(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("_text"))
    return predict(rows, langs, matrix, table, "_text").select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """`docs` without the rows whose language is undetermined or predicted with a lower score; any column names will do."""
    _, table, langs, matrix = _trained(docs, id_col, text_col, lang_col)
    rows, own_text = numbered(docs, text_col)
    scored = predict(rows, langs, matrix, table, own_text, ("_lang_pred", "_score"))
    return scored.where((F.col("_lang_pred") != UNDETERMINED) & (F.col("_score") >= least_score)).select(*rows.columns).toDF(*docs.columns)
