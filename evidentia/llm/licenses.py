"""License scans: base phrases, and templates found by an exact set-containment join (built-in functions only)."""

from __future__ import annotations

import math
import re
import string
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import let

#: Runs of ASCII letters and digits and of all characters beyond ASCII.
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases that the base counts, by label.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Wording of well-known notices, by label.
TEMPLATES = (
    ("agpl", "GNU Affero General Public License"),
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "GNU Lesser General Public License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
THRESHOLD = 0.8


#: Templates of at most so many distinct tokens must be in a window whole: without one they are another notice.
SHORT = 5


def all_tokens(text: str) -> list[str]:
    lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return re.findall(TOKEN, lowered)


def tokens_of(text: str) -> list[str]:
    """The distinct tokens of a template."""
    return list(dict.fromkeys(all_tokens(text)))


#: ASCII characters that end a token.
ENDS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def spaced(c: Column) -> Column:
    """The text with A to Z lower-cased and each character outside tokens turned into a space."""
    return F.translate(c, string.ascii_uppercase + ENDS, string.ascii_lowercase + " " * len(ENDS))


def split_tokens(c: Column) -> Column:
    """The tokens of a text from `spaced`."""
    return F.regexp_extract_all(c, F.lit("[^ ]+"), F.lit(0))


def _starts(words: Column, phrase: str) -> Column:
    first, *rest = phrase.split(" ")
    spots = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    follows = lambda i: F.coalesce(F.concat_ws(" ", F.slice(words, i + 2, len(rest))) == " ".join(rest), F.lit(False))
    return F.filter(spots, follows)


def token_order(texts: Column, docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens by how often the whole corpus has them, the rarest first."""
    words = docs.select(F.explode(split_tokens(texts)).alias("w"))
    counts = dict(words.where(F.col("w").isin(vocabulary)).groupBy("w").count().collect())  # a row for each token of the templates
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(lines: Column, plans: list[tuple[str, list[str], int]]) -> Column:
    """[(label, containment)] of each template that some line contains.

    A template needs `need` of its tokens. Filters come first: a line must hold one of the template's rarest tokens (so many
    that the others alone are too few), enough tokens, and enough of them from its rarest match on; the rest is counted."""

    def of_line(tokens: Column) -> Column:
        found = []
        for label, own, need in plans:
            prefix, whole = own[: len(own) - need + 1], F.array(*map(F.lit, own))
            position = F.coalesce(*[F.when(F.array_contains(tokens, w), F.lit(i)) for i, w in enumerate(prefix)])
            possible = F.arrays_overlap(tokens, F.array(*map(F.lit, prefix))) & (F.size(tokens) >= need) & (len(own) - position >= need)
            share = F.when(possible, F.size(F.array_intersect(tokens, whole)))
            found.append(F.when(share >= need, F.struct(F.lit(label).alias("label"), (share / len(own)).alias("share"))))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    tokens = F.transform(lines, lambda x: F.array_distinct(split_tokens(spaced(x))))
    return F.flatten(F.transform(tokens, of_line))


def across(words: Column, windows: list[tuple[str, list[str], int, int]]) -> Column:
    """[(label, containment)] of each template that some window of its length contains, over line ends too.

    windows: (label, distinct tokens, how many are needed, tokens with repeats). A window may as well start at a token of the template:
    if it does not, the one from its first such token on holds the same. Texts without enough of a template's tokens go first."""

    def of_one(w: Column, known: Column, label: str, own: list[str], need: int, length: int) -> Column:
        whole = F.array(*map(F.lit, own))
        starts = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(whole, x), i + 1)), lambda i: i.isNotNull())
        most = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(w, i, length), whole))))
        most = F.when(F.size(F.array_intersect(known, whole)) >= need, most)
        return let(most, lambda n: F.when(n >= need, F.struct(F.lit(label).alias("label"), (n / len(own)).alias("share"))))

    def of_text(w: Column, known: Column) -> Column:
        return F.filter(F.array(*[of_one(w, known, *x) for x in windows]), lambda x: x.isNotNull())

    vocabulary = F.array(*map(F.lit, sorted({w for _, own, _, _ in windows for w in own})))
    return let(words, lambda w: let(F.array_intersect(w, vocabulary), lambda known: of_text(w, known)))


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: the places where a phrase's words stand one after another, over line ends too. Blocks are lines, and windows of a
    template's length that start at any token, for notices wrapped over lines; a block holds a template if `threshold` of the
    template's distinct tokens are in it, in a window all of them where they are five or fewer. Score: 1 with a base phrase, else the largest such
    share that was found, else 0. Two scans: document frequencies of the templates' tokens, which order them (the order
    decides how fast the filters are, never what they find), and the join, with the templates as literals; no rows move.
    A null text counts as empty. Rows are judged each for itself. Other columns are ignored."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t = t.withColumn("t", spaced(F.col("text")))
    sets = [(label, tokens_of(text)) for label, text in templates]
    order = {w: i for i, w in enumerate(token_order(F.col("t"), t, sorted({w for _, own in sets for w in own})))}
    plans = [(label, sorted(own, key=order.get), math.ceil(threshold * len(own) - 1e-9)) for label, own in sets]
    windows = [(label, own, len(own) if len(own) <= SHORT else need, len(all_tokens(text))) for (label, own, need), (_, text) in zip(plans, templates)]
    gate = sorted({w for _, own, need in plans for w in own[: len(own) - need + 1]})
    holds = lambda needles: reduce(or_, [F.col("t").contains(w) for w in needles])  # noqa: E731  a plain search, before any text is split
    tokens = split_tokens(F.col("t"))
    spots = let(tokens, lambda words: F.array(*[F.struct(F.lit(label).alias("label"), _starts(words, p).alias("at")) for label, p in PHRASES.items()]))
    t = t.withColumn("spots", F.when(holds(sorted({p.split(" ")[-1] for p in PHRASES.values()})), F.filter(spots, lambda x: F.size(x["at"]) > 0)).otherwise(F.array().cast("array<struct<label:string,at:array<int>>>")))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(x) > 0)
    t = t.withColumn("found", F.when(holds(gate), F.concat(matches(lines, plans), across(tokens, windows))).otherwise(F.array().cast("array<struct<label:string,share:double>>")))
    t = t.withColumns({"base": F.array_sort(F.transform("spots", lambda x: x["label"])), "places": F.flatten(F.transform("spots", lambda x: x["at"]))})
    labels = F.array_sort(F.array_union("base", F.transform("found", lambda x: x["label"])))
    best = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)))
    return t.select(
        "doc_id", F.regexp_count("t", F.lit("[^ ]+")).cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), best.alias("score"),
    )
