"""Tokenisers, n-grams and array measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.text import collapse, normalize_numbers


def token_set(c: Column) -> Column:
    """Distinct runs of letters, numbers and underscores of two characters at least; combining marks end a run."""
    return F.array_distinct(F.regexp_extract_all(normalize_numbers(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)))


def number_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(normalize_numbers(c), F.lit(r"\p{Nd}+(?:\.\p{Nd}+)?"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Runs of letters, marks and numbers, repeats kept."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def numerals(toks: Column) -> Column:
    return F.filter(toks, lambda t: t.rlike(r"^\p{Nd}+\z"))


def let(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams; a shorter text is its own only one."""

    def grams(chars: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        return F.when(F.size(chars) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(chars, i, n), ""))))

    return let(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), grams)


def word_ngrams(c: Column, least: int = 1, lower: bool = True) -> Column:
    """Words and pairs of neighbouring words; words of `least` characters at least."""
    words = F.regexp_extract_all(F.lower(c) if lower else c, F.lit(r"[\p{L}\p{N}_]{%d,}" % least), F.lit(0))
    pairs = F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(words, pairs)


def char_wb_ngrams(c: Column, low: int, high: int, lower: bool = False) -> Column:
    """n-grams within each word padded by a space on both sides; a padded word shorter than n stands once for it and all
    longer ones."""
    text = F.lower(c) if lower else c
    padded = F.transform(F.filter(F.split(collapse(text), " "), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def sized(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1)))
        short = F.array(w) if n == low else F.array().cast("array<string>")
        return F.when(F.length(w) >= n, F.transform(starts, lambda i: F.substring(w, i, F.lit(n)))).otherwise(short)

    def of_word(w: Column) -> Column:
        return F.concat(*[sized(w, n) for n in range(low, high + 1)])

    return F.flatten(F.transform(padded, of_word))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def multiset_overlap(a: Column, b: Column) -> Column:
    """How many items of `a` are matched one to one by equal items of `b`."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def in_lexicon(toks: Column, words: tuple[str, ...]) -> Column:
    return F.size(F.filter(toks, lambda t: t.isin(*words)))


