"""Scalar text functions: normalisation, context predicates, serialisation, truncation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space of Python's str.split, as a class for Java's and RE2's expressions.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: What counts as an absent context, by predicate.
ABSENT = {
    "v1": ("", "[null]", "nan", "none", "null", "na", "n/a"),
    "v3": ("",),
    "v4": ("", "[null]", "null", "none", "n/a"),
    "v4a": ("", "nan", "[null]"),
    "v7": ("", "[null]", "null", "none", "n/a", "nan", "<na>"),
    "llm": ("", "null", "none", "nan", "[null]", "[no_context]"),
}
STARTER_ABSENT = ("", "nan", "NaN", "[NULL]")

#: Digits and punctuation that the fifth normalisation maps, one character to one.
DIGITS = ("০১২৩৪৫৬৭৮৯٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "012345678901234567890123456789")
PUNCTUATION = ("।॥‐‑‒–—―‘’‚‛“”„‟«»‹›؟，．：；！？（）", "..------''''\"\"\"\"\"\"''?,.:;!?()")
ZERO_WIDTH = "[​‌‍⁠﻿]"
BENGALI_DIGITS = ("০১২৩৪৫৬৭৮৯", "0123456789")


def nfc(c: Column) -> Column:
    """Canonical composition. ASCII text, which it never changes, is not sent to Python."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))

    ascii_only = c.rlike(r"\A[\x00-\x7F]*\z")
    return F.when(ascii_only, c).otherwise(compose(F.when(~ascii_only, c)))


def nfkc(c: Column) -> Column:
    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))

    return compose(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column) -> Column:
    return collapse(nfc(F.coalesce(c, F.lit(""))))


def is_absent(c: Column, rule: str) -> Column:
    """Whether a context is absent by one of the rules in ABSENT, or "starter"."""
    if rule == "starter":
        return c.isNull() | strip(c).isin(*STARTER_ABSENT)
    return c.isNull() | F.lower(collapse(c) if rule == "v1" else strip(c)).isin(*ABSENT[rule])


def clean_context(c: Column, rule: str = "v4a") -> Column:
    return F.when(is_absent(c, rule), F.lit("")).otherwise(c)


def normalize_context(c: Column) -> Column:
    n = normalize_text(c)
    return F.when(F.lower(n).isin(*ABSENT["v1"]), F.lit("")).otherwise(n)


def marked_text(prompt: Column, context: Column, response: Column) -> Column:
    """The marked serialisation of a row; context: an absent one is empty."""
    present = F.when(context != "", "1").otherwise("0")
    return F.concat(F.lit("__PROMPT__\n"), prompt, F.lit("\n\n__CONTEXT_PRESENT__\n"), present, F.lit("\n\n__CONTEXT__\n"), context, F.lit("\n\n__RESPONSE__\n"), response)


def normalize_numbers(c: Column) -> Column:
    return F.translate(c, *BENGALI_DIGITS)


def normalize_v5(c: Column) -> Column:
    """Composition, no zero-width characters, plain digits and punctuation, lower case, single spaces. (Lower-casing is exact
    where Latin is the only script with case.)"""
    c = F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), ZERO_WIDTH, "")
    return collapse(F.lower(F.regexp_replace(F.translate(F.translate(c, *DIGITS), *PUNCTUATION), "…", "...")))


def strip_punctuation(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"\p{P}", " "))


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def transformer_pair(prompt: Column, context: Column, response: Column) -> Column:
    present = F.when(context != "", "1").otherwise("0")
    a = F.concat(F.lit("[PROMPT]\n"), prompt, F.lit("\n\n[CONTEXT_PRESENT]\n"), present, F.lit("\n\n[CONTEXT]\n"), context)
    return F.struct(a.alias("a"), F.concat(F.lit("[RESPONSE]\n"), response).alias("b"))


def semantic_pair(prompt: Column, evidence: Column, response: Column) -> Column:
    shown = F.when(F.coalesce(evidence, F.lit("")) == "", F.lit("[NO_EVIDENCE]")).otherwise(evidence)
    return F.struct(F.concat(F.lit("[QUESTION] "), prompt, F.lit("\n[EVIDENCE] "), shown).alias("a"), response.alias("b"))


def truncate_middle(c: Column, limit: int) -> Column:
    half = limit // 2
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, half), F.lit("\n[...TRUNCATED...]\n"), F.right(c, F.lit(half))))


def head_tail(tokens: Column, limit: int, ratio: float = 0.5) -> Column:
    """The first and last tokens, `limit` in all; the head gets `ratio` of them, rounded to even at the half."""
    head = int(round(limit * ratio))
    return F.when(F.size(tokens) <= limit, tokens).otherwise(F.concat(F.slice(tokens, 1, head), F.slice(tokens, -(limit - head), limit - head)))


def prepared(prompt: Column, context: Column, response: Column, present: Column, layout: str) -> Column:
    """(a, b) of one of three layouts: `compatible` (both parts marked, with a flag), `structured` (an absent context is [NULL]) and `routed`
    (other markers, and no context part where it is absent)."""
    if layout == "compatible":
        return transformer_pair(prompt, F.when(present, context).otherwise(""), response)
    question = F.concat(F.lit("[QUESTION]\n"), prompt)
    if layout == "structured":
        return F.struct(F.concat(question, F.lit("\n\n[CONTEXT]\n"), F.when(present, context).otherwise("[NULL]")).alias("a"), F.concat(F.lit("[ANSWER]\n"), response).alias("b"))
    if layout == "routed":
        return F.struct(F.when(present, F.concat(question, F.lit("\n\n[EVIDENCE]\n"), context)).otherwise(question).alias("a"), F.concat(F.lit("[CLAIM]\n"), response).alias("b"))
    raise ValueError(f"no layout {layout!r}")


def markers(present: Column, layout: str) -> tuple[Column, Column, Column]:
    """What stands before prompt, context and response in a layout."""
    if layout == "compatible":
        flag = F.when(present, "1").otherwise("0")
        return F.lit("[PROMPT]\n"), F.concat(F.lit("\n\n[CONTEXT_PRESENT]\n"), flag, F.lit("\n\n[CONTEXT]\n")), F.lit("[RESPONSE]\n")
    if layout == "structured":
        return F.lit("[QUESTION]\n"), F.concat(F.lit("\n\n[CONTEXT]\n"), F.when(present, "").otherwise("[NULL]")), F.lit("[ANSWER]\n")
    if layout == "routed":
        return F.lit("[QUESTION]\n"), F.when(present, F.lit("\n\n[EVIDENCE]\n")).otherwise(""), F.lit("[CLAIM]\n")
    raise ValueError(f"no layout {layout!r}")


def head_tail_within(tokens: Column, limit: Column, ratio: float = 0.5) -> Column:
    """As `head_tail`, with a limit for each row; none where it is 0 or less."""
    head = F.bround(limit * ratio).cast("int")
    cut = F.concat(F.slice(tokens, F.lit(1), head), F.when(limit > head, F.slice(tokens, head - limit, limit - head)).otherwise(F.slice(tokens, F.lit(1), F.lit(0))))
    return F.when(limit <= 0, F.slice(tokens, F.lit(1), F.lit(0))).when(F.size(tokens) <= limit, tokens).otherwise(cut)


def field_budget(prompt: Column, context: Column, response: Column, present: Column, layout: str, tokenize, maximum: int = 256, prompt_tokens: int = 80, response_tokens: int = 96, special: int = 3, ratio: float = 0.5) -> Column:
    """(a, b, prompt_original, prompt_retained, context_original, ...): the tokens of both parts within `maximum`, special ones counted. Prompt
    and response are cut to their budgets, head and tail; the context gets all that is left. tokenize: from a text column to an
    array of tokens. Raises where the markers leave less than both budgets."""
    before = [tokenize(m) for m in markers(present, layout)]
    capacity = F.lit(maximum - special) - sum(F.size(m) for m in before)
    p, r = tokenize(prompt), tokenize(response)
    c = F.when(present, tokenize(context)).otherwise(F.slice(tokenize(prompt), F.lit(1), F.lit(0)))
    kept_p, kept_r = head_tail_within(p, F.lit(prompt_tokens)), head_tail_within(r, F.lit(response_tokens))
    kept_c = head_tail_within(c, capacity - F.size(kept_p) - F.size(kept_r), ratio)
    a = F.concat(before[0], kept_p, before[1], F.when(capacity < prompt_tokens + response_tokens, F.raise_error(F.lit("the budgets do not fit"))).otherwise(kept_c))
    sizes = [F.size(x).alias(f"{n}_{k}") for n, o, kept in (("prompt", p, kept_p), ("context", c, kept_c), ("response", r, kept_r)) for k, x in (("original", o), ("retained", kept))]
    return F.struct(a.alias("a"), F.concat(before[2], kept_r).alias("b"), *sizes)


def remove_terminal_escapes(c: Column) -> Column:
    return F.regexp_replace(c, r"\x{1B}\[((?:\d|;)*)([a-zA-Z])", "")


def uncurl_quotes(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[ʼ‘-‛]", "'"), "[“-‟]", '"')


def fix_line_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?|[\x{2028}\x{2029}\x{85}]", "\n")
