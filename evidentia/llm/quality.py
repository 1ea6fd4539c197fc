"""Line-first quality rules (built-in functions only)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm._common import WORD, let

#: The symbols that the base counts, words of menus, and phrases of boilerplate.
SYMBOLS = r"[#*$%&|<>]"
MENU = r"(?i)^\W*(?:home|menu|log ?in|sign (?:in|up)|contact(?: us)?|about(?: us)?|next|previous|back to top|skip to (?:main )?content|search|share|read more|click here)(?:\W|\z)"
BOILERPLATE = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "subscribe to our newsletter", "lorem ipsum", "©")

#: A line is a menu item only if it has so many words at most, and fewer characters.
MENU_WORDS = 8
MENU_CHARS = 200
#: A line fails by its punctuation if more than this share of its visible characters are symbols.
SYMBOL_SHARE = 0.1
#: A document is rejected if its removed lines held more than this share of its words.
MAX_LOST = 0.5
WINDOW = 8


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of 8 words that the array holds twice or more, the first one included.

    Windows are compared by a 64-bit hash, made of the hashes of their halves, of those halves' halves and of the words. Arrays without a repeated window, nearly all, are done
    after one pass; else windows are sorted by hash, and the places of repeated ones give the words that they cover."""

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(k, k - 1)) | ((k < last) & same(k, k + 1)))
        places = F.array_sort(F.transform(twice, lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
        step = lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(pairs), covered))

    pair = lambda h, k: F.transform(F.slice(h, F.lit(1), F.size(h) - k), lambda x, i: F.xxhash64(x, F.get(h, i + k)))
    hashes = let(let(let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: pair(h, 1)), lambda h: pair(h, 2)), lambda h: pair(h, 4))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(hashes, count)).cast("long")


def failing(line: Column) -> Column:
    """Whether a line with words fails a rule: punctuation, navigation or boilerplate."""
    visible = F.length(F.regexp_replace(line, r"[\x20\x09-\x0D]+", ""))
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>{}~^=\\]"))
    symbols = F.when(marks > 0, marks > visible * SYMBOL_SHARE).otherwise(False)
    menu = (F.length(line) < MENU_CHARS) & line.rlike(MENU) & (F.regexp_count(line, F.lit(WORD)) <= MENU_WORDS) & ~line.rlike(r"[.!?]\W*\z")
    boilerplate = let(F.lower(line), lambda x: reduce(or_, [x.contains(p) for p in BOILERPLATE]))
    return symbols | menu | boilerplate


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines_removed, n_words_lost and cleaned (the text without its failing lines).

    Lines are judged first: by their punctuation (mostly symbols), as navigation (a short menu item without a sentence's
    end) or boilerplate, and as repeats of an earlier line. A document is kept if it passes the base rules and its removed
    lines held at most half of its words. A null text counts as empty and, having no words, fails the base. Rows are judged
    each for itself, so ties and repeats change nothing. Other columns are ignored."""
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumns({"words": F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), "lines": F.split("t", "\n", -1)})
    t = t.withColumn("full", F.filter("lines", lambda x: x.rlike(WORD)))
    t = t.withColumns({"fresh": F.array_distinct("full"), "n_words": F.size("words").cast("long")})
    t = t.withColumn("bad", F.filter("fresh", failing))
    good = F.aggregate(F.filter("fresh", lambda x: ~F.array_contains("bad", x)), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))
    good = F.when((F.size("bad") == 0) & (F.size("fresh") == F.size("full")), F.col("n_words")).otherwise(good)
    t = t.select(
        "doc_id", "n_words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count("t", F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("full") - F.size("fresh")).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"),
        (F.size("full") - F.size("fresh") + F.size("bad")).cast("long").alias("n_lines_removed"), (F.col("n_words") - good).cast("long").alias("n_words_lost"),
        F.when(F.size("bad") == 0, F.col("t")).otherwise(F.array_join(F.filter("lines", lambda x: ~F.array_contains("bad", x)), "\n")).alias("cleaned"),
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return t.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_words_lost") <= F.col("n_words") * MAX_LOST))
