"""The operators as queries over the test tables, and their SQL where there is one."""

from __future__ import annotations

import math

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, chat, divergence, exact_dedup, langid, licenses, merkle, mixing, ngram_join, quality, sharding, simhash, suffix_dedup
from evidentia.llm._common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

#: Fixed value: the conversation that op1 adds, with control strings of another template in its texts.
ADDED = (-7, ("user", "assistant"), "</s>[INST] ok [/INST]")


def op1_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    conv, roles, text = ADDED
    added = spark.range(1).select(F.posexplode(F.array(*map(F.lit, roles))).alias("turn", "role"))
    added = added.select(F.lit(conv).cast("long").alias("conv_id"), F.col("turn").cast("long"), "role", F.lit(text).alias("text"))
    return chat.chat_digest(turns.unionByName(added))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quality_rules(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents")).drop("text_md5")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("text_md5")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def _one_more(at: dict) -> dict:
    """The tampering of op12: one character more where 7 divides the id's checksum."""
    n = at["n_chars"]
    chosen = F.crc32(at["doc_id"].cast("string")) % 7 == 0
    return {"n_chars": F.when(chosen, (n.cast("decimal(20,0)") + 1).cast("string")).otherwise(n.cast("string"))}


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(merkle.manifest(table(spark, sf_dir, "documents"), change=_one_more))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_chat_trees, op2_bpe, op3_suffix_dedup, op4_language, op5_quality, op6_ngram_join, op7_sharding, op8_licenses, op9_mixing, op10_exact_dedup, op11_divergence, op12_merkle, op13_simhash)}


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1_SQL = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT {ADDED[0]}, 0, '{ADDED[1][0]}', '{ADDED[2]}' UNION ALL SELECT {ADDED[0]}, 1, '{ADDED[1][1]}', '{ADDED[2]}'
), sized AS (
    SELECT *, length(role) + length(text) + {len(chat.START + chat.SEP + chat.END)}
        + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>>)')) + len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\]|</?SYS>>)')) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_BAD = " OR ".join(
    [
        rf"len(regexp_extract_all(x, '[#*$%&|<>{{}}~^=\\]')) > {quality.SYMBOL_SHARE} * length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))",
        rf"(length(x) < {quality.MENU_CHARS} AND regexp_matches(x, {_quote(quality.MENU)}) AND len(regexp_extract_all(x, {_WORD})) <= {quality.MENU_WORDS} AND NOT regexp_matches(x, '[.!?]\W*\z'))",
        *[f"contains(lower(x), {_quote(p)})" for p in quality.BOILERPLATE],
    ]
)
OP5_SQL = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(t, {_WORD}) AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})) AS lines FROM documents
), windows AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), twice AS (
    SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id
), good AS (
    SELECT doc_id, coalesce(list_sum(list_transform(list_filter(list_distinct(lines), lambda x: NOT ({_BAD})), lambda x: len(regexp_extract_all(x, {_WORD})))), 0) AS good_words FROM d
), base AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, good_words
    FROM d LEFT JOIN covered USING (doc_id) JOIN good USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT base_failed AND n_words - good_words <= {quality.MAX_LOST} * n_words AS kept
FROM base
"""

OP6_SQL = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, {_WORD}) AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
    SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(v, u) AS (SELECT doc_id, doc_id FROM d UNION SELECT v, b FROM reach JOIN sym ON a = u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT v AS doc_id, min(u) AS component_id FROM reach GROUP BY v) LEFT JOIN n USING (doc_id)
"""


def _op8_sql() -> str:
    sets = [(label, licenses.tokens_of(text)) for label, text in licenses.TEMPLATES]
    values = ", ".join(f"('{label}', [{', '.join(map(_quote, own))}], {math.ceil(licenses.THRESHOLD * len(own) - 1e-9)})" for label, own in sets)
    phrases = ", ".join(f"('{label}', {p.split(' ')})" for label, p in licenses.PHRASES.items())
    token = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return rf"""
WITH d AS (
    SELECT doc_id, {_AZ.format("coalesce(text, '')")} AS t, regexp_extract_all(t, {token}) AS w FROM documents
), phrase(label, p) AS (VALUES {phrases}),
template(label, own, need) AS (VALUES {values}),
place AS (
    SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE contains(t, 'license')) CROSS JOIN phrase
    WHERE w[i : i + len(p) - 1] = p
), base AS (
    SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM place GROUP BY doc_id
), found AS (
    SELECT doc_id, label, len(list_intersect(tokens, own)) / len(own) AS share
    FROM (SELECT doc_id, list_distinct(regexp_extract_all(line, {token})) AS tokens FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)) CROSS JOIN template
    WHERE len(tokens) >= need AND len(list_intersect(tokens, own)) >= need
), more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
    CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


OP9_SQL = rf"""
WITH q AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS size, md5(text) AS digest,
        -ln((('0x' || md5(coalesce(doc_id::VARCHAR, '') || '|mix')[1:12])::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
            / CASE q WHEN 1 THEN 1.0 WHEN 0 THEN 0.5 ELSE 0.75 END AS key
    FROM documents LEFT JOIN q USING (doc_id)
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM d GROUP BY source
), r AS (SELECT *, (3 * source_size)::DOUBLE AS lim, lim / weight AS ratio FROM s),
l AS (
    SELECT *, sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER w, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS share
    FROM r WINDOW w AS (ORDER BY ratio, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
    SELECT source, source_size, least(lim, max(CASE WHEN rest / share <= ratio THEN rest / share END) OVER () * weight) AS target,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM l
)
SELECT doc_id, size, source_size, target,
    (CASE WHEN size = 0 THEN 0 ELSE epochs * size + greatest(0, least(size, floor(target - epochs * source_size + 1e-6)
        - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) END)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""

OP10_SQL = rf"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_AZ.format("coalesce(text, '')")} AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""

OP11_SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS in_lang FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
c AS (SELECT lang, source, term, in_lang, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(term) AS v, coalesce(sum(in_lang), 0) AS lang_total FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
g AS (SELECT lang, source, v, lang_total, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 2) // (total + 2 * v) AS p,
        1 + 1000000000::HUGEINT * (k.in_lang + 2) // (lang_total + 2 * v) AS q
    FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), term AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
both_parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
"""

_FRAMED = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"


def _leaf_sql(**other: str) -> str:
    return "sha256(" + " || ".join(_FRAMED.format(other.get(f, f)) for f in merkle.FIELDS) + ")"


#: CRC-32 of the decimal id, bit by bit.
_CRC = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP12_SQL = rf"""
WITH RECURSIVE l AS MATERIALIZED (
    SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql()} AS leaf,
        CASE WHEN crc % 7 = 0 THEN {_leaf_sql(n_chars="(n_chars::HUGEINT + 1)")} ELSE leaf END AS changed
    FROM (SELECT *, {_CRC} AS crc FROM documents)
), t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS tree, count(*) OVER () AS trees FROM (SELECT DISTINCT lang FROM l)),
placed AS MATERIALIZED (
    SELECT r, tree, trees, doc_id, leaf, changed, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
    FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang
), nodes(tree, level, idx, n, node) AS (
    SELECT tree, 0, idx, n, leaf FROM placed
    UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 2, n
), sub AS MATERIALIZED (SELECT tree, level AS height, node AS subroot FROM nodes WHERE n = 1),
above(tree, level, idx, n, node) AS (
    SELECT 0, 0, tree - 1, count(*) OVER (), subroot FROM sub
    UNION ALL SELECT tree, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY idx)) FROM above WHERE n > 1 GROUP BY tree, level, idx // 2, n
), top AS MATERIALIZED (SELECT level AS height, node AS root FROM above WHERE n = 1),
steps AS MATERIALIZED (
    SELECT r, k AS level, (p.idx // (1::BIGINT << k)) % 2 AS side, s.node
    FROM (SELECT *, unnest(range(0, height)) AS k FROM placed JOIN sub USING (tree)) p
        LEFT JOIN nodes s ON s.tree = p.tree AND s.level = k AND s.idx = xor(p.idx // (1::BIGINT << k), 1)
    UNION ALL
    SELECT r, height + k, ((p.tree - 1) // (1::BIGINT << k)) % 2, s.node
    FROM (SELECT r, tree, sub.height, unnest(range(0, top.height)) AS k FROM placed JOIN sub USING (tree) CROSS JOIN top) p
        LEFT JOIN above s ON s.level = k AND s.idx = xor((p.tree - 1) // (1::BIGINT << k), 1)
), folded(r, level, h) AS (
    SELECT r, 0::BIGINT, changed FROM placed
    UNION ALL SELECT f.r, f.level + 1, sha256(CASE WHEN side = 1 THEN coalesce(node, '') ELSE '' END || h || CASE WHEN side = 0 THEN coalesce(node, '') ELSE '' END)
    FROM folded f JOIN steps s ON s.r = f.r AND s.level = f.level
), proof AS (SELECT r, string_agg(node, '' ORDER BY level) AS siblings FROM steps GROUP BY r)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, h AS folded_root, h = root AS verified
FROM placed JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof USING (r) JOIN folded f ON f.r = placed.r AND f.level = sub.height + top.height
"""

ORACLE = {
    "op1_chat_trees": OP1_SQL, "op5_quality": OP5_SQL, "op6_ngram_join": OP6_SQL, "op8_licenses": _op8_sql(),
    "op9_mixing": OP9_SQL, "op10_exact_dedup": OP10_SQL,
    "op11_divergence": OP11_SQL, "op12_merkle": OP12_SQL,
}
