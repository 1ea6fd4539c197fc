"""Divergence, manifests and fingerprints against brute force, on a table with the cases that break things."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from evidentia.llm import divergence, merkle, queries, simhash

own = random.Random(3)
WORDS = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Straße", "naïve", "ÉCOLE", "it's", "…"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, of=len(WORDS)):
    return " ".join(own.choice(WORDS[:of]) for _ in range(n))


def built():
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "", 3), (5, words(9), None, "a", None), (-4, "x " * 300_000, "en", "a", 7), (7, "a\tb\nC d", "en", "b", 2**63 - 1), (7, "a\tb\nC d", "en", "b", 2**63 - 1), (7, "other", "en", "b", 1)]
    for k in range(10, 90):
        text = words(own.randrange(1, 60), own.choice([20, 65]))
        lang = own.choice(["en", "en", "fr", "", None, "日本"])
        rows.append((k, text, lang, own.choice(["a", "b", "c", "", None, "ü"]), len(text)))
    base = words(400).split(" ")
    for k in range(200, 230):  # a family around one text
        body = list(base)
        for _ in range(k % 4):
            body[own.randrange(400)] = own.choice(WORDS)
        rows.append((k, " ".join(body), "fr", "a", 5))
    return rows + [(230, rows[-1][1].upper(), "de", "lone", 1), (231, "only two", "de", "lone", 1), (232, "", "xx", "s1", 0), (233, "!!", "xx", "s2", 2)]


ROWS = built()


@pytest.fixture(scope="module")
def docs(spark):
    extra = ", fp long, term string, idx int, g int, _part int, level int, grp string, tree int"
    return spark.createDataFrame([(*r, 1, "t", 2, 3, 4, 5, "g", 6) for r in ROWS], SCHEMA + extra).repartition(5)


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def diverged(rows, min_docs, top):
    counts, n_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", az(text))
        counts[lang or "", source or ""].update(terms)
        n_docs[lang or ""].update(set(terms))
    out = []
    for lang in n_docs:
        kept = [t for t, n in n_docs[lang].items() if n >= min_docs]
        groups = {s: counts[x, s] for x, s in counts if x == lang}
        whole = sum(groups.values(), Counter())

        def p(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in groups.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            parts = {"pair": [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in groups if o != s], "term": [(t, f(ps[s][t], q[t])) for t in kept if groups[s][t] and ps[s][t] > q[t]]}
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return out


@pytest.mark.parametrize("block, chunk, run", [(16, 1 << 14, 8), (2, 7, 2)])
def test_divergence(docs, block, chunk, run):
    for min_docs, top in ((10, 10), (2, 3)):
        same(divergence.divergence(docs, min_docs=min_docs, top=top, block=block, chunk=chunk, run=run).collect(), diverged(ROWS, min_docs, top))


def test_shares_beyond_64_bits():
    counts = [0, 1, 10**12 + 7, 4 * 10**14]
    total, terms = 9 * 10**14, 10**7
    got = divergence.shares(divergence.np.array(counts), total, terms).tolist()
    assert got == [1 + 10**9 * (c + 2) // (total + 2 * terms) for c in counts]


def test_pieces_of_a_text(monkeypatch):
    monkeypatch.setattr(divergence, "_PIECE", 5)
    data = b"aa  bbbbbbbbb c " + b"d" * 30 + b" e"
    assert [t for p in divergence._pieces(data) for t in p if t] == data.split()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r):
    doc_id, text, lang, source, n = r
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)])


def climb(nodes):
    """The root of a list of nodes, and the steps (side, sibling) of each."""
    steps, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(spots):
            steps[k].append((at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else None))
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        spots = [at // 2 for at in spots]
    return nodes[0], steps


def proven(rows):
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for own_rows in trees.values():
        own_rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    grown = {x: climb([leaf_of(r) for r in trees[x]]) for x in order}
    root, above = climb([grown[x][0] for x in order])
    out = []
    for x, up in zip(order, above):
        for r, own_steps in zip(trees[x], grown[x][1]):
            steps, h = own_steps + up, leaf_of(r)
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                h = leaf_of((*r[:4], r[4] + 1))
            for side, s in steps:
                h = H(s or "", h) if side else H(h, s or "")
            out.append((r[0], leaf_of(r), grown[x][0], root, H(*[s for _, s in steps if s]), h, h == root))
    return out


@pytest.mark.parametrize("tier", [10, 2])
def test_merkle(docs, tier):
    rows = merkle.proofs(merkle.manifest(docs, change=queries._one_more, tier=tier)).collect()
    same(rows, proven(ROWS))
    assert 0 < sum(not r.verified for r in rows) < len(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 9, 33])
def test_merkle_sizes(spark, n):
    rows = [(k, f"t{k}", "en", "a", k) for k in range(n)]
    same(merkle.proofs(merkle.manifest(spark.createDataFrame(rows, SCHEMA), change=queries._one_more, tier=2)).collect(), proven(rows))


def test_merkle_many_groups(spark):
    rows = [(k, f"t{k}", f"l{k % 11}", "a", k) for k in range(40)] + [(0, "t", None, None, None)]
    same(merkle.proofs(merkle.manifest(spark.createDataFrame(rows, SCHEMA), change=queries._one_more, tier=3)).collect(), proven(rows))


def print_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", az(text)) if x]
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """The least id of each document's component, over all pairs of fingerprints."""
    distinct = sorted(set(p for _, p in prints))
    parent = {p: p for p in distinct}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[find(p)] = min(d, low.get(find(p), d))
    return [(d, f"{p:016x}", low.get(find(p), d)) for d, p in prints]


def test_simhash(docs):
    want = linked([(r[0], print_of(r[1])) for r in ROWS])
    same(simhash.simhash_components(docs).collect(), want)
    same(simhash.simhash_components(docs, long=2).collect(), want)
    assert len({c for _, _, c in want}) < len(want) - 20


def test_hash_is_that_of_spark(spark):
    """The same hash as the engine's own, which has the same seed."""
    for text in ("a b c", "Ünïcode ist … gut", ""):
        assert spark.sql(f"SELECT xxhash64('{text}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(text, seed=42)


@pytest.mark.parametrize("long", [64, 3])
def test_links_by_bits(spark, long):
    """Fingerprints around a few centres, so that many are 0 to 4 bits apart in all bytes; long postings give the same classes."""
    rng = random.Random(9)
    prints = {0, 2**64 - 1}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(40):
            p = centre
            for _ in range(rng.randrange(5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    edges = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), long).collect()
    assert all((a ^ b).bit_count() <= 2 or ((a ^ b) % 2**64).bit_count() <= 2 for a, b in edges)
    if long == 64:
        assert len(edges) >= len(prints) // 2
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in edges:
        parent[find(a % 2**64)] = find(b % 2**64)
    want = {p: c for (p, _, c) in linked([(p, p) for p in prints])}
    same_class = lambda of: sorted(sorted(p for p in prints if of(p) == c) for c in {of(p) for p in prints})
    assert same_class(find) == same_class(want.get)


def test_all_bits_of_two_meet_under_a_key():
    for a in range(8):
        for b in range(a, 8):
            assert any(not {a, b} & set(k) for k in simhash.KEYS)


def test_empty(docs):
    none = docs.where("false")
    assert divergence.divergence(none).count() == merkle.proofs(merkle.manifest(none)).count() == simhash.simhash_components(none).count() == 0


def test_suffix_dedup_takes_few_texts_at_a_time(spark, monkeypatch):
    """No step over whole texts has more than some hundred of them in Python at once, and the session's batches are as before."""
    from evidentia.llm import suffix_dedup

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for step in ("saved", "filed"):
        own = getattr(suffix_dedup, step)
        monkeypatch.setattr(suffix_dedup, step, lambda df, own=own: (seen.append(int(spark.conf.get(name))), own(df))[1])
    docs = spark.createDataFrame([(k, "abcdefgh" * 40 + str(k)) for k in range(20)], "doc_id long, text string")
    assert suffix_dedup.suffix_dedup(docs).count() == 20
    assert seen and max(seen) <= 500 and spark.conf.get(name) == before


def test_tokenizer_keeps_few_words(monkeypatch):
    """A full list of words keeps those at hand only, and ids do not depend on it."""
    import public_tokenizers

    from evidentia.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    texts = [f"alpha beta{k} gamma{k * 7} delta" for k in range(60)]
    monkeypatch.setattr(bpe, "KEPT_WORDS", 10)
    small, large = (bpe.Tokenizer(ranks, bpe.merge_table(ranks), public_tokenizers.PATTERN) for _ in range(2))
    assert [x for t in texts for x in small.texts([t])] == list(large.texts(texts))
    assert len(small.words) < 25 and "alpha" in small.words
    small.close(), large.close()
