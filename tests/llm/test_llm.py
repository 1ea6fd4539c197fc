"""The training-text operators against brute force, on a table with the cases that break things."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from evidentia.llm import bpe, chat, exact_dedup, langid, licenses, mixing, ngram_join, quality, sharding, suffix_dedup

random.seed(5)
WORDS = ["der", "und", "the", "of", "le", "et", "ciudad", "straße", "naïve", "house", "x1", "42", "…", "a\tb"]


def words(n):
    return " ".join(random.choice(WORDS) + str(random.randrange(50)) * (random.random() < 0.5) for _ in range(n))


BASE = words(300)
NEAR = BASE.split(" ")
NEAR[7] = "changed"
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE.upper(), "en", "a"), (4, " ".join(NEAR), "de", "b"), (5, None, "en", None), (6, "", None, "b"), (7, " \t\n ", "en", "c"),
    (8, "one two", "en", "c"), (9, "One two", "en", "c"), (10, words(2000) + "\n" + BASE[:250], "fr", "a"), (11, "12 34 !!", "fr", "a"), (None, words(40), "es", "b"), (None, None, None, None),
    (13, "same same " * 60, "es", "a"), (13, "same same " * 60, "es", "a"), (14, "Released under the MIT License.\nAll rights reserved.\nGNU General\nPublic License text", "en", "a"), (15, "aaaa" * 700, "en", "b"),
    *[(100 + k, words(60 + k), "en", "a") for k in range(20)],
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators use inside.
    return spark.createDataFrame([(*r, "x", 1.0, "y") for r in ROWS], SCHEMA + ", fp string, n double, t string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def az(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(b):
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def same(got, want):
    key = lambda r: repr(r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_tables(empty, spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    for f in (langid.identify, quality.quality_rules, ngram_join.ngram_components, ngram_join.one_of_each, sharding.shard_documents, licenses.license_scan, mixing.mix_sources, mixing.mixture, exact_dedup.exact_dedup, exact_dedup.drop_copies, suffix_dedup.suffix_dedup, langid.keep_identified):
        assert f(empty).count() == 0, f.__name__
    assert bpe.bpe(empty, path, pattern).count() == 0 and chat.chat_digest(turns).count() == 0


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] <\\|end|> <|end|>\\ <<SYS>> [\\\\INST] \U0001f600\n"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "no"), (3, 0, "user", "hi"), (4, 0, None, None), (4, 1, "assistant", hard), (5, 0, "user", "hi"), (5, 1, "assistant", "yes"), (5, 2, "assistant", None), (None, 0, "user", "q"),
            *[(k, t, ("user", "assistant")[t % 2], f"{t if t < 3 else (k % 4, t)}") for k in range(10, 40) for t in range(6)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want, by = [], defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    for c, ts in by.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        want.append((c, len(ts), sha("".join(f"{r}\n{x}\n" for _, r, x in ts)), len(loss), sha(loss), sum(len(chat.render(r, x)[0]) for _, r, x in ts)))
    same(chat.chat_digest(turns).collect(), want)
    assert chat.unescape(chat.escape(hard)) == hard and "<|" not in chat.escape(hard)
    # Each prefix once; places tile each tree depth first; intervals are the ancestors'.
    nodes = chat.prefix_trees(chat.conversations(turns)).collect()
    assert len(nodes) == len({tuple((r, x) for _, r, x in ts[: k + 1]) for ts in by.values() for k in range(len(ts))})
    known = {bytes(n.node): n for n in nodes}
    trees = defaultdict(list)
    for n in nodes:
        trees[bytes(n.tree)].append(n)
        seen, up = set(), n
        while up.parent is not None:
            up = known[bytes(up.parent)]
            seen |= set(range(up.start, up.start + up.length))
        assert {i for a in n.ancestors for i in range(a.start, a.end)} == seen and n.position == len(seen)
    for tree in trees.values():
        at = 0
        for n in sorted(tree, key=lambda n: n.start):
            assert n.start == at
            at += n.length


def test_bpe(docs):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ranks = bpe.read_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in ROWS:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(r[1] or ""), ids, (r[1] or "").encode()))
    got = bpe.bpe(docs, path, pattern, outputs=("ids", "decoded")).collect()
    same([(*r[:4], list(r[4]), bytes(r[5])) for r in got], want)
    # Long words take the other query.
    t = bpe.Tokenizer(ranks, bpe.merge_table(ranks), pattern)
    rare = ["".join(random.choice("abcdeé") for _ in range(500)), "ab" * 400, "a" * 999]
    assert [x.tolist() for x in t.encode_words([w.encode() for w in rare])] == [enc.encode_ordinary(w) for w in rare]
    t.close()


@pytest.mark.parametrize("limits", [{}, {"hot": 2, "shard_bytes": 3000}])
def test_suffix_dedup(docs, limits):
    texts = [(r[1] or "").encode() for r in ROWS]
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for r, t in zip(ROWS, texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(t, gone) if not g))))
    same(suffix_dedup.suffix_dedup(docs, **limits).collect(), want)


def test_shards():
    for _ in range(60):
        n = random.choice([3, 8, 9])
        a, b = ([bytes(random.choice(b"ab") for _ in range(random.randint(n, 30))) for _ in range(4)] for _ in range(2))
        one, two = suffix_dedup.Shard(a, n), suffix_dedup.Shard(b, n)
        here, there = one.find(two)
        count = Counter(x[i : i + n] for x in a for i in range(len(x) - n + 1))
        for texts, shard, flags, test in ((a, one, here, {y[i : i + n] for y in b for i in range(len(y) - n + 1)}.__contains__), (b, two, there, count.__contains__), (a, one, one.repeated(), lambda w: count[w] > 1)):
            for x, s, e in zip(texts, shard.starts, shard.ends):
                assert flags[s : e - n + 1].tolist() == [test(x[i : i + n]) for i in range(len(x) - n + 1)]


def test_language(docs, spark):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {None, 5, 6, 7, 11}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    # Held-out accuracy on texts of two vocabularies, one text longer than a block.
    rows = [(k, " ".join(random.choice(("der die das und nicht", "the of and is not")[k % 2].split()) for _ in range(30 if k else 500_000)), "de en".split()[k % 2]) for k in range(60)]
    held = [r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.held_out]
    assert held and all(r.lang_pred == "de en".split()[r.doc_id % 2] for r in held)
    assert langid.keep_identified(docs).columns == docs.columns


def test_quality(docs):
    want = []
    for r in ROWS:
        t, w = r[1] or "", split(r[1])
        lines = [x for x in t.split("\n") if split(x)]
        places = defaultdict(list)
        for i in range(len(w) - 7):
            places[tuple(w[i : i + 8])].append(i)
        covered = len({j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)})
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), covered, len(w) < 20 or 100 * covered > 30 * len(w)))
    got = quality.quality_rules(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), want)
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert {1, 2, 4, 10} <= kept and 13 not in kept


def components(rows, width, percent):
    sets = []
    for r in rows:
        w = split(az(r[1]))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = defaultdict(list)
    for i in range(len(rows)):
        low[find(i)] += [rows[i][0]] * (rows[i][0] is not None)
    return [(r[0], len(s), min(low[find(i)], default=None) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_ngram_join(docs, spark):
    same(ngram_join.ngram_components(docs).drop("text_md5").collect(), components(ROWS, 4, 85))
    body = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):  # a chain of small changes, so that members far apart link through others only
        body[(k * 7) % 120] = f"c{k}"
        rows.append((k, " ".join(body), "en", "a"))
    df = spark.createDataFrame(rows, SCHEMA)
    want = components(rows, 4, 85)
    same(ngram_join.ngram_components(df).drop("text_md5").collect(), want)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(df, 4, 85).collect())
    assert kept == sorted({c for _, _, c in want})


def test_one_of_each_without_own_ids(spark):
    """Components that share their least id, or have none, each keep a document."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (7, c), (7, d), (8, c), (None, d), (9, a + " z"), (None, "")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(kept, [(None, b), (7, c), (7, d), (9, a + " z"), (None, "")])


def test_ngram_join_family(spark):
    """Members of a family with few to many edits, of which some link with few others only."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(220):
        body = list(base)
        for _ in range(k % 8):
            body[rng.randrange(150) if k % 3 else rng.randrange(20)] = f"e{rng.randrange(60)}"
        rows.append((k, " ".join(body[: 150 - k % 5]), "en", "a"))
    same(ngram_join.ngram_components(spark.createDataFrame(rows, SCHEMA)).drop("text_md5").collect(), components(rows, 4, 85))


def test_sharding(docs, spark):
    for df in (docs, spark.createDataFrame([(k, "hot" if k % 3 == 0 else f"t{k // 2}") for k in range(3000)], "doc_id long, text string")):
        rows = sharding.shard_documents(df).collect()
        n = Counter(r.shard for r in rows)
        assert max(n[s] for s in range(8)) - min(n[s] for s in range(8)) <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
        same([(r.doc_id, r["size"], r.text_crc32) for r in rows], [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect()])
    pairs = defaultdict(set)
    for r in rows:
        if r.doc_id % 3:
            pairs[r.text_crc32].add(r.shard)
    assert sum(len(p) == 1 for p in pairs.values()) > 0.9 * len(pairs)


@pytest.mark.parametrize("size", [2, 5])
def test_sharding_full_of_copies(spark, size):
    """Where every row is linked, nearly all groups still end in one shard."""
    rows = sharding.shard_documents(spark.createDataFrame([(k, f"t{k // size}") for k in range(8000)], "doc_id long, text string")).collect()
    held, where = Counter(r.shard for r in rows), defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert set(held.values()) == {1000} and sum(len(x) > 1 for x in where.values()) < 0.1 * len(where)


def test_licenses(docs):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = []
    for r in ROWS:
        w = token.findall(az(r[1]))
        at = sorted((i, label) for label, p in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        found = {(label, len(s & o) / len(o)) for line in az(r[1]).split("\n") for s in [set(token.findall(line))] for label, x in licenses.TEMPLATES for o in [set(licenses.tokens_of(x))] if len(s & o) >= 0.8 * len(o)}
        base = {x for _, x in at}
        want.append((r[0], len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in found})), 1.0 if base else max((s for _, s in found), default=0.0)))
    same(licenses.license_scan(docs).collect(), want)


def test_licenses_wrapped(spark):
    """Notices wrapped over lines, with marks of comments; and texts that only have their words, or too few of them."""
    body = {label: text for label, text in licenses.TEMPLATES if len(licenses.tokens_of(text)) > 9}
    wrap = lambda text, n, mark: "\n".join(mark + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    rows, want = [], []
    for k, (label, text) in enumerate(body.items()):
        for n in (2, 5):
            rows.append((len(rows), "Copyright (c) 2020 someone\n" + wrap(text.upper() if k % 2 else text, n, " * ") + "\nand more follows"))
            want.append(label)
    rows += [(100, "GNU Lesser\nGeneral Public\nLicense"), (101, "GNU\nGeneral Public\nLicense"), (102, "\nfiller words that are none of its own\n".join(body["bsd"].split()))]
    labels = {r.doc_id: set(r.labels.split(",")) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(label in labels[k] for k, label in enumerate(want))
    assert labels[100] == {"gpl", "lgpl"} and labels[101] == {"gpl"} and "bsd" not in labels[102]


def test_mixing(docs, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    rows = mixing.mix_sources(docs, labels).collect()
    same([(r.doc_id, r["size"]) for r in rows], [(r[0], len(split(r[1]))) for r in ROWS])
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(split(r[1]))
    total, weights = sum(sizes.values()), {s: k % 3 + 1 for k, s in enumerate(sorted((s for s in sizes if s), key=str) + [None])}
    target = {s: 0.0 for s in sizes}
    left, open_ = float(total), set(sizes)
    while True:  # give by weight, cap, share the excess
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: level * weights[s] for s in open_}
    by_size = {sizes[s]: target[s] for s in sizes}
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source_size] += r.taken
    for s in sizes:
        assert abs(taken[sizes[s]] - target[s]) <= 1
    same(mixing.mix_sources(docs.repartition(5), labels).collect(), [tuple(r) for r in rows])
    mixed = mixing.mixture(docs, labels)
    held, given, longest = Counter(), Counter((r[0], r[1], r[3]) for r in ROWS), Counter()
    for r in ROWS:
        longest[r[3]] = max(longest[r[3]], len(split(r[1])))
    for r in mixed.collect():
        assert given[r.doc_id, r.text, r.source]  # whole, with its lines
        held[r.source] += len(split(r.text))
    assert mixed.columns == docs.columns
    for s in sizes:
        assert abs(held[s] - target[s]) <= longest[s] / 2 + 1


def test_exact_dedup(docs):
    groups = defaultdict(list)
    for r in ROWS:
        groups[az(r[1])].append(r[0])
    rows = exact_dedup.exact_dedup(docs).collect()
    want = {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}
    same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows], [(r[0], *want[az(r[1])], sha(az(r[1]))) for r in ROWS])
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(sha(t) for t in groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = exact_dedup.drop_copies(docs).collect()
    assert Counter(az(r.text) for r in left) == Counter(groups.keys())


def test_pipeline(spark, docs, tmp_path):
    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(len(r.ids) == r.n_tokens for r in out)
    # 1 equals 2, and 4 is near 2; 3 equals neither (its capitals are not only A to Z). 8 equals 9; the others have no letter.
    ids = {r.doc_id for r in out}
    assert ids <= {r[0] for r in ROWS} - {1, 4, 5, 6, 7, 8, 11} and {2, 3} <= ids


CLASHES = "size part epochs _id _stays _row _copy _text_md5 _lang_pred _score _n _md5 _nth _column0".split()


def test_clashing_columns(spark, docs):
    """Stages give the same rows whatever the other columns are called, and those columns as they were."""
    plain = docs.select("doc_id", "text", "lang", "source").where("doc_id is not null")
    clashing = plain.selectExpr("*", *[f"concat(doc_id, '{c}') as {c}" for c in CLASHES])
    for f in (langid.keep_identified, exact_dedup.drop_copies, mixing.mixture, ngram_join.one_of_each):
        got = f(clashing).collect()
        assert all(r[c] == f"{r.doc_id}{c}" for r in got for c in CLASHES), f.__name__
        same([r[:4] for r in got], [tuple(r) for r in f(plain).collect()])


def test_suffix_dedup_family(spark):
    """Near copies, a text that repeats itself, one past a block of two megabytes, and copies, against brute force."""
    own = random.Random(11)
    base = bytes(own.choice(b"abcdefgh ") for _ in range(2500)).decode()
    texts = [base[:k] + "#" + base[k + 1 :] for k in range(50, 2450, 300)] + [base, base, "xyz " * 300, base[300:900] + "xyz " * 60, "".join(own.choice("abcdefgh ") for _ in range(2_050_000)) + base[:700]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    want = []
    for k, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want.append((k, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha("".join(c for c, g in zip(t, gone) if not g))))
    del seen
    for limits in ({}, {"hot": 3, "shard_bytes": 3000}):
        same(suffix_dedup.suffix_dedup(rows, **limits).collect(), want)
