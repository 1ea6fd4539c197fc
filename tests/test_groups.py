"""Components by stars and families against union-find."""

import random

import pytest
from pyspark.sql import functions as F

from evidentia.errors import LabelConflictError
from evidentia.operators import groups, relations


def found(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {x: find(x) for x in parent}


def of(spark, edges):
    rows = groups.star_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == len({r.v for r in rows})
    return {r.v: r.root for r in rows}


@pytest.mark.parametrize("name", ["chain", "ring", "random", "one", "loops", "two stars"])
def test_components(spark, name):
    rng = random.Random(name)
    order = list(range(200))
    rng.shuffle(order)
    edges = {
        "chain": list(zip(order, order[1:])), "ring": list(zip(order, order[1:] + order[:1])), "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "one": [(5, 3)], "loops": [(1, 1), (2, 3), (3, 2), (2, 3)], "two stars": [(0, k) for k in range(1, 40)] + [(100, k) for k in range(50, 90)] + [(39, 90 - 1)],
    }[name]
    want = {v: c for v, c in found(edges).items() if not all(a == b for a, b in edges if v in (a, b))}
    assert of(spark, edges) == want


def test_no_edges(spark):
    assert groups.star_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_hub(spark):
    """One row next to 100,000 others, and a chain behind one of them."""
    hub = spark.range(100_001).select(F.lit(100_001).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(200_000, 200_050).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    edges = hub.union(chain).union(spark.createDataFrame([(77_777, 200_025)], "src long, dst long"))
    out = groups.star_components(edges)
    assert (out.count(), out.where("root = 0").count()) == (100_002 + 51, 100_002 + 51)


ROWS = [(0, "who", "Ctx one", "yes", 1), (1, "who", "Ctx one", "yes", 1), (2, "who", "Ctx one", "no", 0), (3, "WHO", "another text", "x", 1), (4, "what", "Ctx  one", "z", 0), (5, "where", None, "q", 1),
        (6, "when", "[NULL]", "q", 0), (7, "long prompt of many words that goes on", None, "the same long answer as the other row has", 1), (8, "long prompt of many words that goes on,", None, "the same long answer as the other row has", 1)]
KIND = "row_idx long, prompt string, context string, response string, label int"


def test_families(spark):
    rows = spark.createDataFrame(ROWS, KIND)
    official = groups.official_edges(rows)
    kinds = {(r.kind, r.src, r.dst) for r in official.collect()}
    assert {k for k in kinds if k[0] != "near"} == {("exact", 0, 1), ("pair", 0, 1), ("pair", 0, 2)} and ("near", 7, 8) in kinds
    assert {r.row_idx: r.root for r in groups.families(rows, official).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7}
    v5 = groups.v5_edges(rows)
    own = {r.row_idx: r.root for r in groups.families(rows, v5).collect()}
    assert own == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 6, 7: 7, 8: 7}  # 3 has the prompt, 4 the context; absent contexts link nothing
    named = {r.row_idx: r.group_id for r in groups.name_families(groups.families(rows, v5), "v5-group-").collect()}
    assert named == {k: f"v5-group-{[0, 5, 6, 7].index(r):04d}" for k, r in own.items()}
    audit = groups.group_audit(groups.families(rows, v5), v5).first()
    assert (audit.groups, audit.larger, audit.largest, audit.exact_links, audit.context_links) == (4, 2, 5, 1, 3)


def test_conflicts(spark):
    rows = spark.createDataFrame([*ROWS, (9, "where", None, " q ", 0)], KIND)
    for f in (groups.official_edges, groups.v5_edges):
        with pytest.raises(LabelConflictError):
            f(rows)
        assert f(rows, strict=False).count() > 0


def test_numbering(spark):
    rows = spark.range(0, 5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    got = {r.x: r.n for r in relations.numbered_by(rows, ["x"], "n").collect()}
    assert got == {x: k for k, x in enumerate(sorted(got))} and len(got) == 5000
