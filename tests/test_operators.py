import pytest
from pyspark.sql import functions as F

from evidentia.errors import DataValidationError, SubmissionError
from evidentia.functions import text as X
from evidentia.functions import tokens as T
from evidentia.operators import audits, features, metrics, relations
from evidentia.plans import catalog
from evidentia.plans.inputs import FIXTURE
from evidentia.sources import sinks, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tokens_break_at_vowel_signs(spark):
    assert one(spark, T.tokens(F.lit("ঢাকা"))) == ["ঢাকা"]
    assert one(spark, T.token_set(F.lit("ঢাকা ২০২৪ ab"))) == ["2024", "ab"]


def test_predicates(spark):
    for value, absent in ((None, True), ("  ", True), ("[NULL]", True), ("<NA>", True), ("0", False), ("[NULL] x", False)):
        assert one(spark, X.is_absent(F.lit(value), "v7")) == absent
    assert one(spark, X.is_absent(F.lit("[NULL]"), "v3")) is False


def test_lexical_features(spark):
    row = features.lexical_features(spark.createDataFrame([("ঢাকা ২০২৪ সালে বড় শহর", "ঢাকা 2024"), ("", "সংখ্যা 7")], "context string, response string")).collect()
    assert (row[0].ctx_present, row[0].word_overlap_ratio, row[0].numbers_supported, row[0].number_overlap_ratio) == (1, 1.0, 1, 1.0)
    assert (row[1].ctx_present, row[1].numbers_supported, row[1].number_overlap_ratio) == (0, 1, 0.0)


def test_longest_common(spark):
    row = features.longest_common(spark.createDataFrame([("abcd", "abxcd"), ("", "q")], "response string, context string")).collect()
    assert [(r.longest_common_subsequence_ratio, r.longest_common_substring_ratio) for r in row] == [(1.0, 0.5), (1.0, 1.0)]


def test_char_wb(spark):
    assert one(spark, T.char_wb_ngrams(F.lit("ab c"), 3, 5)) == [" ab", "ab ", " ab ", " c "]


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, prediction int")
    m = metrics.classification_metrics(rows).first()
    assert (m.tn, m.fp, m.fn, m.tp) == (1, 1, 0, 2) and m.f1_label0 == pytest.approx(2 / 3) and m.f1_label1 == pytest.approx(0.8) and m.accuracy == 0.75
    swept = metrics.threshold_table(spark.createDataFrame([(0, 0.2), (1, 0.8)], "label int, p double"), metrics.grid(20, 80))
    assert metrics.select_threshold(swept, "macro").first().threshold == 0.5


def test_components_and_merge(spark):
    nodes = spark.range(6).withColumnRenamed("id", "row_idx")
    edges = spark.createDataFrame([(4, 3), (3, 1), (5, 2)], "src long, dst long")
    assert {r.row_idx: r.root for r in relations.components(nodes, edges).collect()} == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1, 5: 2}
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, x string")
    assert relations.aligned_merge(a, a.withColumnRenamed("x", "y"), ["k"]).count() == 2
    for wrong in (a.union(a), a.where("k = 1")):
        with pytest.raises(DataValidationError):
            relations.aligned_merge(a, wrong.withColumnRenamed("x", "y"), ["k"])


def test_audits_and_sinks(spark):
    with pytest.raises(DataValidationError):
        audits.require(audits.labeled_frame(spark.createDataFrame([("p", "r", 1)], "prompt string, response string, label int")))
    test = spark.createDataFrame([(1, 10), (2, 10)], "ordinal long, id long")
    good = spark.createDataFrame([(1, 0), (2, 1)], "ordinal long, label int")
    assert [tuple(r) for r in sinks.build_submission(test, good).collect()] == [(1, 10, 0), (2, 10, 1)]
    with pytest.raises(SubmissionError):
        sinks.build_submission(test, good.where("ordinal = 1"))
    assert sinks.private_fields(spark.createDataFrame([((1,),)], "a struct<Rows:int>").schema) == ["a.Rows"]


def test_corpus(spark):
    body = "x" * 60
    lines = spark.createDataFrame([('{"url":"u","text":"t\\n\\n' + body + '"}', 1), ("  ", 2), ('{"url":"u","text":"other\\n\\n' + body + '"}', 3), ('{"url":"v","text":"short"}', 4)], "value string, at int")
    assert [tuple(r) for r in tables.parse_corpus(lines, order=["at"]).collect()] == [("u", "t", body, f"t {body}")]
    for bad in ("not json", "[]", '{"url":"x"}'):
        with pytest.raises(Exception):
            tables.parse_corpus(spark.createDataFrame([(bad, 1)], "value string, at int"), order=["at"]).collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"context": null, "prompt_bn": "p", "response_bn": 7, "label": 1}]')
    assert [tuple(r) for r in tables.read_labeled(spark, str(tmp_path / "a.json")).collect()] == [(None, "p", "7", 1)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "a.json").write_bytes((tmp_path / "a.json").read_bytes())
    assert tables.preferred(tables.files(spark, str(tmp_path)), ["a.json"]).endswith("/a.json")


def test_near_duplicates_of_one_parity(spark, tmp_path):
    """Pairs whose ids are both even or both odd are found too."""
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in ("north", "river"))
    spark.createDataFrame([(2, a), (4, a), (5, b), (7, b), (8, "else")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("near_duplicates", "near_duplicates_all"):
        assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect()) == [(2, 4, 1.0), (5, 7, 1.0)]


@pytest.mark.parametrize("name", ["context_predicates", "normalized_v5", "repaired_text", "tokenised"])
def test_text_queries_run_over_whole_tables(spark, tmp_path, name):
    """Every labeled row of the tables is there, beside the fixture's rows."""
    spark.createDataFrame([(k, f"line {k}\r\nend \x1b[1m{k}", "src3") for k in range(40)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    few = {r[0] for r in FIXTURE}
    got = [r.row_idx for r in catalog.QUERIES[name + "_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([*range(40), *(-1 - i for i in few)])
