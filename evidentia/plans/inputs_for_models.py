"""Queries of what models are given: examples, serialisations, token budgets; and of the tables' checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import text as X
from evidentia.functions import tokens as T
from evidentia.operators import audits, exemplars, folds, relations, sparse
from evidentia.plans import catalog
from evidentia.plans.catalog import QA, absent_, query, toks_, v5_
from evidentia.plans.inputs import qa

# --- examples -------------------------------------------------------------------------------------------------------------

_POOL = f"""{QA}, x AS (SELECT row_idx, label, NOT {absent_('context', 'llm')} AS present, length(coalesce(context, '')) + length(coalesce(prompt, '')) + length(coalesce(response, '')) AS n FROM qa),
md AS (SELECT present, label, median(n) AS m FROM x GROUP BY ALL), pool AS (SELECT present, label, row_number() OVER (PARTITION BY present, label ORDER BY abs(n - m), n, row_idx)::INT AS rank, row_idx FROM x JOIN md USING (present, label) QUALIFY rank <= {exemplars.KEPT})"""


def _measured(spark, sf_dir) -> DataFrame:
    n = sum(F.length(F.coalesce(c, F.lit(""))) for c in ("context", "prompt", "response"))
    return qa(spark, sf_dir).select("row_idx", "label", (~X.is_absent(F.col("context"), "llm")).alias("present"), n.alias("text_length"))


@query(f"WITH {_POOL} SELECT * FROM pool")
def exemplar_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight rows of middle length of each label, with and without a context."""
    return exemplars.pool(_measured(spark, sf_dir))


@query(f"""WITH {_POOL}, k AS (SELECT present::INT * 2 + label AS spot, min(row_idx) FILTER (rank = 1) AS one, min(row_idx) FILTER (rank = 2) AS two FROM pool GROUP BY ALL), s AS (SELECT q.row_idx, spot, CASE WHEN q.row_idx = one THEN two ELSE one END AS example FROM qa q CROSS JOIN k)
SELECT s.row_idx, sha256(string_agg('Prompt: ' || coalesce(e.prompt, '') || chr(10) || 'Response: ' || coalesce(e.response, '') || chr(10) || 'Correct label: ' || e.label, chr(10) || chr(10) ORDER BY spot)) AS examples_sha256, count(*) AS n FROM s JOIN qa e ON e.row_idx = s.example GROUP BY s.row_idx""")
def exemplars_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The examples that each row is shown, none of them itself."""
    rows = _measured(spark, sf_dir)
    block = F.concat(F.lit("Prompt: "), F.coalesce("prompt", F.lit("")), F.lit("\nResponse: "), F.coalesce("response", F.lit("")), F.lit("\nCorrect label: "), F.col("label").cast("string"))
    shown = sparse.filed(exemplars.shown(rows, sparse.filed(exemplars.pool(rows))))
    texts = exemplars.prompts(qa(spark, sf_dir).select("row_idx", block.alias("block")), shown)
    return texts.select("row_idx", F.sha2("examples", 256).alias("examples_sha256")).join(shown.groupBy("row_idx").agg(F.count("*").alias("n")), "row_idx")


# --- serialisations -------------------------------------------------------------------------------------------------------

_PC = QA + f", pc AS (SELECT row_idx, coalesce(prompt, '') AS p, coalesce(context, '') AS c, coalesce(response, '') AS r, NOT {absent_('context', 'v4')} AS present FROM qa)"
_LAYOUTS = {
    "compatible": ("'[PROMPT]' || chr(10)", "chr(10) || chr(10) || '[CONTEXT_PRESENT]' || chr(10) || present::INT || chr(10) || chr(10) || '[CONTEXT]' || chr(10)", "'[RESPONSE]' || chr(10)", "CASE WHEN present THEN c ELSE '' END"),
    "structured": ("'[QUESTION]' || chr(10)", "chr(10) || chr(10) || '[CONTEXT]' || chr(10) || CASE WHEN present THEN '' ELSE '[NULL]' END", "'[ANSWER]' || chr(10)", "CASE WHEN present THEN c ELSE '' END"),
    "routed": ("'[QUESTION]' || chr(10)", "CASE WHEN present THEN chr(10) || chr(10) || '[EVIDENCE]' || chr(10) ELSE '' END", "'[CLAIM]' || chr(10)", "CASE WHEN present THEN c ELSE '' END"),
}


def _parts(spark, sf_dir) -> DataFrame:
    rows = qa(spark, sf_dir)
    return rows.select("row_idx", *[F.coalesce(n, F.lit("")).alias(x) for n, x in (("prompt", "p"), ("context", "c"), ("response", "r"))], (~X.is_absent(F.col("context"), "v4")).alias("present"))


@query(f"WITH {_PC} " + " UNION ALL ".join(f"SELECT row_idx, '{name}' AS layout, sha256({a} || p || {b} || {c}) AS a_sha256, sha256({r} || r) AS b_sha256 FROM pc" for name, (a, b, r, c) in _LAYOUTS.items()))
def prepared_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both parts of each row in the three layouts."""
    t = _parts(spark, sf_dir)
    each = [F.struct(F.lit(n).alias("layout"), X.prepared(F.col("p"), F.col("c"), F.col("r"), F.col("present"), n).alias("x")) for n in _LAYOUTS]
    return t.select("row_idx", F.inline(F.array(*each))).select("row_idx", "layout", F.sha2("x.a", 256).alias("a_sha256"), F.sha2("x.b", 256).alias("b_sha256"))


@query(f"WITH {QA} SELECT row_idx, '[QUESTION] ' || {v5_('prompt')} || chr(10) || '[ANSWER] ' || {v5_('response')} AS marked FROM qa")
def field_marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa(spark, sf_dir).select("row_idx", sparse.field_marked(F.col("prompt"), F.col("response")).alias("marked"))


_CUT = lambda x, n: f"CASE WHEN {n} <= 0 THEN [] WHEN len({x}) <= {n} THEN {x} ELSE list_concat({x}[1:round_even({n} * 0.5, 0)::INT], {x}[len({x}) - ({n} - round_even({n} * 0.5, 0)::INT) + 1 : len({x})]) END"
_BUDGET = "".join(
    f", {n}_b AS (SELECT row_idx, {toks_(a)} AS ma, {toks_(b)} AS mb, {toks_(r)} AS mr, {toks_('p')} AS tp, CASE WHEN present THEN {toks_('c')} ELSE [] END AS tc, {toks_('r')} AS tr FROM pc), {n}_k AS (SELECT *, {_CUT('tp', 80)} AS kp, {_CUT('tr', 96)} AS kr, 253 - len(ma) - len(mb) - len(mr) - len(kp) - len(kr) AS room, {_CUT('tc', 'room')} AS kc FROM {n}_b)"
    for n, (a, b, r, c) in _LAYOUTS.items())


@query(f"WITH {_PC}{_BUDGET} " + " UNION ALL ".join(f"SELECT row_idx, '{n}' AS layout, len(tp)::INT AS prompt_original, len(kp)::INT AS prompt_retained, len(tc)::INT AS context_original, len(kc)::INT AS context_retained, len(tr)::INT AS response_original, len(kr)::INT AS response_retained, sha256(array_to_string(list_concat(ma, kp, mb, kc), ' ')) AS a_sha256, sha256(array_to_string(list_concat(mr, kr), ' ')) AS b_sha256, (3 + len(ma) + len(kp) + len(mb) + len(kc) + len(mr) + len(kr))::INT AS total FROM {n}_k" for n in _LAYOUTS))
def field_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each field kept within 256: 80 of the prompt, 96 of the response, and what is left of the context."""
    t, out = _parts(spark, sf_dir), None
    for name in _LAYOUTS:
        x = X.field_budget(F.col("p"), F.col("c"), F.col("r"), F.col("present"), name, T.tokens)
        one = t.select("row_idx", F.lit(name).alias("layout"), x.alias("x")).select("row_idx", "layout", "x.*")
        one = one.withColumns({"total": F.size("a") + F.size("b") + 3, "a_sha256": F.sha2(F.array_join("a", " "), 256), "b_sha256": F.sha2(F.array_join("b", " "), 256)}).drop("a", "b")
        out = one if out is None else out.unionByName(one)
    return out


# --- checks ---------------------------------------------------------------------------------------------------------------


@query("SELECT 0 AS wrong_columns, count(*) FILTER (doc_id IS NULL) AS null_ids, count(*) FILTER (source IS NULL) AS null_prompts, count(*) FILTER (text IS NULL) AS null_responses, (count(*) = 0)::INT AS empty, (SELECT count(*) FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(*) > 1)) AS repeated_ids FROM documents")
def test_frame_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of unlabelled rows, over all documents: source as prompt, text as response."""
    docs = catalog.table(spark, sf_dir, "documents")
    return audits.test_frame(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("context"), F.col("source").alias("prompt_bn"), F.col("text").alias("response_bn")))


@query(f"""WITH RECURSIVE {catalog._FOLDS} SELECT 0::BIGINT AS missing_seeds, 0::BIGINT AS unknown_seeds, sum(abs(5 - k))::BIGINT AS other_folds, (SELECT count(*) FROM (SELECT seed, row_idx FROM fo GROUP BY ALL HAVING count(*) > 1)) AS repeated,
(SELECT count(*) FROM qa q CROSS JOIN (SELECT DISTINCT seed FROM fo) s WHERE NOT EXISTS (SELECT 1 FROM fo WHERE fo.seed = s.seed AND fo.row_idx = q.row_idx)) AS missing, (SELECT count(*) FROM fo WHERE row_idx NOT IN (SELECT row_idx FROM qa)) AS unknown,
(SELECT count(*) FROM (SELECT seed, fold FROM fo GROUP BY ALL HAVING count(DISTINCT label) < 2)) AS one_label_folds, (SELECT count(*) FROM (SELECT seed, root FROM fo GROUP BY ALL HAVING count(DISTINCT fold) > 1)) AS split_groups FROM (SELECT seed, count(DISTINCT fold) AS k FROM fo GROUP BY seed)""")
def fold_assignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.fold_assignments(sparse.filed(catalog._folds(spark, sf_dir)), qa(spark, sf_dir).select("row_idx"), folds.SEEDS, 5)


@query(f"WITH {QA}, {catalog._FP2}, t AS (SELECT text_fp, bool_or(partition = 'official') AS inside, bool_or(partition != 'official') AS outside, count(DISTINCT label) AS n FROM f GROUP BY text_fp) SELECT count(*) FILTER (inside AND outside) AS shared_with_protected, count(*) FILTER (n > 1) AS conflicting_texts FROM t")
def partition_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audits.partition_safety(relations.add_fingerprints(qa(spark, sf_dir)), "partition", "text_fp", "official")
