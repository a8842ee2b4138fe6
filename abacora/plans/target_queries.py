"""Queries on targets by style, readers and writers, heavy contexts, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, audit, once, runs, targets
from ..sources import records
from .corpus_queries import _STRIP
from .scoring_queries import spread, table


def _solutions(spark, sf_dir):
    """A solution of each kind by line number, over all orders."""
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    s = (F.col("l_quantity").cast("int") + F.col("l_linenumber")).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, say("Ta có ", q, " + ", n, " = ", s, " quả. Đáp án là: ", s)).when(line == 2, say("Gọi x là số. Ta có x + ", n, " = ", s, ", suy ra như thế. Đáp án là: ", q))
        .when(line == 3, say("Ta tính \\frac{", q, "}{", n, "} + 1. Đáp án là: ", q)).when(line == 4, say("Không rõ. Đáp án là: ", q)).when(line == 5, say("Xem ", q, " * ", n, ". Đáp án là: ", q)).when(line == 6, "Không có").otherwise("")
    )
    kinds = F.array(*[F.lit(k) for k in ("GSM_AnsAug", "GSM_SV", "MATH_Rephrased", "MATH_AnsAug", "other", "GSM_SV", "other")])
    return t.select("l_orderkey", "l_linenumber", text.alias("response_vi"), F.element_at(kinds, line.cast("int")).alias("type"))


def target_styles(spark, sf_dir):
    """TGT7: type-specific targets, the rule that gave each, and rejects."""
    made = once.per_value(_solutions(spark, sf_dir), ["response_vi", "type"], lambda t: targets.build(t, "type_specific_equation_targets"))
    return made.select("l_orderkey", "l_linenumber", "target", "target_kind", "reject")


def target_programs(spark, sf_dir):
    """TGT5, TGT7: compact programs of the checked steps."""
    made = once.per_value(_solutions(spark, sf_dir), ["response_vi", "type"], lambda t: targets.build(t, "fdd_pot_compact"))
    return made.select("l_orderkey", "l_linenumber", "target", "target_kind", "reject")


def minimal_reasonings(spark, sf_dir):
    """TGT4, TGT6."""
    reasoning, lines = targets.minimal_reasoning(F.col("response_vi")), F.array_join(targets.equation_lines(F.col("response_vi"), 3), "|")
    made = once.per_value(_solutions(spark, sf_dir), ["response_vi"], lambda t: t.select("*", reasoning.alias("reasoning"), lines.alias("lines")))
    return made.select("l_orderkey", "l_linenumber", "reasoning", "lines")


def _run_rows(spark, sf_dir):
    """Scored rows of runs: a run per five suppliers, with outputs that repeat, quote or hold no answer."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("s"), F.max("l_returnflag").alias("f"))
    line = F.col("l_linenumber")
    score = F.when(line <= 2, 10).when(line == 3, 5).when(line == 4, 1).otherwise(0)
    output = F.when(line == 1, 'Đáp án là: "5').when(line == 6, F.repeat(F.lit("a b c "), 20)).otherwise("x")
    return runs.with_classes(t.select(
        F.concat(F.lit("run-"), (F.col("s") % 5).cast("string")).alias("name"), (F.col("l_orderkey") * 10 + line).alias("row_idx"), F.col("f").alias("type"), score.alias("score"), (line != 7).alias("extractable"), F.lit(1.0).alias("gold_num"), F.when(line != 5, 2.0).alias("pred_num"), output.alias("model_output"),
    ))


def run_classes(spark, sf_dir):
    """AGG8: classes of every run's rows."""
    return runs.class_counts(_run_rows(spark, sf_dir))


def run_failures_by_type(spark, sf_dir):
    """AGG8."""
    return runs.failures_by_type(_run_rows(spark, sf_dir))


def run_examples(spark, sf_dir):
    """AGG8: the first five rows of every class of every run."""
    return runs.class_examples(_run_rows(spark, sf_dir)).select("name", "class", "row_idx", "score", "model_output")


def align_records(spark, sf_dir):
    """JOIN1: orders have an id on every row, so they meet by it."""
    o = table(spark, sf_dir, "orders")
    gold = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("row_idx"), F.col("o_totalprice").alias("gold"))
    pred = o.select(F.col("o_orderkey").alias("id"), (-F.col("o_orderkey")).alias("row_idx"), F.col("o_orderstatus").alias("pred"))
    return align.align(pred, gold, ["pred"], ["gold"])


def frequent_contexts(spark, sf_dir):
    """AGG14: what stands before the last number of documents."""
    return audit.anchor_contexts(table(spark, sf_dir, "documents"), "text").select("context", "n", F.round("share", 6).alias("share"))


def prediction_files(spark, sf_dir):
    """SNK4, SNK5, SNK6: predictions from conversations, cleaned and validated."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.max("text").alias("text"))
    made = c.select(F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_idx"), F.lit("q").alias("query_vi"), F.lit("t").alias("type"), F.concat(F.lit("kết quả. ####đáp án là: "), F.col("turn").cast("string"), F.lit(" "), F.col("text")).alias("model_output"))
    return records.validate_predictions(records.clean_predictions(made)).select("id", "model_output")


QUERIES = {f.__name__: f for f in (target_styles, target_programs, minimal_reasonings, run_classes, run_failures_by_type, run_examples, align_records, frequent_contexts, prediction_files)}

_PARTS = "p AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, CAST(l_linenumber AS VARCHAR) AS n, CAST(CAST(l_quantity AS INT) + l_linenumber AS VARCHAR) AS s FROM lineitem)"
_RUNS = """r AS (SELECT 'run-' || max(l_suppkey) % 5 AS name, l_orderkey * 10 + l_linenumber AS row_idx, max(l_returnflag) AS type, l_linenumber AS line, CASE WHEN l_linenumber <= 2 THEN 10 WHEN l_linenumber = 3 THEN 5 WHEN l_linenumber = 4 THEN 1 ELSE 0 END AS score FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_END = "chr(10) || '####đáp án là: ' || "
ORACLES = {
    "run_classes": f"""WITH {_RUNS} SELECT name, count(*) AS rows, count(*) FILTER (line <= 2) AS good_count, count(*) FILTER (line IN (3, 4)) AS partial_count, count(*) FILTER (line = 7) AS non_extractable_count, count(*) FILTER (line = 5) AS extractable_not_numeric_count,
        count(*) FILTER (line = 6) AS extractable_wrong_count, count(*) FILTER (line = 6) AS repetitive_count, count(*) FILTER (line = 1) AS quoted_answer_count FROM r GROUP BY name""",
    "run_failures_by_type": f"WITH {_RUNS} SELECT name, type, count(*) AS n, count(*) FILTER (score = 0) AS score0, count(*) FILTER (line = 7) AS non_extractable, count(*) FILTER (line = 5) AS bad_parse FROM r GROUP BY 1, 2",
    "run_examples": f"""WITH {_RUNS}, c AS (SELECT *, unnest(CASE line WHEN 1 THEN ['good', 'quoted_answer'] WHEN 2 THEN ['good'] WHEN 3 THEN ['partial'] WHEN 4 THEN ['partial'] WHEN 5 THEN ['extractable_not_numeric'] WHEN 6 THEN ['extractable_wrong', 'repetitive'] ELSE ['non_extractable'] END) AS class FROM r),
        n AS (SELECT *, row_number() OVER (PARTITION BY name, class ORDER BY row_idx) AS k FROM c)
        SELECT name, class, row_idx, CAST(score AS INT) AS score, CASE line WHEN 1 THEN 'Đáp án là: "5' WHEN 6 THEN repeat('a b c ', 20) ELSE 'x' END AS model_output FROM n WHERE k <= 5""",
    "frequent_contexts": f"""WITH t AS (SELECT regexp_extract(text, '(?s)^(.*?)-?[0-9]+(?:[.,][0-9]+)?[^0-9]*$', 1) AS b FROM documents WHERE regexp_matches(text, '[0-9]')), c AS (SELECT {_STRIP("regexp_replace(lower(right(b, 30)), '(?s)^.*[\\n.,]', '')")} AS context FROM t)
        SELECT context, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) AS share FROM c GROUP BY 1 ORDER BY n DESC, context LIMIT 20""",
    "align_records": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS row_idx, o_totalprice AS gold, o_orderstatus AS pred FROM orders",
    "prediction_files": """WITH c AS (SELECT conv_id, turn, max(text) AS text FROM conversations GROUP BY 1, 2)
        SELECT CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn ELSE CAST(conv_id * 1000 + turn AS VARCHAR) END AS id, coalesce('kết quả. ####đáp án là: ' || turn || CASE WHEN text IS NULL THEN NULL ELSE '' END, '') AS model_output FROM c""",
    "target_styles": f"""WITH {_PARTS} SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 1 THEN 'Lời giải ngắn:' || chr(10) || 'Ta có ' || q || ' + 1 = ' || s || ' quả' || {_END} s WHEN 2 THEN 'Phương trình: Ta có x + 2 = ' || s || chr(10) || 'Giải: Ta có x + 2 = ' || s || chr(10) || 'x = ' || q || {_END} q
          WHEN 3 THEN 'Lời giải ngắn:' || chr(10) || 'Ta tính \\frac{{' || q || '}}{{3}} + 1' || {_END} q WHEN 4 THEN '####đáp án là: ' || q WHEN 5 THEN 'Lời giải ngắn:' || chr(10) || 'Xem ' || q || ' * 5' || {_END} q END AS target,
        CASE l_linenumber WHEN 1 THEN 'gsm_equation_short' WHEN 2 THEN 'sv_fobar_variable_equation' WHEN 3 THEN 'math_symbolic_equation_short' WHEN 4 THEN 'math_answer_only' WHEN 5 THEN 'other_equation_short' END AS target_kind,
        CASE l_linenumber WHEN 6 THEN 'no_answer' WHEN 7 THEN 'missing_response' END AS reject FROM p""",
    "target_programs": f"""WITH {_PARTS} SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 1 THEN 'step_1 = ' || q || '+1' || chr(10) || 'answer = step_1' || {_END} s WHEN 2 THEN 'Lời giải ngắn:' || chr(10) || 'Ta có x + 2 = ' || s || {_END} q WHEN 3 THEN 'Lời giải ngắn:' || chr(10) || 'Ta tính \\frac{{' || q || '}}{{3}} + 1' || {_END} q
          WHEN 4 THEN '####đáp án là: ' || q WHEN 5 THEN 'Lời giải ngắn:' || chr(10) || 'Xem ' || q || ' * 5' || {_END} q END AS target,
        CASE l_linenumber WHEN 1 THEN 'program' WHEN 4 THEN 'answer_only' WHEN 6 THEN NULL WHEN 7 THEN NULL ELSE 'equation_short' END AS target_kind,
        CASE l_linenumber WHEN 6 THEN 'no_answer' WHEN 7 THEN 'missing_response' END AS reject FROM p""",
    "minimal_reasonings": f"""WITH {_PARTS} SELECT l_orderkey, l_linenumber,
        CASE l_linenumber WHEN 1 THEN 'Ta có ' || q || ' + 1 = ' || s || ' quả' WHEN 2 THEN 'Ta có x + 2 = ' || s WHEN 3 THEN 'Ta tính \\frac{{' || q || '}}{{3}} + 1' WHEN 5 THEN 'Xem ' || q || ' * 5' ELSE '' END AS reasoning,
        CASE l_linenumber WHEN 1 THEN 'Ta có ' || q || ' + 1 = ' || s || ' quả' WHEN 2 THEN 'Ta có x + 2 = ' || s WHEN 3 THEN 'Ta tính \\frac{{' || q || '}}{{3}} + 1' WHEN 5 THEN 'Xem ' || q || ' * 5' ELSE '' END AS lines FROM p""",
}
