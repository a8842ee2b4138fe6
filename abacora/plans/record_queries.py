"""Queries on gold checks, targets, lookups by position and answers that are programs, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import programs
from ..operators import align, curate
from .curation_queries import _LINES, _lines, _queries, _whole
from .scoring_queries import spread, table


def _by_line(texts: dict[int, Column], other: Column) -> Column:
    """A text for each line number named, another for the rest."""
    for n, text in texts.items():
        other = F.when(F.col("l_linenumber") == n, text).otherwise(other)
    return other


def _answered():
    return F.concat(F.lit("lời giải\n####đáp án là: "), _whole())


def _records(spark, sf_dir):
    response = _by_line({1: F.lit("lời giải"), 2: F.lit("lời giải\n####đáp án là: x y z")}, _answered())
    query = _by_line({3: F.lit(" \n")}, F.lit("hỏi"))
    return spread(_lines(spark, sf_dir)).select("*", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), query.alias("query_vi"), response.alias("response_vi"))


def parsing_gold(spark, sf_dir):
    """FLT6."""
    return _records(spark, sf_dir).groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count_if(curate.gold_parses(F.col("response_vi"))).alias("parsed"))


def train_candidates(spark, sf_dir):
    """FLT17."""
    return curate.train_candidates(_records(spark, sf_dir), 100).select("row_idx", "response_vi")


def _decided(spark, sf_dir):
    anchor = F.concat(F.lit("####đáp án là: "), _whole())
    target = _by_line({4: F.lit(""), 5: F.lit("a = b"), 6: anchor, 7: F.concat(F.lit("s1 = 2\n"), anchor)}, F.concat(F.lit("a = b\n"), anchor))
    return curate.target_decisions(_records(spark, sf_dir).withColumn("target", target))


def target_report(spark, sf_dir):
    """AGG12."""
    return curate.target_report(_decided(spark, sf_dir))


def target_kinds(spark, sf_dir):
    """AGG12's kinds."""
    return curate.target_kinds(_decided(spark, sf_dir))


def position_lookup(spark, sf_dir):
    """JOIN8: orders look their customer up by position."""
    pred = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_idx"), F.col("c_mktsegment").alias("pred"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("id"))
    return align.lookup_by_position(rows, pred).select("o_orderkey", "pred")


def failure_examples(spark, sf_dir):
    """JOIN9: rows without a gold answer with both records."""
    rows = _records(spark, sf_dir)
    failed = rows.filter(~curate.gold_parses(F.col("response_vi"))).select("row_idx")
    return align.in_original_order(align.with_examples(failed, rows.select("row_idx", F.col("q").alias("pred")), rows.select("row_idx", F.col("response_vi").alias("gold"))))


def program_answers(spark, sf_dir):
    """ANS16."""
    text = {1: F.concat(F.lit("x = "), _whole(), F.lit("\nprint(x, x * 3 - 1)")), 2: F.concat(F.lit("Lời giải:\n```python\nanswer = "), _whole(), F.lit(" / 4\n```\nx")), 3: F.lit("import os\nprint(1)"), 4: F.concat(F.lit("print(2 ** "), _whole(), F.lit(")"))}
    done = programs.execute_program(_by_line(text, F.concat(F.lit("y = max(1, "), _whole(), F.lit(")\nprint(y)\nĐáp án: 7"))))
    return spread(_lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", done.alias("answer"))


def python_expressions(spark, sf_dir):
    """ANS15."""
    text = {1: F.concat(F.lit("$\\frac{"), _whole(), F.lit("}{4}$")), 2: F.concat(_whole(), F.lit(",5")), 3: F.concat(F.lit("2^"), _whole()), 4: F.concat(F.lit("2 \\sqrt{"), _whole(), F.lit("}"))}
    quarter = _whole().cast("double") / 4
    return spread(_lines(spark, sf_dir)).select("l_orderkey", "l_linenumber", programs.expression_to_python(_by_line(text, F.concat(F.lit("(1,000 + "), _whole(), F.lit(") \\times 2")))).alias("code"), programs.numeric_literal(quarter, F.lit("x")).alias("literal"))


QUERIES = _queries(parsing_gold, train_candidates, target_report, target_kinds, position_lookup, failure_examples, program_answers, python_expressions)

_Q = "CAST(CAST(q AS INT) AS VARCHAR)"
_RECORDS = f"""{_LINES}, r AS (SELECT *, l_orderkey * 10 + l_linenumber AS row_idx, 'lời giải' || CASE l_linenumber WHEN 1 THEN '' WHEN 2 THEN chr(10) || '####đáp án là: x y z' ELSE chr(10) || '####đáp án là: ' || {_Q} END AS response_vi FROM l)"""
_DECIDED = f"""{_RECORDS}, t AS (SELECT *, CASE WHEN l_linenumber IN (1, 2, 4) THEN 'skipped' WHEN l_linenumber = 5 THEN 'anchor_error' ELSE 'kept' END AS decision,
  15 + length({_Q}) + CASE l_linenumber WHEN 6 THEN 0 WHEN 7 THEN 7 ELSE 6 END AS chars FROM r)"""
_CHARS = ", ".join(f"quantile_cont(CASE WHEN decision = 'kept' THEN chars::DOUBLE END, {q / 100}) AS chars_p{q}" for q in (50, 90, 95, 99))
ORACLES = {
    "parsing_gold": f"WITH {_LINES} SELECT l_linenumber, count(*) AS n, count(*) FILTER (l_linenumber > 2) AS parsed FROM l GROUP BY 1",
    "train_candidates": f"WITH {_RECORDS} SELECT row_idx, response_vi FROM r WHERE l_linenumber > 3 ORDER BY row_idx LIMIT 100",
    "target_report": f"WITH {_DECIDED} SELECT count(*) AS input_records, count(*) FILTER (decision = 'kept') AS kept_records, count(*) FILTER (decision <> 'kept') AS skipped_records, count(*) FILTER (decision = 'anchor_error') AS anchor_errors, {_CHARS} FROM t",
    "target_kinds": f"WITH {_DECIDED} SELECT CASE l_linenumber WHEN 6 THEN 'answer_only' WHEN 7 THEN 'fdd_lite_pot' ELSE 'equation_short' END AS target_kind, count(*) AS n FROM t WHERE decision = 'kept' GROUP BY 1",
    "position_lookup": "SELECT o_orderkey, c_mktsegment AS pred FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND o_orderkey % 5 <> 0",
    "failure_examples": f"WITH {_RECORDS} SELECT row_idx, q AS pred, response_vi AS gold FROM r WHERE l_linenumber < 3",
    "program_answers": f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(CAST(q AS INT) * 3 - 1 AS VARCHAR) WHEN l_linenumber = 2 THEN CAST(CAST(q AS INT)::DOUBLE / 4 AS VARCHAR) WHEN l_linenumber = 3 THEN NULL WHEN l_linenumber = 4 THEN CASE WHEN q <= 8 THEN CAST(CAST(power(2, CAST(q AS INT)) AS BIGINT) AS VARCHAR) END ELSE CAST(greatest(1, CAST(q AS INT)) AS VARCHAR) END AS answer FROM l",
    "python_expressions": f"WITH {_LINES} SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN '((' || {_Q} || ')/(4))' WHEN 2 THEN {_Q} || '.5' WHEN 3 THEN NULL WHEN 4 THEN '2*sqrt(' || {_Q} || ')' ELSE '(1000+' || {_Q} || ')*2' END AS code, CASE WHEN CAST(q AS INT) % 4 = 0 THEN CAST(CAST(q AS INT) // 4 AS VARCHAR) ELSE CAST(CAST(q AS INT)::DOUBLE / 4 AS VARCHAR) END AS literal FROM l",
}
