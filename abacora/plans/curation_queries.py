"""Queries on gates, targets, sampling, reports and clean-up that the other modules do not reach, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as X
from ..operators import audit, curate, reports, select, taxonomy, vote
from .corpus_queries import _KEY, _STRIP, _WORDS
from .scoring_queries import _SCORED, _round, _scored, spread, table

def _text():
    return F.col("text")


def _whole():
    return F.col("q").cast("int").cast("string")


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars"))


def _lines(spark, sf_dir):
    """A row per order and line number."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))


#: Lines of a partition where whole orders are sorted with their texts.
LINES_A_TASK = 250_000


def _by_order(lines):
    """lines dealt by order to so many partitions that none grows with the table: what stands above sorts texts within them."""
    parts = max(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-lines.count() // LINES_A_TASK))
    return lines.repartition(parts, "l_orderkey")


_LINES = "l AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2)"


def signal_flags(spark, sf_dir):
    """FLT12, FLT16: signals and tags of every document."""
    flags = {"operator": curate.has_operator(_text()), "equation": curate.has_equation_signal(_text()), "arithmetic": curate.has_arithmetic_signal(_text()), "variable": curate.has_variable_x(_text()), "repeated": curate.repeated_tags(_text()), "malformed": curate.malformed_tags(_text())}
    return _docs(spark, sf_dir).select("doc_id", *[f.alias(k) for k, f in flags.items()])


def length_gates(spark, sf_dir):
    """FLT2, FLT4, FLT5, FLT8, FLT9 with the default token count."""
    kind = F.when(F.col("lang") == "en", "GSM_Rephrased").when(F.col("lang") == "de", "MATH_SV").otherwise("other")
    gates = {"type_gate": curate.type_gate(kind, curate.token_count(_text()), F.lit(1.0), 300), "short_chain": curate.short_chain(_text()), "concise": curate.concise(_text(), 400), "fits": curate.fits(F.lit("a b"), _text(), 400), "gsm": curate.family(kind, "gsm")}
    return _docs(spark, sf_dir).select("doc_id", *[g.alias(k) for k, g in gates.items()])


def reject_reasons(spark, sf_dir):
    """FLT10 over answers made of line numbers and quantities."""
    response = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "không có gì").when(F.col("l_linenumber") == 3, "Đáp án là: nhiều").otherwise(F.concat(F.lit("Ta có. Đáp án là: "), _whole()))
    kind = F.when(F.col("l_linenumber") == 7, "MATH_SV").otherwise("GSM_SV")
    reason = curate.reject_reason(F.lit("q"), response, F.col("l_orderkey"), 50, kind, "GSM")
    return _lines(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("prepared")).alias("reason")).agg(F.count("*").alias("n"))


def voted_strings(spark, sf_dir):
    """VOT3."""
    c = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("sample_idx"), (F.col("q").cast("long") % 3).cast("string").alias("answer"))
    best = vote.voted_string(c)
    ties = c.groupBy("record_id", "answer").agg(F.count("*").alias("n")).groupBy("record_id").agg(F.max("n").alias("votes"))
    return best.join(ties, "record_id").select("record_id", "chosen", "votes")


def rollout_stats(spark, sf_dir):
    """AGG17."""
    r = _lines(spark, sf_dir).select("l_orderkey", (F.col("q").cast("long") % 2).cast("double").alias("reward"))
    return _round(taxonomy.rollout_stats(r, "l_orderkey", "reward"), "reward_mean", "no_signal_group_rate")


def zero_scores_by_type(spark, sf_dir):
    """AGG15, AGG20's type part."""
    rows = _scored(spark, sf_dir).withColumn("row_idx", F.lit(0))
    return taxonomy.error_analysis(rows)[0].join(taxonomy.type_performance(rows).select("type", F.round("mean_score", 6).alias("mean_score")), "type")


def score_classes(spark, sf_dir):
    """AGG8's classes of scored rows."""
    return _scored(spark, sf_dir).groupBy(taxonomy.diagnostic_class().alias("class")).agg(F.count("*").alias("n"))


def normalised_summary(spark, sf_dir):
    """AGG20."""
    return _round(reports.normalised_summary(_scored(spark, sf_dir)), "score_10", "score_pct")


def length_summary(spark, sf_dir):
    """AGG10."""
    d = table(spark, sf_dir, "documents")
    return _round(audit.summarize(d, F.length("text"), {"english": F.col("lang") == "en", "long": F.col("n_chars") > 5000}), "english_rate", "long_rate", "mean", "median")


def type_inspection(spark, sf_dir):
    """AGG11."""
    return _round(audit.inspect(table(spark, sf_dir, "documents").withColumn("type", F.col("lang")).withColumn("row_idx", F.col("doc_id")), "text", 10)[0], "mean_length")


def rewritten_fields(spark, sf_dir):
    """AGG13: how many values two clean-ups change."""
    d = table(spark, sf_dir, "documents").select("text", "source")
    return audit.rewriting_counts(d, ["text", "source"], X.dedup_key)


def quality_scores(spark, sf_dir):
    """QLT1, with TGT8's targets."""
    lines = F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).when(F.col("l_linenumber") == 2, F.array(F.lit("không có"))).otherwise(F.array(F.concat(_whole(), F.lit(" + 1"))))
    target = curate.solution_target(lines, _whole())
    score = select.quality_score(target, lines, F.col("l_linenumber") == 3, F.when(F.col("l_linenumber") == 4, "x").otherwise(_whole()))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", F.md5(target).alias("target_md5"), score.cast("long").alias("quality"))


def train_selection(spark, sf_dir):
    """SEL1: a family's first record of each question in natural order; easy_first by length."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), F.when(F.col("lang") == "en", "GSM_A").otherwise("MATH_B").alias("type"), F.col("text").alias("query"))
    pick = lambda style: select.select_train_records(d, style, 100, "GSM", dedup=True).select(F.lit(style).alias("style"), "row_idx")
    return pick("natural").unionByName(pick("easy_first"))


def promoted_run(spark, sf_dir):
    """SEL2."""
    runs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("name"), F.col("l_linestatus").alias("train_style")).agg(F.count("*").alias("n"), F.round(F.avg("l_discount") * 10, 4).alias("score_10"))
    return select.promote(runs, 0.468, 40, ("F",)).select("name", "train_style", "n", "score_10")


def self_distilled(spark, sf_dir):
    """TGT9."""
    text = F.concat(F.repeat(F.lit("lời giải "), F.col("q").cast("int")), _whole(), F.lit("-"), F.col("l_linenumber").cast("string"))
    lines = _by_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount"))
    c = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d")).select(F.col("l_orderkey").alias("record_id"), F.col("d").alias("rel_error"), text.alias("text"), _whole().alias("answer"))
    return vote.self_distilled(c, 0.05, 200)


def prompts(spark, sf_dir):
    """XF20, XF21, XF22: a digest of every document's prompts."""
    kind = F.when(F.col("lang") == "en", "GSM_SV")
    query = X.first_text(F.lit(""), F.lit(None).cast("string"), _text())
    made = [X.build_prompt(query, s, kind).alias(s) for s in ("plain", "instruction", "typed_instruction", "answer_marker", "typed_answer_marker")]
    return _docs(spark, sf_dir).select("doc_id", *made).select("doc_id", *[F.md5(s).alias(s) for s in ("plain", "instruction", "typed_instruction", "answer_marker", "typed_answer_marker")])


def tagged_turns(spark, sf_dir):
    """XF28, ANS13, FLT16 over turns put into tags."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a "), "role", F.lit(" b</think>\n<answer> "), F.col("turn").cast("string"), F.lit(" </answer>"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("<answer>"), "role", F.lit("</answer>"))).otherwise(F.concat("role", F.lit("<answer><answer>")))
    return c.select("conv_id", "turn", X.tagged_to_vietnamese(t).alias("text"), answers.tagged_answer(t).alias("answer"), curate.malformed_tags(t).alias("malformed"))


def number_counts(spark, sf_dir):
    """ANS10: how many numbers a document holds, and its last."""
    n = answers.numeric_values(_text())
    return _docs(spark, sf_dir).select("doc_id", F.size(n).alias("numbers"), F.try_element_at(n, F.lit(-1)).alias("last"))


def unit_answers(spark, sf_dir):
    """ANS11, XF8, XF25."""
    q = F.concat(_whole(), F.element_at(F.array(*[F.lit(x) for x in (" kg táo", " %", "/2 m", "", "x")]), (F.col("l_linenumber") % 5 + 1).cast("int")))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", answers.strip_units(q).alias("bare"), X.strip_trailing_artifacts(F.concat(_whole(), F.lit(" hue.hue ")), ["hue", "."]).alias("clean"), X.strip_math_delimiters(F.concat(F.lit(r"$\boxed{"), _whole(), F.lit(r"} \times 2$"))).alias("math"))


def assignments(spark, sf_dir):
    """FLT13, FLT14."""
    line = F.concat(F.lit("x = "), _whole())
    ok = curate.direct_assignment(line, F.col("q") + F.col("l_linenumber") / 10)
    clean = curate.clean_target_line(F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("y + ")).otherwise(F.lit("y ")), _whole()))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", ok.alias("assigned"), clean.alias("clean"))


def validation_errors(spark, sf_dir):
    """FLT15: the first rejection code by line number."""
    k, one = F.col("l_linenumber"), F.array(F.concat(_whole(), F.lit(" + 0 = "), _whole()))
    lines = F.when(k == 2, F.array().cast("array<string>")).when(k == 3, F.array_repeat(F.lit("1 + 1"), 5)).when(k == 4, F.array(F.lit("Đáp án là: 3"))).when(k == 5, F.array(F.lit("<b>1</b>"))).otherwise(one)
    code = curate.validation_error(F.when(k == 1, "").otherwise(_whole()), F.when(k == 6, "-1").otherwise(_whole()), lines)
    return _lines(spark, sf_dir).groupBy(F.coalesce(code, F.lit("valid")).alias("code")).agg(F.count("*").alias("n"))


def sentence_counts(spark, sf_dir):
    """XF23, TGT6: sentences and clauses of every document."""
    return _docs(spark, sf_dir).select("doc_id", F.size(X.split_sentences(_text())).alias("sentences"), F.size(curate.split_clauses(_text())).alias("clauses"))


def _queries(*made) -> dict:
    return {f.__name__: f for f in made}


QUERIES = _queries(
    signal_flags, length_gates, reject_reasons, voted_strings, rollout_stats, zero_scores_by_type, score_classes, normalised_summary, length_summary, type_inspection, rewritten_fields,
    quality_scores, train_selection, promoted_run, self_distilled, prompts, tagged_turns, number_counts, unit_answers, assignments, validation_errors, sentence_counts,
)

_Q = "CAST(CAST(q AS INT) AS VARCHAR)"
_STEP = curate._STEP
_TOK = f"({_WORDS} * 1.3::DOUBLE)"
_STRIPPED = _STRIP("text")
ORACLES = {
    "signal_flags": r"""SELECT doc_id, regexp_matches(text, '[+\-*/×÷=]') AS operator, regexp_matches(text, '[0-9].*[+\-*/×÷=]|\\frac|=') AS equation, regexp_matches(text, '[0-9]') AND regexp_matches(text, '[+\-*/×÷=%]') AS arithmetic,
        regexp_matches(text, '(^|[^A-Za-z])[xX]([^A-Za-z]|$)') AS variable, false AS repeated, true AS malformed FROM documents""",
    "length_gates": f"""SELECT doc_id, CASE lang WHEN 'en' THEN true WHEN 'de' THEN {_TOK} <= 300 ELSE false END AS type_gate, len(regexp_extract_all(text, '{_STEP}')) <= 4 AS short_chain, {_TOK} <= 400 AS concise,
        {_TOK} >= 20 AND 6 * 1.3::DOUBLE + {_TOK} + 1 <= 400 AS fits, lang = 'en' AS gsm FROM documents""",
    "reject_reasons": f"""WITH {_LINES} SELECT CASE WHEN l_orderkey < 50 THEN 'before_start' WHEN l_linenumber = 7 THEN 'type_filter' WHEN l_linenumber = 1 THEN 'missing_text' WHEN l_linenumber = 2 THEN 'missing_answer' WHEN l_linenumber = 3 THEN 'non_numeric' ELSE 'prepared' END AS reason, count(*) AS n FROM l GROUP BY 1""",
    "voted_strings": f"""WITH {_LINES}, c AS (SELECT l_orderkey AS record_id, l_linenumber AS i, CAST(CAST(q AS BIGINT) % 3 AS VARCHAR) AS a FROM l), v AS (SELECT record_id, a, count(*) AS n, min(i) AS met FROM c GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN n >= 2 THEN n ELSE 0 END DESC, met) AS place, max(n) OVER (PARTITION BY record_id) AS votes FROM v) SELECT record_id, a AS chosen, votes FROM r WHERE place = 1""",
    "rollout_stats": f"""WITH {_LINES}, g AS (SELECT l_orderkey, sum(CAST(q AS BIGINT) % 2) AS s, count(*) AS n FROM l GROUP BY 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rollouts, round(sum(s) / sum(n), 6) AS reward_mean, round(avg(CASE WHEN s = 0 OR s = n THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_signal_group_rate FROM g""",
    "zero_scores_by_type": f"WITH {_SCORED} SELECT type, count(*) AS n, count(*) FILTER (score = 0) AS score0, round(avg(score), 6) AS mean_score FROM r GROUP BY 1",
    "score_classes": f"WITH {_SCORED} SELECT CASE WHEN score = 10 THEN 'good' WHEN score > 0 THEN 'partial' WHEN NOT extractable THEN 'extraction_failure' WHEN pred_num IS NULL THEN 'parse_failure' ELSE 'wrong_answer' END AS class, count(*) AS n FROM r GROUP BY 1",
    "normalised_summary": f"WITH {_SCORED} SELECT count(*) AS n, CAST(sum(score) AS BIGINT) AS raw_score, count(*) * 10 AS max_raw_score, round(sum(score) / count(*), 6) AS score_10, round(sum(score) / (count(*) * 10), 6) AS score_pct, count(*) FILTER (score = 10) AS exact_count, count(*) FILTER (extractable) AS extractable_count, count(*) FILTER (pred_num IS NOT NULL) AS numeric_pair_count FROM r",
    "length_summary": """WITH d AS (SELECT length(text) AS x, lang, n_chars FROM documents), p AS (SELECT list_sort(list(x)) AS xs FROM d WHERE x IS NOT NULL)
        SELECT count(*) AS n, round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END), 6) AS english_rate, round(avg(CASE WHEN n_chars > 5000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS long_rate, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median, any_value(xs[CAST(floor(0.95 * (len(xs) - 1)) AS INT) + 1]) AS p95 FROM d, p""",
    "type_inspection": "SELECT lang AS type, count(*) AS n, round(avg(length(text)), 6) AS mean_length FROM documents GROUP BY 1",
    "rewritten_fields": f"SELECT 'text' AS field, count(text) AS n, count(*) FILTER (text <> {_KEY}) AS changed FROM documents UNION ALL SELECT 'source', count(source), count(*) FILTER (source <> lower(source)) FROM documents",
    "quality_scores": f"""WITH {_LINES}, t AS (SELECT *, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'không có' || chr(10) ELSE {_Q} || ' + 1' || chr(10) END || '####đáp án là: ' || {_Q} AS target FROM l)
        SELECT l_orderkey, l_linenumber, md5(target) AS target_md5, CAST(CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 2 ELSE 4 END + 1 + CASE WHEN l_linenumber = 3 THEN 0 ELSE 1 END + CASE WHEN l_linenumber = 4 THEN 0 ELSE 2 END AS BIGINT) AS quality FROM t""",
    "train_selection": f"""WITH f AS (SELECT min(doc_id) AS i FROM documents WHERE lang = 'en' AND {_KEY} <> '' GROUP BY {_KEY}), d AS (SELECT doc_id, length(text) AS n FROM documents JOIN f ON doc_id = i)
        SELECT * FROM (SELECT 'natural' AS style, doc_id AS row_idx FROM d ORDER BY doc_id LIMIT 100) UNION ALL SELECT * FROM (SELECT 'easy_first', doc_id FROM d ORDER BY n, doc_id LIMIT 100)""",
    "promoted_run": "WITH r AS (SELECT CAST(l_suppkey AS VARCHAR) AS name, l_linestatus AS train_style, count(*) AS n, round(avg(l_discount) * 10, 4) AS score_10 FROM lineitem GROUP BY 1, 2) SELECT * FROM r WHERE n >= 40 AND score_10 > 0.468 AND train_style <> 'F' ORDER BY score_10 DESC, name LIMIT 1",
    "self_distilled": f"""WITH {_LINES}, c AS (SELECT l_orderkey AS record_id, repeat('lời giải ', CAST(q AS INT)) || {_Q} || '-' || l_linenumber AS text, {_Q} AS answer FROM l WHERE d <= 0.05),
        b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY length(text), text) AS place FROM c) SELECT record_id, CASE WHEN length(text) > 200 THEN '####đáp án là: ' || answer ELSE text END AS target FROM b WHERE place = 1""",
    "prompts": f"""WITH t AS (SELECT doc_id, {_STRIPPED} AS q, CASE WHEN lang = 'en' THEN '[GSM_SV] ' ELSE '[UNKNOWN] ' END AS k, 'Câu hỏi: ' AS h, chr(10) || 'Giải:' || chr(10) AS g, chr(10) || 'Đáp án là: ' AS m FROM documents)
        SELECT doc_id, md5(h || q || g) AS plain, md5('Hãy giải bài toán sau và ghi đáp án cuối cùng.' || chr(10) || h || q || g) AS instruction, md5(k || h || q || g) AS typed_instruction, md5(h || q || m) AS answer_marker, md5(k || h || q || m) AS typed_answer_marker FROM t""",
    "tagged_turns": """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'Lời giải: a ' || role || ' b' || chr(10) || 'Đáp án là: ' || turn WHEN 1 THEN '<answer>' || role || '</answer>' ELSE role || '<answer><answer>' END AS text,
        CASE turn % 3 WHEN 0 THEN CAST(turn AS VARCHAR) WHEN 1 THEN role END AS answer, turn % 3 <> 0 AS malformed FROM conversations""",
    "number_counts": r"""WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '-?[0-9]+(?:[.,][0-9]+)?(?:\s*/\s*[0-9]+(?:[.,][0-9]+)?)?') AS n FROM documents) SELECT doc_id, CAST(len(n) AS INT) AS numbers, n[-1] AS last FROM t""",
    "unit_answers": f"""WITH {_LINES}, t AS (SELECT *, {_Q} AS w FROM l) SELECT l_orderkey, l_linenumber, w || ['', '', '/2', '', 'x'][l_linenumber % 5 + 1] AS bare, w AS clean, w || ' × 2' AS math FROM t""",
    "assignments": f"WITH {_LINES} SELECT l_orderkey, l_linenumber, abs(CAST(q AS INT) - (q + l_linenumber / 10)) / greatest(1.0, abs(q + l_linenumber / 10)) <= 0.01 AS assigned, l_linenumber % 2 = 0 AS clean FROM l",
    "validation_errors": f"""WITH {_LINES} SELECT CASE l_linenumber WHEN 1 THEN 'missing_final_answer' WHEN 2 THEN 'missing_solution_lines' WHEN 3 THEN 'too_many_solution_lines' WHEN 4 THEN 'contains_marker' WHEN 5 THEN 'contains_markup' WHEN 6 THEN 'numeric_answer_mismatch' ELSE 'valid' END AS code, count(*) AS n FROM l GROUP BY 1""",
    "sentence_counts": r"""WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?。])\s+', '\1' || chr(1), 'g'), chr(1)) AS s, regexp_replace(regexp_replace(text, '\n+', chr(1), 'g'), '([.!?。;])[ \t]+', '\1' || chr(1), 'g') AS c FROM documents)
        SELECT doc_id, CAST(len(list_filter(s, lambda x: x <> '')) AS INT) AS sentences, CAST(len(list_filter(string_split(c, chr(1)), lambda x: trim(x) <> '')) AS INT) AS clauses FROM t""",
}
