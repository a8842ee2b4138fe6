"""Targets and quality gates (TGT1-2, TGT8, FLT1-15, FLT18-20, AGG12, AGG19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers, numeric
from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import text as X
from . import order_stats

COMPACT_TYPES = ("GSM_Rephrased", "GSM_AnsAug", "MATH_Rephrased", "MATH_AnsAug")
VERBOSE_TYPES = ("GSM_FOBAR", "MATH_FOBAR", "GSM_SV", "MATH_SV")
_EQUATION = r"[-0-9\s()+*/.,]+\s*=\s*-?[0-9]+(?:[.,][0-9]+)?"
_STEP = r"[0-9.,]+\s*[+\-*/]\s*[0-9\s+\-*/().,]*\s*=\s*-?[0-9.,]+"


def token_count(text: Column) -> Column:
    """Default token counter: white-space words times 1.3."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(P.WORD)) * 1.3


def computation_chain(response: Column) -> Column:
    """TGT1: the sentences with an equation, from their first digit; null without any."""
    parts = F.filter(F.transform(F.split(response, r"\."), X.strip), lambda s: s.rlike(_EQUATION) & s.rlike("[0-9]"))
    kept = F.transform(parts, lambda s: X.strip(F.regexp_extract(s, r"(?s)([0-9].*)$", 1)))
    return F.nullif(F.array_join(kept, ". "), F.lit(""))


def number_text(x: Column) -> Column:
    """A number as the shortest plain text, integers without a point."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def build_target(response: Column) -> Column:
    """TGT2: chain and answer line; null if the answer isn't a number."""
    return _target(numeric.parse_number(answers.extract_gold(response)), response)


def _target(number: Column, response: Column) -> Column:
    given = F.struct(number.alias("n"), response.alias("r"))
    line = lambda n: F.concat(F.lit("####đáp án là: "), number_text(n))
    return X.let(given, lambda g: F.when(g["n"].isNotNull(), F.concat_ws("\n", computation_chain(g["r"]), line(g["n"]))))


def attach_targets(records: DataFrame, response: str = "response_vi") -> DataFrame:
    """FLT1."""
    out = records.withColumn("_gold", answers.extract_gold(F.col(response))).withColumn("_n", numeric.parse_number(F.col("_gold")))
    out = out.withColumn("target", _target(F.col("_n"), F.col(response))).drop("_gold", "_n")
    # The row number keeps Catalyst from copying the target's definition into the filter, where it would be worked out again.
    out = out.withColumn("_row", F.monotonically_increasing_id())
    return out.filter((F.col("_row") >= 0) & F.col("target").isNotNull() & (answers.count_anchors(F.col("target")) == 1)).drop("_row")


def unit_hash(*key: Column) -> Column:
    """A stable number in [0, 1) from a key, in place of a random one."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def type_gate(type_: Column, tokens: Column, u: Column, most: int = 100, rate: float = 0.15) -> Column:
    """FLT2."""
    return F.coalesce(type_.isin(*COMPACT_TYPES) | (type_.isin(*VERBOSE_TYPES) & ((tokens <= most) | (u < rate))), F.lit(False))


def extractable(target: Column) -> Column:
    return numeric.parse_number(answers.extract_answer(target)).isNotNull()


def short_chain(target: Column, most: int = 4) -> Column:
    return F.regexp_count(F.coalesce(target, F.lit("")), F.lit(_STEP)) <= most


def concise(target: Column, most: int = 256, tokens=token_count) -> Column:
    return tokens(target) <= most


def verified(target: Column, threshold: float = 1.0) -> Column:
    return numeric.arithmetic_score(X.clean_math_text(target)) >= threshold


def fits(query: Column, target: Column, longest: int = 256, shortest: int = 20, tokens=token_count) -> Column:
    r = tokens(X.strip(target))
    return (tokens(X.build_prompt(query)) + r + 1 <= longest) & (r >= shortest)


def family(type_: Column, name: str) -> Column:
    """FLT9; the empty family takes all."""
    return F.lit(True) if not name else F.startswith(F.upper(F.coalesce(type_, F.lit(""))), F.lit(name.upper()))


def stages(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """The name of the first gate that a row fails, null if it passes all."""
    reason = F.lit(None).cast("string")
    for name, gate in reversed(gates):
        reason = F.when(~F.coalesce(gate, F.lit(False)), name).otherwise(reason)
    return rows.withColumn("stage_failed", reason)


def stage_accounting(rows: DataFrame, gates: list[tuple[str, Column]]) -> DataFrame:
    """AGG19: rows left after each gate, from one grouped pass."""
    lost = stages(rows, gates).groupBy(F.coalesce("stage_failed", F.lit("")).alias("stage")).agg(F.count("*").alias("lost"))
    names = rows.sparkSession.createDataFrame([(i, n) for i, (n, _) in enumerate([("input", None), *gates])], "stage_no int, stage string")
    full = names.join(F.broadcast(lost), "stage", "left").fillna({"lost": 0})
    total = lost.agg(F.coalesce(F.sum("lost"), F.lit(0)).alias("total"))
    return full.crossJoin(F.broadcast(total)).withColumn("rows_left", F.col("total") - F.sum("lost").over(Window.orderBy("stage_no"))).select("stage_no", "stage", "rows_left")


def reject_reason(query: Column, response: Column, row_idx: Column, start: int = 0, type_: Column | None = None, family_name: str = "") -> Column:
    """FLT10: why an example isn't prepared; null if it is."""
    answer = answers.last_marker_answer(response)
    out = F.when(row_idx < start, "before_start")
    if type_ is not None and family_name:
        out = out.when(~family(type_, family_name), "type_filter")
    out = out.when((F.coalesce(query, F.lit("")) == "") | (F.coalesce(response, F.lit("")) == ""), "missing_text")
    return out.when(F.coalesce(answer, F.lit("")) == "", "missing_answer").when(numeric.parse_number(answer).isNull(), "non_numeric")


def usable(flag: Column, target: Column) -> Column:
    return F.coalesce(flag, F.lit(False)) & (F.coalesce(target, F.lit("")) != "")


def has_operator(text: Column) -> Column:
    return text.rlike(r"[+\-*/×÷=]")


def has_equation_signal(text: Column) -> Column:
    return text.rlike(r"[0-9].*[+\-*/×÷=]|\\frac|=")


def has_arithmetic_signal(text: Column) -> Column:
    return text.rlike(r"[0-9]") & text.rlike(r"[+\-*/×÷=%]")


def has_variable_x(text: Column) -> Column:
    return text.rlike(r"(?i)(?<![A-Za-z])x(?![A-Za-z])")


def clean_target_line(line: Column, allow_x: bool = False) -> Column:
    """FLT13."""
    ok = (F.length(line) <= 180) & ~line.rlike(P.UNI + P.ANY_MARKER) & ~line.rlike(r"(?i)<[^>]+>|```|print\s*\(")
    if not allow_x:
        ok = ok & ~has_variable_x(line)
    return ok & (~line.rlike("[0-9]") | has_operator(line))


def direct_assignment(line: Column, gold: Column) -> Column:
    """FLT14: a line `x = v` with v within 1 % of gold."""
    v = numeric.parse_number(F.nullif(F.regexp_extract(line, r"(?i)^\s*x\s*=\s*(.+?)\s*$", 1), F.lit("")))
    return F.coalesce(F.abs(v - gold) / F.greatest(F.lit(1.0), F.abs(gold)) <= 0.01, F.lit(False))


VALIDATION_ORDER = ("missing_final_answer", "missing_solution_lines", "too_many_solution_lines", "line_too_long", "contains_marker", "contains_markup", "numeric_answer_mismatch", "target_too_long", "solution_lines_without_numeric_signal")


def validation_error(final: Column, gold: Column, lines: Column, most_lines: int = 4, longest_line: int = 220, longest: int = 700) -> Column:
    """FLT15: the first rejection code of a cleaned record, null if it is valid."""
    joined = F.array_join(lines, "\n")
    no_lines = lines.isNull() | (F.size(lines) == 0)
    return (
        F.when(F.coalesce(final, F.lit("")) == "", VALIDATION_ORDER[0]).when(no_lines, VALIDATION_ORDER[1]).when(F.size(lines) > most_lines, VALIDATION_ORDER[2])
        .when(F.exists(lines, lambda x: F.length(x) > longest_line), VALIDATION_ORDER[3]).when(joined.rlike(P.UNI + P.ANY_MARKER), VALIDATION_ORDER[4])
        .when(joined.rlike(r"```|<[A-Za-z/]"), VALIDATION_ORDER[5]).when(~numeric.numbers_match(final, gold), VALIDATION_ORDER[6]).when(F.length(joined) > longest, VALIDATION_ORDER[7]).when(~joined.rlike("[0-9]"), VALIDATION_ORDER[8])
    )


def repeated_tags(text: Column) -> Column:
    """FLT16: a reasoning or answer tag more than once."""
    out = F.lit(False)
    for tag in ("<think>", "</think>", "<answer>", "</answer>"):
        out = out | (F.regexp_count(text, F.lit(tag)) > 1)
    return out


def malformed_tags(text: Column) -> Column:
    """FLT16: not exactly one think block before one answer block."""
    return repeated_tags(text) | ~text.rlike(r"(?s)<think>.*?</think>.*?<answer>.*?</answer>")


def repetitive(text: Column, trigrams: Column | None = None) -> Column:
    """FLT18: 40 words or more, with a trigram 4 times or a line 3 times. trigrams: their largest count, where it is known."""
    trigrams = S.max_trigram_count(text) if trigrams is None else trigrams
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(P.WORD))
    return (words >= 40) & ((trigrams >= 4) | (S.max_line_count(text) >= 3))


def head(rows: DataFrame, most: int | None) -> DataFrame:
    """FLT19: the first rows by row_idx; 0 and None take all."""
    return rows.filter(F.col("row_idx") < most) if most else rows


def solution_target(lines: Column, answer: Column) -> Column:
    """TGT8: lines and the answer line; without lines the answer line alone."""
    return F.concat_ws("\n", F.nullif(F.array_join(F.coalesce(lines, F.array().cast("array<string>")), "\n"), F.lit("")), F.concat(F.lit("####đáp án là: "), answer))


def shorten_reasoning(text: Column, sentences: int = 4, longest: int = 450) -> Column:
    """TGT3: without the answer's tail, the first sentences, cut at a word's edge."""
    body = F.array_join(F.slice(X.split_sentences(answers.without_answer_tail(text)), 1, sentences), " ")
    cut = F.regexp_replace(F.substring(body, 1, longest), r"\s+\S*$", "")
    return F.when(F.length(body) <= longest, body).otherwise(cut)


def split_clauses(text: Column) -> Column:
    """TGT6: clauses of a solution."""
    return F.filter(F.transform(X.split_at(text, r"(?U)\n+|(?<=[.!?。;])\s+|,\s+(?=(?:nên|vậy|do đó|suy ra))"), X.strip), lambda s: s != "")


def gold_parses(response: Column) -> Column:
    """FLT6: the gold answer can be read as a number."""
    return F.coalesce(numeric.parse_number(answers.extract_answer(response)).isNotNull(), F.lit(False))


def train_candidates(rows: DataFrame, most: int | None = None, query: str = "query_vi", response: str = "response_vi") -> DataFrame:
    """FLT17: rows with both texts and a numeric gold answer; of these the first by row_idx, all with None."""
    said = lambda c: X.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    kept = rows.filter(said(query) & said(response)).filter(gold_parses(F.col(response)))
    return kept if most is None else kept.orderBy("row_idx").limit(most)


def target_decisions(records: DataFrame, target: str = "target", kind: Column | None = None, response: str = "response_vi", numeric_only: bool = True) -> DataFrame:
    """What becomes of each built target: decision (kept, skipped, anchor_error) and, of kept ones, target_kind.

    A target must stand for a gold answer (a number with numeric_only) and hold one answer anchor.
    """
    text = F.coalesce(F.col(target), F.lit(""))
    has_gold = gold_parses(F.col(response)) if numeric_only else answers.extract_answer(F.col(response)).isNotNull()
    decision = F.when(~has_gold | (text == ""), "skipped").when(answers.count_anchors(text) != 1, "anchor_error").otherwise("kept")
    named = F.nullif(kind, F.lit("")) if kind is not None else F.lit(None).cast("string")
    shape = F.when(text.startswith(P.TARGET_ANCHOR), F.coalesce(named, F.lit("answer_only"))).when(text.rlike(P.PROGRAM_STEP), F.lit("fdd_lite_pot")).otherwise(F.coalesce(named, F.lit("equation_short")))
    return records.select("*", decision.alias("decision"), F.when(decision == "kept", shape).alias("target_kind"))


def target_report(decided: DataFrame, target: str = "target") -> DataFrame:
    """AGG12: counts of decisions and length percentiles of kept targets; anchor errors count as skipped too."""
    kept = F.col("decision") == "kept"
    head = decided.agg(F.count("*").alias("input_records"), F.count_if(kept).alias("kept_records"), F.count_if(~kept).alias("skipped_records"), F.count_if(F.col("decision") == "anchor_error").alias("anchor_errors"))
    shares, names = (0.5, 0.9, 0.95, 0.99), [f"chars_p{q}" for q in (50, 90, 95, 99)]
    at = order_stats.quantiles(order_stats.value_counts(decided, F.when(kept, F.length(target))), shares, names=names)
    return head.join(F.broadcast(at), how="left")  # one row


def target_kinds(decided: DataFrame) -> DataFrame:
    """AGG12: how many targets of each kind are kept."""
    return decided.filter("decision = 'kept'").groupBy("target_kind").agg(F.count("*").alias("n"))
