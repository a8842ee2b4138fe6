"""Training targets by style and type (TGT4, TGT6, TGT7): a table of rules compiled to one lazy CASE.

A builder is a column over the parts of a record (text, gold answer, its number, checked steps, equation lines); null means that it has
nothing to say and the next rule is asked. build() picks the builders of a style, so parts that no rule of the style reads are
not worked out, and says which rule gave the target or why there is none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, numeric, steps
from ..functions import patterns as P
from ..functions import text as X
from .curate import shorten_reasoning

#: Words that targets are made of.
ANCHOR = "####đáp án là:"
SHORT_SOLUTION = "Lời giải ngắn:"
EQUATION, SOLVED = "Phương trình: ", "Giải: "
NO_REASONING = "Ta tính theo dữ kiện trong đề bài."
PROGRAM_HEAD, RESTORED_HEAD = "# Chuong trinh Python ngan gon de tinh dap an", "# Chuong trinh tinh ngan gon"
#: Types by what their targets are.
VARIABLE_TYPES = ("GSM_SV", "GSM_FOBAR", "MATH_SV", "MATH_FOBAR")
#: Signs of a computation, of any numeric content, and an unknown x between signs that are no letters.
_ARITHMETIC = r"\+|-|\*|/|×|%|\\frac|\\sqrt|\^|[0-9]\s*[xX](?![A-Za-zÀ-ỹ])|(?<![A-Za-zÀ-ỹ])[xX]\s*[/*]"
_NUMERIC = r"[0-9]|=|\\frac|\\sqrt|\\boxed|\+|-|\*|/|%"
_OPERATOR = r"=|\+|-|\*|/|×|%|\\frac"
_LINE_OPERATOR = r"=|\+|-|\*|/|×|%|\\frac|\\sqrt|\^"
_X = r"(?<![A-Za-zÀ-ỹ])[xX](?![A-Za-zÀ-ỹ])"
#: Where a solution's pieces and clauses end.
_PIECES = r"(?U)(?<=[.!?。])\s+|\n+|;|；|(?<=[\])])\s+"
_CLAUSES = r"(?iuU),|，|\s+\b(?:nên|do đó|vậy|khi đó)\b\s+"
_MINIMAL_PIECES = r"(?iuU)(?<=[.!?。])\s+|\n+|;|；|\s+\b(?:vậy|do đó|khi đó)\b\s+"
_MINIMAL_CLAUSES = r"(?iuU),|，|\s+\b(?:và|nên)\b\s+"
_EDGE, _LINE_EDGE = " .。,:;", " .。,:;；"


def _trim(text: Column, signs: str) -> Column:
    return F.regexp_replace(text, f"^[{signs}]+|[{signs}]+\\z", "")


def plain_line(text: Column) -> Column:
    """A line without math delimiters and signs around it."""
    out = F.regexp_replace(X.normalize_space(text), r"\$|\\left|\\right", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\\cdot|\\times", "×"), r"\\boxed\{([^{}]+)\}", "$1")
    return _trim(X.normalize_space(out), " .。;；")


def clauses(text: Column) -> Column:
    """TGT6: clauses of a solution without its answer, as plain lines."""
    pieces = X.split_at(answers.without_answer_tail(text), _PIECES)
    return F.filter(F.transform(F.flatten(F.transform(pieces, lambda p: X.split_at(p, _CLAUSES))), plain_line), lambda s: s != "")


def _around(line: Column, pattern: str, longest: int, before: int, after: int, signs: str) -> Column:
    """A long line cut to what stands around its first operator."""
    at = F.regexp_instr(line, F.lit(pattern))
    start = F.greatest(at - 1 - before, F.lit(0))
    end = F.least(F.length(line), at - 1 + F.length(F.regexp_extract(line, pattern, 0)) + after)
    return F.when((F.length(line) > longest) & (at > 0), _trim(F.substring(line, start + 1, end - start), signs)).otherwise(line)


def _distinct(lines: Column) -> Column:
    """Lines that differ from all before them but for letter case."""
    return X.let(F.struct(lines.alias("l"), F.transform(lines, F.lower).alias("k")), lambda s: F.filter(s["l"], lambda x, i: F.array_position(s["k"], F.lower(x)) == i + 1))


def _within(lines: Column, longest: int) -> Column:
    """The first lines whose text, joined by line ends, is at most so long."""
    ends = lambda l: F.aggregate(l, F.struct(F.array().cast("array<int>").alias("all"), F.lit(-1).alias("n")), lambda s, x: F.struct(F.concat(s["all"], F.array(s["n"] + 1 + F.length(x))).alias("all"), (s["n"] + 1 + F.length(x)).alias("n")), lambda s: s["all"])
    return X.let(lines, lambda l: X.let(ends(l), lambda e: F.filter(l, lambda x, i: F.get(e, i) <= longest)))


def equation_lines(text: Column, most: int = 3, variable: bool = False, longest: int = 300) -> Column:
    """TGT6: the first clean clauses that compute something, shortened around their operator, each once, up to a length in all."""
    markers = P.UNI + P.ANY_MARKER

    def clean(s: Column) -> Column:
        ok = s.rlike(r"[0-9]|\\frac|\\sqrt|=") & (F.length(s) <= 180) & ~s.rlike(markers) & ~s.rlike(r"(?i)<[^>]+>|```|print\s*\(") & (~s.rlike("[0-9]") | s.rlike(_ARITHMETIC))
        return ok & s.rlike(_X) if variable else ok

    found = F.transform(F.filter(clauses(text), clean), lambda s: _around(s, _LINE_OPERATOR, 120, 55, 80, _LINE_EDGE))
    return _within(F.slice(_distinct(found), 1, most), longest)


def variable_lines(lines: Column, assigned: Column) -> Column:
    """TGT6: equation and solve of an unknown, from lines and which of them state the answer; null without an equation.

    The equation is the first computing line that states no answer; the step that solves it is the first line after a stated answer or after the equation, else the equation itself.
    """
    tagged = F.zip_with(lines, assigned, lambda x, a: F.struct(x.alias("x"), a.alias("a")))

    def step(s: Column, line: Column) -> Column:
        x, states = line["x"], F.coalesce(line["a"], F.lit(False))
        opens = ~states & s["equation"].isNull() & x.contains("=") & x.rlike(_ARITHMETIC)
        ends = (states | (s["equation"].isNotNull() & x.contains("="))) & s["solve"].isNull() & ~opens
        # With a step and an equation found nothing more is read.
        over = s["over"]
        solve = F.when(~over & ends, x).otherwise(s["solve"])
        return F.struct(F.when(~over & opens, x).otherwise(s["equation"]).alias("equation"), solve.alias("solve"), (over | (~states & ends)).alias("over"))

    none = F.lit(None).cast("string")
    out = F.aggregate(tagged, F.struct(none.alias("equation"), none.alias("solve"), F.lit(False).alias("over")), step)
    return X.let(out, lambda s: F.when(s["equation"].isNotNull(), F.struct(s["equation"].alias("equation"), F.coalesce(s["solve"], s["equation"]).alias("solve"))))


def focused_reasoning(text: Column, longest: int = 700, parts: int = 6) -> Column:
    """TGT4: pieces with numbers or signs, the first and last of them, cut at a blank."""
    body = answers.without_answer_tail(text)
    pieces = F.filter(F.transform(X.split_at(body, r"(?U)(?<=[.!?。])\s+|\n+"), X.strip), lambda s: s.rlike(_NUMERIC))
    some = X.let(F.struct(pieces.alias("p"), body.alias("b")), lambda s: F.when(F.size(s["p"]) > 0, s["p"]).otherwise(F.slice(X.split_sentences(X.normalize_space(s["b"])), 1, 3)))
    head = parts // 2
    kept = X.let(some, lambda p: F.when(F.size(p) > parts, F.concat(F.slice(p, 1, head), F.slice(p, -(parts - head), parts - head))).otherwise(p))
    return X.let(X.strip(F.array_join(kept, " ")), lambda t: _cut(t, longest))


def _cut(text: Column, longest: int) -> Column:
    head = F.substring(text, 1, longest)
    return F.when(F.length(text) <= longest, text).otherwise(X.strip(F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, r"(?s)\A(.*) ", 1)).otherwise(head)))


def minimal_reasoning(text: Column, longest: int = 300, parts: int = 3) -> Column:
    """TGT4: of the pieces that compute, the last ones, each cut to its shortest computing clause."""
    longest, parts = min(max(80, longest), 300), min(max(1, parts), 3)
    source = focused_reasoning(text, max(700, 3 * longest), max(8, 4 * parts))
    tidy = lambda s: _trim(X.normalize_space(s), _EDGE)
    computes = lambda s: s.rlike("[0-9]") & s.rlike(_OPERATOR)
    shortest = lambda cs: F.aggregate(cs, F.lit(None).cast("string"), lambda best, c: F.when(best.isNull() | (F.length(c) < F.length(best)), c).otherwise(best))
    clause = lambda s: F.coalesce(shortest(F.filter(F.transform(X.split_at(s, _MINIMAL_CLAUSES), tidy), computes)), s)
    pieces = F.filter(F.transform(X.split_at(source, _MINIMAL_PIECES), tidy), computes)
    last = X.let(F.transform(pieces, lambda s: _around(clause(s), _OPERATOR, 140, 55, 85, _EDGE)), lambda p: F.slice(p, F.greatest(F.size(p) - parts + 1, F.lit(1)), parts))
    joined = X.let(_distinct(last), lambda p: F.when(F.length(F.array_join(p, "\n")) > longest, F.array_join(_within(p, longest), "\n")).otherwise(F.array_join(p, "\n")))
    return X.strip(joined)


def answer_line(gold: Column) -> Column:
    return X.normalize_space(F.concat(F.lit(ANCHOR + " "), X.cleanup_answer(gold)))


# Builders over a record r: text, gold, number, final (the answer line), steps, lines (3), variable (lines with x), assigned


def _joined(*parts: Column) -> Column:
    """Non-empty parts as lines, white space made regular."""
    return X.normalize_space(F.concat_ws("\n", *[F.nullif(p, F.lit("")) for p in parts]))


def _one_anchor(target: Column) -> Column:
    return X.let(target, lambda t: F.when(answers.count_anchors(t) == 1, t))


def _equation_short(r: Column) -> Column:
    made = lambda n: _joined(F.lit(SHORT_SOLUTION), F.array_join(F.slice(r["lines"], 1, n), "\n"), r["final"])
    return F.when(F.size(r["lines"]) > 0, X.let(made(3), lambda t: F.when(F.length(t) > 380, made(2)).otherwise(t)))


def _symbolic(r: Column) -> Column:
    lines = _within(F.slice(r["lines"], 1, 2), 260)
    return X.let(lines, lambda ls: F.when(F.size(ls) > 0, X.let(_joined(F.lit(SHORT_SOLUTION), F.array_join(ls, "\n"), r["final"]), lambda t: F.when(F.length(t) <= 340, t))))


def _variable(r: Column) -> Column:
    made = lambda v: X.normalize_space(F.concat(F.lit(EQUATION), v["equation"], F.lit("\n" + SOLVED), v["solve"], F.lit("\nx = "), X.cleanup_answer(r["gold"]), F.lit("\n"), r["final"]))
    return X.let(variable_lines(r["variable"], r["assigned"]), lambda v: F.when(v.isNotNull(), X.let(made(v), lambda t: F.when(F.length(t) <= 420, t))))


def _program_lines(r: Column, name: str) -> Column:
    """Assignments of the checked steps and, if one holds the answer, which of them it is."""
    lines = F.transform(r["steps"], lambda s, i: F.concat(F.lit(name), (i + 1).cast("string"), F.lit(" = "), s["expr"]))
    last = F.array_max(F.filter(F.transform(r["steps"], lambda s, i: F.when(s["holds"], i + 1)), lambda i: i.isNotNull()))
    return F.struct(lines.alias("lines"), F.concat(F.lit("answer = " + name), last.cast("string")).alias("answer"))


def _pot(head: str, end: Callable[[Column], Column], longest: int | None = None) -> Callable[[Column], Column]:
    """A program whose last step holds the answer."""

    def build(r: Column) -> Column:
        made = lambda p: _one_anchor(_joined(F.lit(head), F.array_join(p["lines"], "\n"), p["answer"], end(r)))
        fits = lambda t: F.when(F.length(t) <= longest, t) if longest else t
        return X.let(_program_lines(r, "step_"), lambda p: F.when(r["number"].isNotNull() & p["answer"].isNotNull(), X.let(made(p), fits)))

    return build


def _fdd_lite(r: Column) -> Column:
    def made(p: Column) -> Column:
        whole = _joined(F.array_join(p["lines"], "\n"), p["answer"], r["final"])
        short = _joined(F.array_join(F.slice(p["lines"], 1, 2), "\n"), p["answer"], r["final"])
        return X.let(whole, lambda t: F.when(F.length(t) > 380, short).otherwise(t))

    return F.when(r["number"].isNotNull(), F.when(F.size(r["steps"]) > 0, X.let(_program_lines(r, "s"), made)).otherwise(r["final"]))


def _with_body(body: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: X.let(body(r["text"]), lambda b: _joined(b, r["final"]))


def _tagged(body: Callable[[Column], Column] | None) -> Callable[[Column], Column]:
    def build(r: Column) -> Column:
        said = F.lit(NO_REASONING) if body is None else F.coalesce(F.nullif(body(r["text"]), F.lit("")), F.lit(NO_REASONING))
        return X.normalize_space(F.concat(F.lit("<think>\n"), said, F.lit("\n</think>\n<answer>\n"), r["gold"], F.lit("\n</answer>")))

    return build


def _or_short(body: Callable[[Column], Column], longest: int = 450) -> Callable[[Column], Column]:
    return lambda t: F.coalesce(F.nullif(body(t), F.lit("")), shorten_reasoning(t, longest=longest))


def _numeric(build: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda r: F.when(r["number"].isNotNull(), build(r))


_answer = lambda r: r["final"]
_short = ("equation_short", _equation_short)
_stub = ("answer_only", _answer)
_restored_body = _or_short(lambda t: focused_reasoning(t, 700, 6))

#: Rules of each style in order: what the target is called, and its builder.
RULES: dict[str, list[tuple[str, Callable[[Column], Column]]]] = {
    "original": [("original", lambda r: r["text"])],
    "standardized": [("standardized", _with_body(answers.without_answer_tail))],
    "short_solution": [("short_solution", _with_body(shorten_reasoning))],
    "answer_stub": [_stub],
    "answer_only": [_stub],
    "answer_focused": [_stub],
    "equation_focused": [("equation_focused", _with_body(focused_reasoning))],
    "fdd_pot": [("program", _pot(PROGRAM_HEAD, lambda r: F.concat(F.lit(ANCHOR + " "), r["gold"]))), (_short[0], _numeric(_equation_short)), (_stub[0], _numeric(_answer))],
    "fdd_pot_compact": [("program", _pot("", _answer, 520)), (_short[0], _numeric(_equation_short)), (_stub[0], _numeric(_answer))],
    "original_fdd_pot_restored": [("program", _pot(RESTORED_HEAD, _answer)), ("reasoning", lambda r: X.let(_restored_body(r["text"]), lambda b: F.when(b != "", _one_anchor(_joined(b, r["final"]))))), _stub],
    "fdd_lite_type_routing": [_short, _stub],
    "tagged_short_solution": [("tagged", _tagged(_or_short(lambda t: focused_reasoning(t, 450, 4))))],
    "tagged_equation_focused": [("tagged", _tagged(_or_short(focused_reasoning, 700)))],
    "tagged_equation_minimal": [("tagged", _tagged(minimal_reasoning))],
    "tagged_answer_only": [("tagged", _tagged(None))],
}
#: Styles whose rules depend on the type; see _by_type.
TYPED = ("type_specific_equation_targets",)
#: Styles that take a target which the record brings along, if it has one.
GIVEN = ("fdd_lite_type_routing", "fdd_pot_compact", "type_specific_equation_targets", "original_fdd_pot_restored")
STYLES = (*RULES, *TYPED, "preprocessed_target")


def _by_type(r: Column, type_: Column) -> list[tuple[Column, str, Column]]:
    """(applies, name, target) of the type-specific style, in order."""
    kind = F.upper(F.coalesce(type_, F.lit("")))
    variable = kind.isin(*VARIABLE_TYPES)
    gsm, math = ~variable & kind.startswith("GSM_"), ~variable & kind.startswith("MATH_")
    other = ~variable & ~gsm & ~math
    return [
        (variable, "sv_fobar_variable_equation", _variable(r)),
        (variable, "sv_fobar_equation_short_fallback", _equation_short(r)),
        (gsm, "gsm_equation_short", _equation_short(r)),
        (math, "math_symbolic_equation_short", _symbolic(r)),
        (math, "math_answer_only", _answer(r)),
        (other, "other_equation_short", _equation_short(r)),
        (F.lit(True), "fallback_answer_only", _answer(r)),
    ]


def build(records: DataFrame, style: str, response: str = "response_vi", type_: str = "type", given: str | None = None, route: bool = False, keep_unanswered: bool = False, numeric_only: bool = False) -> DataFrame:
    """TGT7: records with target, target_kind (the rule that gave it) and reject (why there is none).

    given: a column with ready targets, taken by the styles in GIVEN if it says something, and by preprocessed_target always. route: types with an unknown get
    short programs in fdd_lite_type_routing. keep_unanswered: a text without an answer is its own target.
    reject: missing_response, no_answer, non_numeric_gold or no_target.
    """
    if style not in STYLES:
        raise ValueError(f"unknown target style {style}")
    ready = X.normalize_space(F.coalesce(F.col(given), F.lit(""))) if given else F.lit("")
    if style == "preprocessed_target":
        out = records.withColumn("target", F.nullif(ready, F.lit("")))
        return out.withColumn("target_kind", F.when(F.col("target").isNotNull(), "given")).withColumn("reject", F.when(F.col("target").isNull(), "no_target"))
    text = X.normalize_space(F.col(response))
    programs, typed = style in ("fdd_pot", "fdd_pot_compact", "original_fdd_pot_restored") or route, style in TYPED
    r = records.withColumn("_text", text).withColumn("_ready", ready if style in GIVEN else F.lit(""))
    r = r.withColumn("_gold", answers.extract_answer(F.col("_text")))
    r = r.withColumn("_number", numeric.parse_number(F.col("_gold")))
    lacks = F.when(F.col("_text") == "", "missing_response").when(F.col("_gold").isNull() & F.lit(not keep_unanswered), "no_answer").when(F.col("_number").isNull() & F.col("_gold").isNotNull() & F.lit(numeric_only), "non_numeric_gold")
    r = r.withColumn("reject", F.when(F.col("_ready") == "", lacks))
    open_ = F.col("reject").isNull() & F.col("_gold").isNotNull() & (F.col("_ready") == "")
    unknown = F.upper(F.coalesce(F.col(type_), F.lit(""))).isin(*VARIABLE_TYPES) & open_ if typed else F.lit(False)
    # Python looks at texts only where a rule of the style reads what it finds.
    r = r.withColumn("_steps", steps.checked_program(F.when(open_, F.col("_text")), F.col("_gold")) if programs else F.array().cast("array<struct<expr: string, holds: boolean>>"))
    lines = F.when(unknown, equation_lines(F.col("_text"), 8, True, 700)) if typed else F.array().cast("array<string>")
    # A generator of one row: the optimizer would otherwise copy the lines' definition, with its lambdas, into the call that reads them.
    r = r.select("*", F.inline(F.array(F.struct(lines.alias("_variable")))))
    r = r.withColumn("_assigned", steps.answer_assignments(F.col("_variable"), F.col("_gold")) if typed else F.array().cast("array<boolean>"))
    part = F.struct(F.col("_text").alias("text"), F.col("_gold").alias("gold"), F.col("_number").alias("number"), answer_line(F.col("_gold")).alias("final"), F.col("_steps").alias("steps"), equation_lines(F.col("_text")).alias("lines"), F.col("_variable").alias("variable"), F.col("_assigned").alias("assigned"))

    def choose(p: Column) -> Column:
        if typed:
            rules = _by_type(p, F.col(type_))
        else:
            rules = [(F.lit(True), name, make(p)) for name, make in RULES[style]]
            if route and style == "fdd_lite_type_routing":
                rules.insert(0, (F.coalesce(F.col(type_).rlike("SV|FOBAR"), F.lit(False)), "fdd_lite", _fdd_lite(p)))
        said = [F.when(applies, F.struct(F.nullif(target, F.lit("")).alias("target"), F.lit(name).alias("kind"))) for applies, name, target in rules]
        return F.coalesce(*[X.let(s, lambda c: F.when(c["target"].isNotNull(), c)) for s in said])

    given_ = F.struct(F.col("_ready").alias("target"), F.lit("given").alias("kind"))
    as_is = F.struct(F.col("_text").alias("target"), F.lit("unanswered").alias("kind"))
    r = r.withColumn("_made", F.when(F.col("_ready") != "", given_).when(open_, X.let(part, choose)).when(F.col("reject").isNull(), as_is))
    out = r.withColumn("target", F.col("_made.target")).withColumn("target_kind", F.col("_made.kind")).withColumn("reject", F.coalesce("reject", F.when(F.col("target").isNull(), "no_target")))
    return out.drop("_text", "_ready", "_gold", "_number", "_steps", "_variable", "_assigned", "_made")
