"""Answer extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import clean_model_output, cleanup_answer, let, strip


def _rstrip(text: Column) -> Column:
    return F.regexp_replace(strip(text), "[.。、,]+$", "")


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def extract_answer(text: Column, anchors: tuple = P.VI_ANCHORS) -> Column:
    """ANS1: by the first anchor, in list order, that the text has; else the last boxed part; else null."""
    # Plain searches for what every match holds come before the patterns, which are slow on texts without any.
    low = lambda t: F.lower(t)
    given = lambda t: F.struct(t.alias("t"), F.contains(t, F.lit("####")).alias("hash"), (F.contains(low(t), F.lit("đáp")) | F.contains(low(t), F.lit("câu trả lời"))).alias("says"), F.contains(low(t), F.lit("answer is")).alias("en"), F.contains(low(t), F.lit("frac")).alias("frac"), F.contains(low(t), F.lit("qrt")).alias("root"))
    return let(text, lambda t: let(given(t), lambda g: _extract(g["t"], anchors, g)))


def _guard(pattern: str, g: Column) -> Column:
    said = g["en"] if "answer is" in pattern else g["hash"] if pattern.startswith("####") else g["says"]
    return said & g["frac"] if "frac" in pattern else said & g["root"] if "sqrt" in pattern else said


def _extract(text: Column, anchors: tuple, g: Column) -> Column:
    out = F.when(text.isNull() | (text == ""), None)
    for pattern, group, ignore in anchors:
        flags = "(?dU)" if not ignore else "(?diuU)"
        if group:
            got = _rstrip(F.regexp_extract(text, flags + pattern, 1))
        else:
            rest = strip(F.regexp_extract(text, f"(?s){flags}^.*?{pattern}(.*)\\z", 1))
            got = _rstrip(F.split(rest, "\n")[0])
        out = out.when(_guard(pattern, g) & text.rlike(flags + pattern), got)
    return out.otherwise(strip(_last(F.regexp_extract_all(text, F.lit(P.BOXED), F.lit(1)))))


def extract_gold(response: Column) -> Column:
    return extract_answer(response)


def extract_pred(output: Column) -> Column:
    """ANS3: the answer's LaTeX or first number; without any answer the last number of the text."""
    found = lambda a, p: F.nullif(F.regexp_extract(a, p, 1), F.lit(""))
    inside = lambda a: F.coalesce(found(a, f"^({P.LATEX_ANSWER})"), found(a, f"({P.NUMBER})"))
    answer = extract_answer(clean_model_output(output), P.VI_ANCHORS + P.EN_ANCHORS)
    return let(F.struct(answer.alias("a"), output.alias("o")), lambda s: F.when(s["a"].isNotNull(), inside(s["a"])).otherwise(last_number(s["o"])))


def last_number(text: Column) -> Column:
    return _last(F.regexp_extract_all(text, F.lit(f"({P.NUMBER})"), F.lit(1)))


def answer_for_voting(text: Column) -> Column:
    """ANS5: a decimal string or NONE."""
    marked = F.nullif(F.regexp_extract(text, P.UNI + P.VOTE_ANSWER, 1), F.lit(""))
    return F.coalesce(F.replace(F.coalesce(marked, last_number(text)), F.lit(","), F.lit(".")), F.lit("NONE"))


def count_anchors(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(P.UNI + r"####\s*đáp\s*án\s*là")), F.lit(0))


def last_marker_answer(text: Column) -> Column:
    """ANS7: what follows the marker that starts last; else the last boxed part; else null."""
    any_marker = P.ANY_MARKER
    tail = F.regexp_extract(text, f"(?s){P.UNI}^.*{any_marker}(.*)\\z", 1)
    boxed = _last(F.regexp_extract_all(text, F.lit(P.BOXED), F.lit(1)))
    return F.when(text.isNull() | (text == ""), None).when(text.rlike(P.UNI + any_marker), cleanup_answer(strip(tail))).when(boxed.isNotNull(), cleanup_answer(boxed))


def without_answer_tail(text: Column, near: int = 700) -> Column:
    """ANS8: cut at the first marker of the last `near` characters, else at the last marker."""
    any_marker = P.ANY_MARKER
    cut = F.greatest(F.length(text) - near, F.lit(0))
    head, tail = F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.length(text))
    in_tail = F.regexp_replace(tail, f"(?s){P.UNI}{any_marker}.*", "")
    before_last = F.regexp_extract(text, f"(?s){P.UNI}^(.*){any_marker}", 1)
    return strip(F.when(tail.rlike(P.UNI + any_marker), F.concat(head, in_tail)).when(text.rlike(P.UNI + any_marker), before_last).otherwise(text))


def strip_units(text: Column) -> Column:
    """ANS11: a leading scalar without the unit words after it."""
    got = F.regexp_extract(text, r"^\s*(-?(?:[0-9]+\s*/\s*[0-9]+|[0-9]+(?:[.,][0-9]+)?)(?:\s*%)?)\s+[\p{L}/%$].*$", 1)
    return F.when(got != "", got).otherwise(text)


def tagged_answer(text: Column) -> Column:
    """ANS13: the content of the only <answer> block, else null."""
    return F.when(F.regexp_count(text, F.lit("<answer>")) == 1, F.nullif(strip(F.regexp_extract(text, "(?s)<answer>(.*?)</answer>", 1)), F.lit("")))


def numeric_values(text: Column) -> Column:
    """ANS10: all number strings of a text, fractions as a/b."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?[0-9]+(?:[.,][0-9]+)?(?:\s*/\s*[0-9]+(?:[.,][0-9]+)?)?"), F.lit(0))


def final_answer_tail(text: Column) -> Column:
    """ANS9: the last marker and all that follows it; null if there is none."""
    any_marker = P.ANY_MARKER
    return F.nullif(strip(F.regexp_extract(text, f"(?s){P.UNI}^.*({any_marker}.*)\\z", 1)), F.lit(""))
