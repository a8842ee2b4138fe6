"""Clean-up of generated texts (XF26-27), last number candidates (ANS10) and checked equation steps (TGT5). Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P
from .numeric import parse_expression

ANCHOR = "####đáp án là:"
_MARKER = re.compile("|".join(f"(?:{m})" for m in P.MARKERS), re.I)
_QUOTES = "\"'“”‘’`"
_CANDIDATE = re.compile(r"(?<!\w)[-+]?\d+(?:[.,]\d+)?(?:\s*/\s*[-+]?\d+(?:[.,]\d+)?)?(?!\w)")
#: What an exact answer is written with, after a number or without one.
_LEAD = re.compile(r"[+-]?\d+(?:[.,]\d+)?")
_FRACTION, _ROOT, _BARE_ROOT = re.compile(r"\\[dt]?frac(?:\{[^{}]+\}){2}"), re.compile(r"\\sqrt\{[^{}]+\}"), re.compile(r"\\sqrt\s*\d+")
_SCALAR = re.compile(r"[+-]?\d+(?:[.,]\d+)?(?:\s*/\s*[+-]?\d+(?:[.,]\d+)?)?\b")
#: A stutter that generated answers end with.
_STUTTER = re.compile(r"(?<=\d)(?:hue)+$", re.I)
_TAG = re.compile(r"<answer>(.*?)</answer>", re.S)
_BOX = re.compile(P.BOXED)


def exact_start(answer: str) -> str | None:
    """A fraction or root that an answer begins with, and the number right before it: a whole one before a fraction, any before a root, some before a root without brackets."""
    m = _LEAD.match(answer)
    lead = m[0] if m else ""
    whole = not re.search("[.,]", lead)
    for form, fits in ((_FRACTION, whole), (_ROOT, True), (_BARE_ROOT, lead != "")):
        if fits and (found := form.match(answer, len(lead))):
            return lead + found[0]
    return None


def spaced(text: str | None) -> str:
    """Line ends as one sign, at most one blank and one empty line in a row."""
    lines = [re.sub(r"[ \t]+", " ", x) for x in re.split(r"\r\n?|\n", text or "")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def answer_line(text: str | None) -> str:
    """The first line before any further marker, without signs and quotes around it."""
    body = spaced(text)
    further = _MARKER.search(body, 1)
    line, _, _ = body[: further.start() if further else None].strip().partition("\n")
    return line.strip(" \t:：").strip(_QUOTES).rstrip(" .。;；,，").strip(_QUOTES)


def last_candidate(text: str | None) -> str | None:
    """The last number (or a/b) of a text that denotes one."""
    numbers = [m[0] for m in _CANDIDATE.finditer(text or "") if parse_expression(m[0]) is not None]
    return numbers[-1] if numbers else None


def answer_value(text: str | None) -> str:
    """XF27: an exact form or a number at the answer's start, else what denotes a number as a whole, else the last number, else the text."""
    answer = _STUTTER.sub("", answer_line(text)).strip()
    if (exact := exact_start(answer)) is not None:
        return exact
    if (scalar := _SCALAR.match(answer)) and parse_expression(scalar[0]) is not None:
        return scalar[0]
    return answer if parse_expression(answer) is not None else last_candidate(answer) or answer


def final_answer(text: str | None) -> str | None:
    """What follows the last marker, else the last boxed part."""
    ends = [m.end() for m in _MARKER.finditer(text or "")]
    parts = [text[ends[-1] :]] if ends else [m[1] for m in _BOX.finditer(text or "")]
    return answer_line(parts[-1]) if parts else None


def generated_answer(text: str | None) -> str:
    """XF27: the answer of a generated text as an anchored line: the final one, that of an only tag, else the last number."""
    tagged = [m[1].strip() for m in _TAG.finditer(text or "")]
    found = final_answer(text)
    if found is None:
        found = tagged[0] if len(tagged) == 1 else last_candidate(text)
    return f"{ANCHOR} {answer_value(found)}".strip()


def postprocess(text: str | None, prompt: str | None = None, append_number: bool = False) -> str:
    """XF26: without an echoed prompt, ended by the first marker's line as an answer line; optionally the last number as answer."""
    body = spaced(text)
    body = spaced(body.removeprefix(spaced(prompt))) if prompt else body
    mark = _MARKER.search(body)
    steps = [x.strip() for x in body[: mark.start() if mark else None].split("\n") if x.strip()]
    if mark:
        value = answer_value(body[mark.end() :].split("\n")[0]) if body[mark.end() : mark.end() + 1] != "\n" else ""
        steps.append(f"{ANCHOR} {value}".strip())
    elif append_number and final_answer(body) is None and (number := last_candidate(body)) is not None:
        steps.append(f"{ANCHOR} {answer_value(number)}")
    return "\n".join(steps) or ANCHOR


#: An equation: the longest run of arithmetic before an equals sign, and the number or a/b behind it.
_STEP = re.compile(r"(-?\d(?:[\d\s.,()+\-*/×%^{}]|\\[dt]?frac|\\sqrt|sqrt)*?)\s*=\s*(-?\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)?)")
_TAIL = re.compile(f"(?:{'|'.join(P.MARKERS)})", re.I)


def without_tail(text: str | None, near: int = 700) -> str:
    """ANS8 for one text: cut at the first marker of the last `near` characters, else at the last marker."""
    body = text or ""
    marks = [m.start() for m in _TAIL.finditer(body)]
    late = [at for at in marks if at >= len(body) - near]
    return body[: late[0] if late else marks[-1]].strip() if marks else body.strip()


def equation_steps(text: str | None, gold: float | None, most: int = 4) -> list[str]:
    """TGT5: of the equations of a solution that hold within 1e-6 the `most` nearest to the gold value, later ones first among equals, in order of the text and each once."""
    held = []
    for place, m in enumerate(_STEP.finditer(without_tail(text))):
        left = re.sub(r"\s+", "", m[1]).replace("×", "*")
        value, stated = parse_expression(left), parse_expression(m[2])
        if re.search(r"[+\-*/^]|frac|sqrt", left[1:]) and None not in (value, stated) and abs(value - stated) <= 1e-6 * max(1.0, abs(stated)):
            held.append((place, stated, f"{left} = {m[2].strip()}"))
    if gold is not None and gold == gold:
        held.sort(key=lambda e: (abs(e[1] - gold), -e[0]))
    return list(dict.fromkeys(step for _, _, step in sorted(held[:most])))


@F.pandas_udf(T.StringType())
def _generated(s: pd.Series) -> pd.Series:
    return s.map(generated_answer)


@F.pandas_udf(T.StringType())
def _post(s: pd.Series, prompt: pd.Series) -> pd.Series:
    return pd.Series([postprocess(t, p) for t, p in zip(s, prompt)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _steps(s: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([equation_steps(t, g) for t, g in zip(s, gold)], dtype=object)


def clean_generated(text: Column) -> Column:
    return _generated(text)


def postprocess_generation(text: Column, prompt: Column | None = None) -> Column:
    return _post(text, F.lit(None).cast("string") if prompt is None else prompt)


def checked_steps(text: Column, gold: Column) -> Column:
    return _steps(text, gold.cast("double"))
