"""Checked equations of a solution as program lines (TGT5), and lines that state the answer (FLT14): small parsers over Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .generated import without_tail
from .numeric import parse_expression
from .programs import python_expression

#: Fixed value: an arithmetic expression, "=", and the number or fraction that it is said to be.
STATED = re.compile(r"(-?\d[\d\s.,()+\-*/×%\\frac{}sqrt^]*?)\s*=\s*(-?\d+(?:[.,]\d+)?(?:\s*/\s*\d+(?:[.,]\d+)?)?)")
#: Fixed value: how far apart two values may be, as a share of the larger of 1 and the second.
EQUAL = 1e-6


def _near(a: float | None, b: float | None, share: float = EQUAL) -> bool:
    return a is not None and b is not None and abs(a - b) <= share * max(1.0, abs(b))


def program_steps(text: str | None, gold: float | None, most: int = 3) -> list[dict]:
    """expr and holds (the value is the gold one) of the `most` true equations nearest to the gold value, later ones first among equals, in the text's order, each expression once."""
    true = []
    for m in STATED.finditer(without_tail(text)):
        code, stated = python_expression(m[1].strip()), parse_expression(m[2].strip())
        if code and _near(parse_expression(m[1].strip()), stated):
            true.append((len(true), code, stated))
    if gold is not None and gold == gold:
        true.sort(key=lambda s: (abs(s[2] - gold), -s[0]))
    told: dict[str, bool] = {}
    for _, code, value in sorted(true[:most]):
        told.setdefault(code, _near(value, gold))
    return [{"expr": e, "holds": h} for e, h in told.items()]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("expr", T.StringType()), T.StructField("holds", T.BooleanType())])))
def _program(s: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else program_steps(t, _number(g)) for t, g in zip(s, gold)], dtype=object)


def _number(answer: str | None) -> float | None:
    return None if answer is None else parse_expression(answer.strip())


def checked_program(text: Column, gold: Column) -> Column:
    """program_steps by row, with the answer as a text; null for null texts, which are not looked at."""
    return _program(text, gold)


_ASSIGNED = re.compile(r"\s*[xX]\s*=\s*(.+)", re.DOTALL)


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _assigned(lines: pd.Series, gold: pd.Series) -> pd.Series:
    def one(ls, answer):
        if ls is None:
            return None
        g = _number(answer)
        told = [_ASSIGNED.fullmatch(x) for x in ls]
        return [bool(m) and _near(_number(m[1]), g, 0.01) for m in told]

    return pd.Series([one(ls, g) for ls, g in zip(lines, gold)], dtype=object)


def answer_assignments(lines: Column, gold: Column) -> Column:
    """By line whether it is `x = v` with v within 1 % of the value of the gold answer (a text)."""
    return _assigned(lines, gold)
