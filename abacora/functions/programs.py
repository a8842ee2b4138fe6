"""Answers that are small programs (ANS15, ANS16): arithmetic as Python text, and programs run by a walk over their syntax tree.

Nothing is ever compiled or executed: the walk knows assignments to names, arithmetic, a few functions and
print. Everything else, numbers beyond MOST_BITS and arithmetic on strings give no answer.
"""

from __future__ import annotations

import ast
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import numeric
from .text import cleanup_answer, let

#: Limits and marks of programs in completions.
LONGEST, MOST_LINES, MOST_POWER = 2500, 24, 8
ANSWER_MARK, LEAD_INS = "Đáp án", ("Câu hỏi", "Bài giải", "Lời giải")
MOST_BITS = 4096

_FENCE = re.compile(r"```(?:python|py)?\s*(.*?)```", re.S | re.I)
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}
_CALLS = {"sqrt": math.sqrt, "abs": abs, "round": round, "min": min, "max": max}


class _Refused(Exception):
    pass


class _Program:
    def __init__(self):
        self.names: dict[str, object] = {"pi": math.pi}
        self.printed: list[object] = []

    def run(self, tree: ast.Module) -> None:
        for step in tree.body:
            match step:
                case ast.Assign(targets=targets, value=value):
                    if not all(isinstance(t, ast.Name) and not t.id.startswith("__") for t in targets):
                        raise _Refused
                    self.names |= dict.fromkeys([t.id for t in targets], self.value(value))
                case ast.Expr(value=value):
                    self.value(value)
                case _:
                    raise _Refused

    def value(self, node: ast.expr):
        match node:
            case ast.Constant(value=int() | float() | str() | None):
                return node.value
            case ast.Name(id=name):
                return self.names[name]
            case ast.UnaryOp(op=op, operand=x) if type(op) in _UNARY:
                return _UNARY[type(op)](self.number(x))
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                if isinstance(op, ast.Pow) and not (isinstance(b, ast.Constant) and isinstance(b.value, int | float) and abs(b.value) <= MOST_POWER):
                    raise _Refused
                return self.bounded(_BINARY[type(op)](self.number(a), self.number(b)))
            case ast.Call(func=ast.Name(id=name), args=args, keywords=[]):
                if name == "print":
                    self.printed += [self.value(x) for x in args][-1:]
                    return None
                if name in _CALLS:
                    return self.bounded(_CALLS[name](*[self.number(x) for x in args]))
        raise _Refused

    def number(self, node: ast.expr):
        x = self.value(node)
        if not isinstance(x, int | float):
            raise _Refused
        return x

    @staticmethod
    def bounded(x):
        if isinstance(x, complex) or (isinstance(x, int) and x.bit_length() > MOST_BITS):
            raise _Refused
        return x


def program_of(completion: str | None, most_lines: int = MOST_LINES) -> str:
    """The first fenced block, or else the completion, up to the answer mark: its first lines with content, lead-ins left out."""
    text = completion or ""
    fenced = _FENCE.search(text)
    body = (fenced[1] if fenced else text).partition(ANSWER_MARK)[0]
    lines = [x for x in map(str.strip, body.splitlines()) if x and not x.startswith(LEAD_INS)]
    return "\n".join(lines[:most_lines])


def result_of(completion: str | None, most_lines: int = MOST_LINES) -> str | None:
    """The last printed value that is a number, or else the variable `answer`; None for all that isn't such a program."""
    code = program_of(completion, most_lines)
    if not code or len(code) > LONGEST:
        return None
    program = _Program()
    try:
        program.run(ast.parse(code))
        said = [str(x) for x in [program.names.get("answer"), *program.printed]]
    except (_Refused, SyntaxError, ValueError, KeyError, TypeError, ArithmeticError, RecursionError, MemoryError):
        return None
    return next((x for x in reversed(said) if numeric.parse_expression(x) is not None), None)


class _Writer:
    """Tokens of an expression to Python text; a multiplication sign wherever two factors stand side by side."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    def braces(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][1] != "{":
            raise _Refused
        self.at += 1
        inside = self.until("}")
        if not inside:
            raise _Refused
        return inside

    def until(self, end: str) -> str:
        out, factor = [], ""
        while self.at < len(self.tokens):
            kind, said = self.tokens[self.at]
            self.at += 1
            if said == end:
                return "".join(out)
            match kind:
                case "number" if factor == "number":
                    out.append(said)
                    continue
                case "number" | "pi":
                    piece, starts = "pi" if kind == "pi" else said, True
                case "frac":
                    piece, starts = f"(({self.braces()})/({self.braces()}))", True
                case "boxed":
                    piece, starts = f"({self.braces()})", True
                case "sqrt":
                    after = self.tokens[self.at : self.at + 1]
                    if after and after[0][0] == "number":
                        self.at += 1
                        inner = after[0][1]
                    elif after and after[0][1] == "(":
                        self.at += 1
                        inner = self.until(")")
                    else:
                        inner = self.braces()
                    piece, starts = f"sqrt({inner})", True
                case "bracket" if said == "(":
                    piece, starts = f"({self.until(')')})", True
                case "times":
                    piece, starts = "*", False
                case "over" | "sign":
                    piece, starts = said, False
                case _:
                    raise _Refused
            if starts and factor:
                out.append("*")
            out.append(piece)
            factor = kind if starts else ""
        if end:
            raise _Refused
        return "".join(out)


def python_expression(text: str | None) -> str | None:
    """An arithmetic expression, plain or LaTeX, as Python text; None with powers or anything that isn't arithmetic.

    A comma in a lone number is the decimal mark; elsewhere commas may only group digits.
    """
    try:
        tokens = numeric._tokens((text or "").replace("%", "").replace("×", "*"), False)
        lone = [t for k, t in tokens if k != "sign"]
        decimal = len(lone) == 1 and re.fullmatch(r"\d+,\d+", lone[0]) is not None
        plain = lambda t: t.replace(",", ".") if decimal else re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", t)
        tokens = [(k, plain(t) if k == "number" else t) for k, t in tokens]
        if any("," in t for _, t in tokens):
            return None
        return _Writer(tokens).until("") or None
    except (_Refused, numeric._NoValue, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _expressions(s: pd.Series) -> pd.Series:
    return s.map(python_expression)


def expression_to_python(text: Column) -> Column:
    """ANS15."""
    return _expressions(text)


def numeric_literal(value: Column, original: Column) -> Column:
    """ANS15: the cleaned answer if it is whole as it stands, else the value without needless decimals."""
    kept = cleanup_answer(original)
    whole = F.abs(value - F.rint(value)) <= 1e-9
    return F.when(kept.rlike(r"^-?[0-9]+$"), kept).when(whole, F.rint(value).cast("decimal(38,0)").cast("string")).otherwise(value.cast("double").cast("string"))


def execute_program(completion: Column, most_lines: int = MOST_LINES) -> Column:
    """ANS16."""

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: result_of(x, most_lines))

    return let(run(completion), lambda x: F.when(x.isNotNull(), cleanup_answer(x)))
