"""Vietnamese number and operator words (Arrow functions: they read left to right with state)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P

_TENS = ("mươi", "mười")
#: Multipliers after a digit word, with whether a smaller number may follow.
_SCALES = {word: (value, value < 1_000_000_000) for word, value in P.MAGNITUDES.items() if word not in _TENS}


def _unit(word: str) -> int | None:
    """Value of a word that can close a group of tens."""
    return P.DIGIT_WORDS.get(word) if word not in _TENS else None


def read_number(words: list[str], at: int = 0) -> tuple[int | None, int]:
    """Value of the longest number that begins at words[at], and how many words it takes."""
    word = lambda k: words[k] if k < len(words) else ""

    def with_rest(base: int, below: int, used: int) -> tuple[int, int]:
        rest, more = read_number(words, at + used)
        return (base + rest, used + more) if rest is not None and rest < below else (base, used)

    head, then = word(at), word(at + 1)
    if head not in P.DIGIT_WORDS:
        return with_rest(P.MAGNITUDES[head], P.MAGNITUDES[head], 1) if head in P.MAGNITUDES else (None, 0)
    lead = P.DIGIT_WORDS[head]
    if then in _SCALES:
        scale, open_ = _SCALES[then]
        return with_rest(lead * scale, scale, 2) if open_ else (lead * scale, 2)
    if then in _TENS and lead >= 2 or then == "mười" and lead == 1:
        unit = _unit(word(at + 2))
        return (lead * 10 + unit, 3) if unit is not None else (lead * 10, 2)
    if head == "mười" and _unit(then) is not None:
        return 10 + P.DIGIT_WORDS[then], 2
    return lead, 1


def _bare(word: str) -> str:
    return word.lower().strip(".,;:!?()")


def _is_number_word(word: str) -> bool:
    return word in P.DIGIT_WORDS or word in P.MAGNITUDES


def _spell_out(low: list[str], at: int, so_far: list[str], words: list[str]) -> tuple[list[str], int]:
    """What stands for the words from `at` on, and how many of them it takes."""
    word, before, after = low[at], so_far[-1] if so_far else "", words[at + 1] if at + 1 < len(words) else ""
    match word:
        case _ if word in P.ORDINAL_WORDS:  # a digit word behind it is a name, not a number
            return words[at : at + 2] if after.lower() in P.DIGIT_WORDS else [words[at]], 1 + (after.lower() in P.DIGIT_WORDS)
        case "nửa" if re.search(r"\d", before) or re.search(r"[\d+\-*/]", after):
            return ["0.5"], 1
        case _ if not _is_number_word(word):
            return [words[at]], 1
        case _ if word in P.TIME_UNITS and before[-1:].isdigit():
            return [words[at]], 1
        case _ if word in P.PROTECTED_PAIRS.get(before.lower().strip(".,;:!?"), ()):
            return [words[at]], 1
    value, used = read_number(low, at)
    return [str(value)], used


def number_words_to_digits(text: str) -> str:
    """XF17: number words to digits, except after ordinal words, for time units and in protected pairs."""
    words = text.split()
    low, out, at = [w.lower() for w in words], [], 0
    while at < len(words):
        made, used = _spell_out(low, at, out, words)
        out += made
        at += used
    return " ".join(out)


_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
#: Verbs of calculation: sign, the word that may follow, and words after which the verb is no operator.
_VERBS = {
    "cộng": ("+", "với", ()),
    "trừ": ("-", "đi", ("phi", "khi")),
    "nhân": ("*", "với", P.NOT_MULTIPLIED),
    "chia": ("/", "cho", P.NOT_DIVIDED),
}


def _split(word: str) -> tuple[str, str, str]:
    """A word's signs before it, its core and its signs after it."""
    core = word.strip(".,;:!?()\"'")
    at = word.find(core) if core else 0
    return word[:at], core, word[at + len(core) :]


def _numeral(core: str) -> bool:
    return bool(_NUMBER.fullmatch(core)) or _is_number_word(core.lower())


class _Operators:
    """One pass from left to right over words; each step writes what it has read as signs."""

    def __init__(self, words: list[str], percent: bool, times: bool):
        self.words, self.percent, self.times = words, percent, times
        self.parts = [_split(w) for w in words]
        self.out: list[str] = []

    def core(self, at: int) -> str:
        return self.parts[at][1].lower() if 0 <= at < len(self.parts) else ""

    def joins(self, at: int) -> bool:
        """Whether nothing but blanks stands between this word and the next."""
        return at + 1 < len(self.words) and not self.parts[at][2] and not self.parts[at + 1][0]

    def run(self) -> str:
        at = 0
        while at < len(self.words):
            at += self.part(at) or self.times_over(at) or self.verb(at) or self.plain(at)
        return " ".join(self.out)

    def plain(self, at: int) -> int:
        self.out.append(self.words[at])
        return 1

    def part(self, at: int) -> int:
        """N phần trăm, N phần M (and on: N/M phần K), phần M."""
        if self.core(at) != "phần" or not self.joins(at):
            return 0
        after, last = self.parts[at + 1], self.out[-1] if self.out else ""
        left = re.search(r"[\w.,/%]+$", last)
        upper = left and (_NUMBER.search(left[0]) or left[0].lower() in P.DIGIT_WORDS)
        if upper and self.percent and after[1].lower() == "trăm":
            self.out[-1] = f"{last}%{after[2]}"
        elif upper and _numeral(after[1]):
            self.out[-1] = f"{last}/{after[1]}{after[2]}"
        elif re.fullmatch(r"\d+", after[1]):
            self.out.append(f"{self.parts[at][0]}1/{after[1]}{after[2]}")
        else:
            return 0
        return 2

    def times_over(self, at: int) -> int:
        """gấp N (lần)."""
        if not self.times or self.core(at) != "gấp" or not self.joins(at) or not _numeral(self.core(at + 1)):
            return 0
        folded = self.joins(at + 1) and self.core(at + 2) == "lần"
        end = self.parts[at + 2 if folded else at + 1][2]
        self.out.append(f"{self.parts[at][0]}* {number_words_to_digits(self.parts[at + 1][1])}{end}")
        return 3 if folded else 2

    def verb(self, at: int) -> int:
        """A verb with its particle after a digit, or alone with a number near it."""
        word = self.words[at].lower()
        if word not in _VERBS:
            return 0
        sign, particle, unless = _VERBS[word]
        after = self.words[at + 1].lower() if at + 1 < len(self.words) else ""
        if after == particle and at + 2 < len(self.words) and self.out and self.out[-1][-1:].isdigit():
            self.out.append(sign)
            return 2
        if _bare(after) in unless or not self.near(at):
            return 0
        self.out.append(sign)
        return 1

    def near(self, at: int, reach: int = 2) -> bool:
        others = self.out[-reach:] + self.words[at + 1 : at + 1 + reach]
        return any(re.search(r"\d", w) or _is_number_word(_bare(w)) for w in others)


def operator_words_to_signs(text: str, convert_percent: bool = True, convert_times: bool = True) -> str:
    """XF18."""
    return _Operators(number_words_to_digits(text).split(" "), convert_percent, convert_times).run()


def normalize_math_words(text: str) -> str:
    """XF19."""
    return operator_words_to_signs(number_words_to_digits(unicodedata.normalize("NFC", text)))


def _udf(f):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else f(t))

    return run


_digits, _signs, _both = _udf(number_words_to_digits), _udf(operator_words_to_signs), _udf(normalize_math_words)


def number_words(text: Column) -> Column:
    return _digits(text)


def operator_words(text: Column) -> Column:
    return _signs(text)


def vi_math_text(text: Column) -> Column:
    return _both(text)


_ANNOTATION = re.compile(r"<<[^>]+>>")
#: The notebook's clean-up, in this order.
_NOTEBOOK = tuple((re.compile(p), n) for p, n in (
    (r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", r"(\1/\2)"), (r"\\sqrt\s*\{([^{}]+)\}", r"sqrt(\1)"), (r"\\times|\\cdot", " * "),
    (r"\\angle\s*([A-Z]{2,3})", r"góc \1"), (r"\\triangle\s*([A-Z]{2,3})", r"tam giác \1"), (r"\\[a-zA-Z]+\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z]+\s", " "),
    (r"\$([^$]{1,100})\$", r"\1"), (r"\$\$([^$]+)\$\$", r"\1"), (r"(?<=\d)\s*_\s*(?=\d)", " * "), (r"([A-Za-z])_(\d+)", r"\1\2"), (r"\^\{(\d+)\}", r"^\1"),
    (r"(?<=\d),(?=\d{3}\b)", ""), (r"(?<=\d)\.(?=\d{3}\b)", ""), (r"(?<=\d),(?=\d)", "."),
))


def notebook_clean(text: str) -> str:
    """XF5: the clean-up that leaves <<expression=result>> notes untouched."""
    notes = _ANNOTATION.findall(text)
    # A sign that the text doesn't have holds a note's place.
    place = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text)
    parts = _ANNOTATION.sub(place, text)
    for pattern, new in _NOTEBOOK:
        parts = pattern.sub(new, parts)
    pieces = parts.split(place)
    return " ".join("".join(a + b for a, b in zip(pieces, [*notes, ""])).split())


_notebook = _udf(notebook_clean)


def notebook_clean_text(text: Column) -> Column:
    return _notebook(text)
