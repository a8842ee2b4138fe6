"""Text and LaTeX clean-up as column expressions; Arrow functions only for Unicode normal forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _beyond_ascii(text: Column, normal) -> Column:
    """Only texts with other than ASCII letters go to Python."""
    ascii_ = F.octet_length(text) == F.length(text)
    return F.when(ascii_, text).otherwise(normal(F.when(~ascii_, text)))


def nfc(text: Column) -> Column:
    return _beyond_ascii(text, _nfc)


def nfkc(text: Column) -> Column:
    return _beyond_ascii(text, _nfkc)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: long chains would otherwise copy it into every branch."""
    return F.transform(F.array(value), body)[0]


_CUT = "\uffff"


def split_at(text: Column, pattern: str) -> Column:
    """F.split() by a pattern that matches no empty text. Spark compiles the pattern of split anew for every row, that of a replacement once."""
    fast = lambda t: F.split(F.regexp_replace(t, pattern, _CUT), _CUT)
    return let(text, lambda t: F.when(F.contains(t, F.lit(_CUT)), F.split(t, pattern)).otherwise(fast(t)))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{P.SPACE}]+|[{P.SPACE}]+\z", "")


def clean_model_output(text: Column) -> Column:
    """XF1: what follows the answer anchor cut down to the answer; texts without anchor as they are."""
    head = F.regexp_extract(text, f"(?s){P.UNI}^(.*?{P.ANSWER_ANCHOR})", 1)
    tail = F.substring(text, F.length(head) + 1, F.length(text))
    found = lambda p: F.nullif(F.regexp_extract(tail, p, 1), F.lit(""))
    kept = F.coalesce(found(f"^({P.LATEX_ANSWER})"), found(f"^({P.NUMBER})"), found(rf"^[{P.SPACE}]*({P.WORD})"), F.lit(""))
    return F.when(text.isNull() | (head == ""), text).otherwise(F.concat(head, kept))


def strip_asy_blocks(text: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lit("[asy]")), F.regexp_replace(text, P.ASY_BLOCK, " ")).otherwise(text)


def normalize_latex(text: Column, legacy_prefix_bug: bool = False) -> Column:
    r"""XF3. Without legacy_prefix_bug a literal such as \le is not replaced inside a longer command (\left)."""
    # Most texts have no command at all and skip the chain.
    return let(strip_asy_blocks(text), lambda t: F.when(F.contains(t, F.lit("\\")), _latex(t, legacy_prefix_bug)).otherwise(t))


def _latex(text: Column, legacy_prefix_bug: bool) -> Column:
    out = F.replace(F.replace(text, F.lit("\\$"), F.lit("")), F.lit("\\%"), F.lit("%"))
    for pattern, new in ((r"\\angle\s*([A-Z]{1,4})", "góc $1"), (r"\\triangle\s*([A-Z]{1,4})", "tam giác $1"), (P.FRACTION, "(($1)/($2))"), (r"\\sqrt\s*\{([^{}]+)\}", "sqrt($1)"), (r"\\sqrt\s*([0-9]+(?:[.,][0-9]+)?)", "sqrt($1)")):
        out = F.regexp_replace(out, pattern, new)
    for old, new in P.LATEX_LITERALS:
        out = F.replace(out, F.lit(old), F.lit(new)) if legacy_prefix_bug else F.regexp_replace(out, "\\" + old + "(?![A-Za-z])", new)
    out = F.regexp_replace(out, rf"\\({'|'.join(P.LATEX_FUNCTIONS + P.GREEK)})\b", "$1")
    out = F.regexp_replace(out, r"\\(?:left|right)\b", "")
    return F.regexp_replace(out, r"\\(?:begin|end)\{[^{}]+\}", " ")


def join_numbers(text: Column) -> Column:
    """Thousands marks dropped, decimal commas made points."""
    return let(text, lambda t: F.when(t.rlike("[0-9][.,][0-9]"), _joined(t)).otherwise(t))


def _joined(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3}\b)", "")
    out = F.regexp_replace(out, r"(?<=[0-9])\.(?=[0-9]{3}\b)", "")
    return F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", ".")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, P.SPACES, " " * len(P.SPACES)), " {2,}", " "))


def clean_math_text(text: Column, legacy_prefix_bug: bool = False) -> Column:
    """XF4."""
    return clean_composed(nfc(text), legacy_prefix_bug)


def clean_composed(text: Column, legacy_prefix_bug: bool = False) -> Column:
    """XF4 for texts in a composed normal form."""
    out = normalize_latex(text, legacy_prefix_bug)
    dollars = lambda t: F.regexp_replace(F.regexp_replace(t, r"\$\$([^$]+)\$\$", "$1"), r"\$([^$]{1,100})\$", "$1")
    out = let(out, lambda t: F.when(F.contains(t, F.lit("$")), dollars(t)).otherwise(t))
    return collapse(join_numbers(out))


def legacy_latex_cleanup(text: Column) -> Column:
    """XF6: the older clean-up, for before-and-after excerpts."""
    out = text
    for pattern, new in ((r"\\frac\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "($1/$2)"), (r"\\sqrt\s*\{([^{}]+)\}", "sqrt($1)"), (r"\\times|\\cdot", " * "), (r"\\angle\s*([A-Z]{2,3})", "góc $1"), (r"\\triangle\s*([A-Z]{2,3})", "tam giác $1"), (r"\\[a-zA-Z]+\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z]+\s", " ")):
        out = F.regexp_replace(out, pattern, new)
    return collapse(out)


def normalize_space(text: Column) -> Column:
    """XF7: line ends as \\n, blanks single, at most one empty line; null is empty."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|\r", "\n")
    return strip(F.regexp_replace(F.regexp_replace(out, " *\t[ \t]*| {2,}", " "), "\n{3,}", "\n\n"))


def strip_trailing_artifacts(text: Column, artifacts: list[str]) -> Column:
    """XF8: listed strings and white space taken off the end as often as they stand there."""
    quoted = "|".join(F_quote(a) for a in artifacts)
    return F.regexp_replace(text, rf"(?:{quoted}|[{P.SPACE}])+\z", "")


def F_quote(literal: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in literal)


def cleanup_answer(text: Column) -> Column:
    """XF9: the first line before any further marker, without quotes and signs around it."""
    out = F.regexp_replace(normalize_space(text), rf"(?s){P.UNI}(?<=.)(?:{'|'.join(P.MARKERS)}).*", "")
    out = F.regexp_replace(F.split(strip(out), "\n")[0], r"^[ \t:：]+|[ \t:：]+$", "")
    quotes = "[\"'“”‘’`]+"
    out = F.regexp_replace(out, f"^{quotes}|{quotes}$", "")
    return F.regexp_replace(F.regexp_replace(out, "[ .。;；,，]+$", ""), f"^{quotes}|{quotes}$", "")


def _plain_letters() -> tuple[str, str]:
    """Precomposed Latin letters and what is left of them without marks."""
    old, new = [], []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(point):
            old.append(chr(point))
            new.append(base)
    return "".join(old) + "đĐ", "".join(new) + "dD"


_MARKED, _PLAIN = _plain_letters()


def strip_diacritics(text: Column) -> Column:
    """XF10 for texts in a composed normal form; single combining marks go too."""
    return F.regexp_replace(F.translate(text, _MARKED, _PLAIN), r"\p{Mn}+", "")


def canonicalize_query(text: Column) -> Column:
    """XF11: the key under which questions count as equal."""
    out = let(nfkc(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(_ANY_DIGIT_WORD), _digit_words(t)).otherwise(t))
    out = F.lower(strip_diacritics(clean_composed(out)))
    out = F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", ".")
    return F.trim(F.regexp_replace(F.regexp_replace(out, _NOT_CANONICAL, " "), " {2,}", " "))


#: All but 0-9 a-z + - * / = < > . % and blank, said as ranges: Java is slow on negated classes.
_NOT_CANONICAL = "[\\x00-\\x1f!-$&-),:;?-`{-\U0010ffff]+"
#: A look for any digit word, whole as the replacements take them, before these; the first letter is tried alone as it refuses most places.
_ANY_DIGIT_WORD = rf"(?=[{''.join(sorted({c for w in P.DIGIT_WORDS for c in (w[0], w[0].upper())}))}])(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(P.DIGIT_WORDS)})(?![\p{{L}}\p{{N}}_])"


def _digit_words(text: Column) -> Column:
    for word, n in P.DIGIT_WORDS.items():
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){word}(?![\p{{L}}\p{{N}}_])", str(n))
    return text


def query_tokens(canonical: Column) -> Column:
    return F.regexp_extract_all(canonical, F.lit(P.QUERY_TOKEN), F.lit(0))


def number_signature(canonical: Column) -> Column:
    return F.regexp_extract_all(canonical, F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def feature_set(tokens: Column) -> Column:
    """XF14: single tokens and neighbouring pairs."""
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(F.lit("b:"), a, F.lit("_"), b))
    return F.array_distinct(F.concat(F.transform(tokens, lambda t: F.concat(F.lit("u:"), t)), pairs))


def build_prompt(query: Column, style: str = "plain", type_: Column | None = None) -> Column:
    """XF20 and XF21."""
    head, tail = P.PROMPT.split("{q}")
    q = strip(query)
    if style == "plain":
        return F.concat(F.lit(head), q, F.lit(tail))
    if style == "instruction":
        return F.concat(F.lit("Hãy giải bài toán sau và ghi đáp án cuối cùng.\n"), F.lit(head), q, F.lit(tail))
    if style == "typed_instruction" and type_ is not None:
        return F.concat(F.lit("["), F.coalesce(type_, F.lit("UNKNOWN")), F.lit("] "), F.lit(head), q, F.lit(tail))
    if style == "answer_marker":
        return F.concat(F.lit(head), q, F.lit("\nĐáp án là: "))
    if style == "typed_answer_marker" and type_ is not None:
        return F.concat(F.lit("["), F.coalesce(type_, F.lit("UNKNOWN")), F.lit("] "), F.lit(head), q, F.lit("\nĐáp án là: "))
    raise ValueError(f"unknown prompt style {style}")


def first_text(*columns: Column) -> Column:
    """XF22: the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def split_sentences(text: Column) -> Column:
    return F.filter(split_at(strip(text), f"(?<=[.!?。])[{P.SPACE}]+"), lambda s: s != "")


def dedup_key(text: Column) -> Column:
    """XF24: lower case, white space single."""
    return collapse(F.lower(F.coalesce(text, F.lit(""))))


def strip_math_delimiters(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\boxed\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\$|\\left|\\right", "")
    return F.regexp_replace(out, r"\\cdot|\\times", "×")


def tagged_to_vietnamese(text: Column) -> Column:
    """XF28: <think>, <answer> as solution and answer lines; without both tags as it is."""
    think, answer = (strip(F.regexp_extract(text, rf"(?s)<{t}>(.*?)</{t}>", 1)) for t in ("think", "answer"))
    return F.when(text.rlike(r"(?s)<think>.*?</think>") & text.rlike(r"(?s)<answer>.*?</answer>"), F.concat(F.lit("Lời giải: "), think, F.lit("\nĐáp án là: "), answer)).otherwise(text)
