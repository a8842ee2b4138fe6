"""SimHash, sequence ratio and repetition."""

from __future__ import annotations

import hashlib
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import patterns as P
from .text import let, strip

#: Where lines end: all that Python's splitlines knows.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: So many digests of features are kept at once.
_KNOWN_MOST = 1 << 18


def _signature(features: set[str], known: dict[str, bytes]) -> int:
    """XF15: a bit is set when at least half of the features' BLAKE2b-64 digests have it; 0 without features. known holds digests met before."""
    if not features:
        return 0
    raw = []
    for f in features:
        digest = known.get(f)
        if digest is None:
            if len(known) >= _KNOWN_MOST:
                known.clear()
            digest = known[f] = hashlib.blake2b(f.encode(), digest_size=8).digest()
        raw.append(digest)
    votes = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64) * 2 >= len(raw)
    return int.from_bytes(np.packbits(votes).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def simhash64(features: pd.Series) -> pd.Series:
    """XF15 of arrays of features."""
    known: dict[str, bytes] = {}
    return features.map(lambda f: _signature(set() if f is None else set(f), known)).astype("int64")


@F.pandas_udf(T.LongType())
def query_simhash64(canonical: pd.Series) -> pd.Series:
    """XF15 of canonical queries: the features of text.feature_set are made here, so that texts reach Python and not their arrays."""
    find, known = re.compile(P.QUERY_TOKEN).findall, {}

    def one(text) -> int:
        tokens = find(text or "")
        features = {"u:" + t for t in tokens}
        features.update(f"b:{a}_{b}" for a, b in zip(tokens, tokens[1:]))
        return _signature(features, known)

    return canonical.map(one).astype("int64")


def bands(signature: Column) -> Column:
    """The four 16-bit bands of a signature with their numbers."""
    return F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(signature, 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(4)])


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def ratio_at_least(threshold: float):
    """DED2: whether SequenceMatcher(new, kept).ratio() reaches threshold; its upper bounds are tried first."""

    @F.pandas_udf(T.BooleanType())
    def run(new: pd.Series, kept: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(new, kept):
            if a is None or b is None:
                out.append(False)
                continue
            m = SequenceMatcher(None, a, b)
            out.append(m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and m.ratio() >= threshold)
        return pd.Series(out, dtype=bool)

    return run


def _longest_run(items: Column) -> Column:
    """How often the commonest of an array's strings stands in it: equal ones are neighbours once sorted (sort_array has no comparator to interpret)."""
    zero = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.sort_array(items), zero, step, lambda s: s["most"])


def max_trigram_count(text: Column) -> Column:
    """WIN8: how often the commonest three neighbouring lower-cased words stand in a text."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{P.SPACE}]+"), lambda w: w != "")
    places = lambda w: F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    grams = let(words, lambda w: F.transform(places(w), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    return _longest_run(grams)


def max_line_count(text: Column) -> Column:
    """How often the commonest non-empty line stands in a text."""
    lines = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), LINE_ENDS), strip)
    return _longest_run(F.filter(lines, lambda x: x != ""))
