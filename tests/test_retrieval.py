"""Retrieval with bounds equals scoring every pair, and makes few pairs where queries have relatives."""

import math
import random

import pytest
from pyspark.sql import functions as F

from abacora.operators import select

TOKENS = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))


def plain(queries, records, k):
    out = set()
    sets = {i: set((t or "").split()) for i, t in records}
    for i, t in queries:
        own = set((t or "").split())
        scored = [(-sum(3 if any(c.isdigit() for c in w) else 1 for w in own & s) / math.sqrt(len(own) * len(s)), j) for j, s in sets.items() if own & s]
        out |= {(i, place + 1, j, round(-score, 9)) for place, (score, j) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 3), (3, 7)])
def test_equals_scoring_every_pair_with_ties_empty_texts_and_very_common_tokens(spark, seed, k):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["7", "12", "3a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    say = lambda n: " ".join(rng.choices(words, weights, k=n))
    records = [(i, say(rng.choice([1, 1, 2, 5, 20, 80]))) for i in range(150)] + [(500, None), (501, ""), (502, "waa waa"), (503, "waa")]
    queries = [(i, say(rng.choice([1, 3, 12, 40]))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "waa")]
    got = select.retrieve(spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(records, "record_id long, text string"), k, tokens=TOKENS).collect()
    assert {(r["query_id"], r["place"], r["record_id"], round(r["score"], 9)) for r in got} == plain(queries, records, k)


def test_bounds_leave_a_tenth_of_the_pairs_at_most(spark):
    rng = random.Random(6)
    words = [f"v{i}" for i in range(2000)]
    say = lambda n: " ".join(["the", "of", "and", *rng.choices(words, k=n)])
    records = [(i, say(60)) for i in range(600)]
    queries = [(i, " ".join(rng.sample(records[i * 7][1].split(), 30)) + " the of and") for i in range(40)]
    q, r = (spark.createDataFrame(rows, f"{c} long, text string").select(c, TOKENS(F.col("text")).alias("t")) for rows, c in ((queries, "query_id"), (records, "record_id")))
    met = 40 * 600  # every pair shares "the"
    made = select.retrieval_candidates(q, r, 1)
    assert made.count() <= met // 10
    assert {(x["query_id"], x["record_id"]) for x in made.collect()} >= {(i, i * 7) for i in range(40)}
