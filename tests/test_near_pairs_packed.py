"""Packed sets, their sketches, and how many pairs bring whole sets together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacora.operators import dedup


@pytest.mark.parametrize("rare,ranks", [([], [0]), ([-5, 7], []), ([-(1 << 63), (1 << 63) - 1], [0, 3, 260, 249_999]), ([1], list(range(5000)))])
def test_sets_are_packed_without_loss(rare, ranks):
    packed = dedup._pack(np.array(rare, np.int64), np.array(ranks, np.int64))
    got = dedup._unpack(packed)
    assert got[0].tolist() == rare and got[1].tolist() == ranks
    assert len(packed) <= 40 + 8 * len(rare) + 4 * len(ranks)


def _near(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return {(r["a"], r["b"], round(r["jaccard"], 9)) for r in dedup.near_pairs(df, "id", F.split("text", " ")).collect()}


def _plain(texts):
    sets = [set(t.split()) for t in texts]
    pairs = [(i, j, len(sets[i] & sets[j]), len(sets[i] | sets[j])) for j in range(len(sets)) for i in range(j)]
    return {(i, j, round(common / n, 9)) for i, j, common, n in pairs if 10 * common >= 9 * n}


@pytest.mark.parametrize("most", [0, 40, 250_000])
def test_any_share_of_ranked_tokens_gives_the_pairs_of_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(dedup, "COMMON_MOST", most)
    rng, texts = random.Random(most), []
    for _ in range(15):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([1, 9, 60, 300]))]
        texts += [" ".join(w if rng.random() > rng.choice([0, 0.04, 0.1]) else f"w{rng.randrange(900)}" for w in base) for _ in range(5)]
    assert _near(spark, texts) == _plain(texts)


def test_unlike_sets_that_share_tokens_are_not_brought_together(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(1500)]
    texts = [" ".join(rng.sample(words, 200)) for _ in range(120)]
    texts += [" ".join(t.split()[:-1]) for t in texts[:10]]
    met, links = [], dedup._links

    def counted(pairs, nodes):
        met.append(pairs.count())
        return links(pairs, nodes)

    monkeypatch.setattr(dedup, "_links", counted)
    assert _near(spark, texts) == _plain(texts) and len(_plain(texts)) == 10
    assert 10 <= met[0] <= 20  # over a thousand share a key


def test_tokens_are_worked_out_once_a_pass(spark, monkeypatch):
    plans, packed = [], dedup._packed
    monkeypatch.setattr(dedup, "_packed", lambda sets, ranked: plans.append(sets) or packed(sets, ranked))
    _near(spark, ["a b c", "a b c", "", "d"])
    stages = [plans[0], plans[0].select(F.explode_outer("t").alias("k")).groupBy("k").count()]
    assert [s._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") for s in stages] == [1, 1]
