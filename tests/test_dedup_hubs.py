"""Near dedup by hubs equals the sequential walk and compares groups of copies with their hub only."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from abacora.operators import dedup


def nodes_of(spark, texts):
    """Nodes whose signatures share bands as the texts' first words say."""
    rows = [(i, t, [w for w in t.split() if w.isdigit()], t.split(), sum((hash_band(t.split()[b % len(t.split())], b) << 16 * b) for b in range(4))) for i, t in enumerate(texts)]
    rows = [(*r[:4], r[4] - (1 << 64) if r[4] >= 1 << 63 else r[4]) for r in rows]
    df = spark.createDataFrame(rows, "i long, canonical string, numbers array<string>, words array<string>, sig long")
    return df.select(F.struct(F.lit(0).alias("p"), "i").alias("rank"), "canonical", "numbers", F.size("words").alias("n_tokens"), F.array_distinct("words").alias("features"), "sig")


def hash_band(word, band):
    return (sum(map(ord, word)) * (band + 3)) % 251


def walk(texts, cfg):
    kept, gone = [], {}
    info = [(set(t.split()), [w for w in t.split() if w.isdigit()], {(b, hash_band(t.split()[b % len(t.split())], b)) for b in range(4)}) for t in texts]
    for v, t in enumerate(texts):
        fv, nv, bv = info[v]
        if len(t.split()) >= cfg.min_token_count and nv:
            for u in kept:
                fu, nu, bu = info[u]
                if nu == nv and bu & bv and (len(fu & fv) / len(fu | fv) >= cfg.jaccard_threshold or SequenceMatcher(None, t, texts[u]).ratio() >= cfg.sequence_threshold):
                    gone[v] = u
                    break
        if v not in gone:
            kept.append(v)
    return gone


@pytest.mark.parametrize("seed,few", [(1, 0), (2, 0), (3, 200_000), (4, 30)])
def test_equals_the_walk(spark, monkeypatch, seed, few):
    monkeypatch.setattr(dedup, "FEW_PAIRS", few)
    rng = random.Random(seed)
    words = [a + b for a in "bdf" for b in "aeio"]
    bases = [" ".join(rng.choices(words, k=12)) + " 7" for _ in range(6)]
    texts = []
    for _ in range(110):
        t = rng.choice(bases).split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            t[rng.randrange(12)] = rng.choice(words)
        texts.append(" ".join(t[:12] + rng.choice([["7"], ["7"], ["8"], []])))
    texts = list(dict.fromkeys(texts)) + ["da 7"]
    cfg = dedup.DedupConfig(jaccard_threshold=0.8, sequence_threshold=0.9)
    nodes = nodes_of(spark, texts).cache()
    got = {r["node"]["i"]: r["witness"]["i"] for r in dedup.dropped_nodes(nodes, cfg).collect()}
    assert got == walk(texts, cfg)


def test_a_large_group_of_copies_makes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FEW_PAIRS", 1000)
    seen, verified = [], dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, nodes, cfg: (seen.append(pairs.count()), verified(pairs, nodes, cfg))[1])
    n = 2000
    body = "one two three four five six seven eight nine ten 5 "

    nodes = spark.range(n).select(F.struct(F.lit(0).alias("p"), F.col("id").alias("i")).alias("rank"), F.concat(F.lit(body + "w"), "id").alias("canonical"), F.array(F.lit("5")).alias("numbers"), F.lit(12).alias("n_tokens"), F.split(F.lit(body.strip()), " ").alias("features"), F.lit(77).cast("long").alias("sig"))
    gone = dedup.dropped_nodes(nodes, dedup.DedupConfig()).collect()
    assert len(gone) == n - 1 and {r["witness"]["i"] for r in gone} == {0}
    assert sum(seen) <= 2 * n
