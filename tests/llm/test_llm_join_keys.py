"""Join keys are cut to fewer bits; keys that fall together lose no link. Texts under one doc_id are shuffled once."""

import random

from abacora.llm import jaccard_join


def rows_of(n=90, words=70):
    rng = random.Random(11)
    bases = [[f"g{g}w{rng.randrange(10**6)}" for _ in range(words)] for g in range(n // 3)]
    rows = []
    for i in range(n):
        t = list(bases[i % len(bases)])
        for k in rng.sample(range(words), rng.choice([0, 1, 2])):
            t[k] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    return rows


def by_hand(rows):
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    want[i] = want[j] = min(want[i], want[j])
    return want


def test_posting_keys_have_few_bits(spark):
    docs = spark.createDataFrame(rows_of(12), "doc_id long, text string")
    order = jaccard_join.sketch(jaccard_join.describe(docs).filter("kind = 1"))
    keys = [r["key"] for r in jaccard_join.postings(docs, order, 0).collect()]
    assert keys and all(0 <= k < 1 << 48 for k in keys)


def test_keys_that_fall_together_lose_no_link(spark, monkeypatch):
    rows = rows_of()
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    for spare in (16, 54):  # with 10 bits, most sets have keys that fall together
        monkeypatch.setattr(jaccard_join, "KEY_SPARE", spare, raising=False)
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == by_hand(rows)
