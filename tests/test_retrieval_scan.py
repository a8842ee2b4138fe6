"""Records scored where they are read: the same rows as the index with bounds, and no shuffle or store of records."""

import random

import pytest
from test_retrieval import TOKENS, plain

from abacora.operators import select


def _tables(spark, rng, n):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["7", "12", "3a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    say = lambda most: " ".join(rng.choices(words, weights, k=rng.randint(1, most)))
    records = [(i, say(40)) for i in range(n)] + [(n + i, "waa wba") for i in range(20)] + [(900_000, None), (900_001, "")]
    queries = [(i, say(20)) for i in range(30)] + [(90, None), (91, "nowhere"), (92, "waa wba")]
    return queries, records, spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame(records, "record_id long, text string")


def _rows(df):
    return {(r["query_id"], r["place"], r["record_id"], round(r["score"], 9)) for r in df.collect()}


@pytest.mark.parametrize("most,cells", [(0, 1_000_000), (500_000, 1_000_000), (500_000, 1), (500_000, 700)])
def test_both_ways_and_any_block_size_equal_scoring_every_pair(spark, monkeypatch, most, cells):
    monkeypatch.setattr(select, "SCAN_TOKENS", most)
    monkeypatch.setattr(select, "SCAN_CELLS", cells)
    queries, records, q, r = _tables(spark, random.Random(4), 200)
    assert _rows(select.retrieve(q, r, 3, tokens=TOKENS)) == plain(queries, records, 3)


def test_ids_that_are_strings_and_no_queries_at_all(spark):
    queries, records, q, r = _tables(spark, random.Random(5), 60)
    named = select.retrieve(q.selectExpr("concat('q', query_id) AS query_id", "text"), r.selectExpr("concat('r', record_id) AS record_id", "text"), 2, tokens=TOKENS)
    want = {(f"q{a}", p, d, s) for a, p, d, s in plain(queries, [(f"r{i}", t) for i, t in records], 2)}
    assert _rows(named) == want
    assert select.retrieve(q.filter("query_id < 0"), r, 2, tokens=TOKENS).count() == 0


def test_records_are_neither_stored_nor_shuffled(spark, monkeypatch):
    tags, stored = [], select.stored
    monkeypatch.setattr(select, "stored", lambda df, tag: tags.append(tag) or stored(df, tag))
    *_, q, r = _tables(spark, random.Random(6), 100)
    made = select.retrieve(q, r, 3, tokens=TOKENS)
    assert tags == ["retrieval-queries"]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
