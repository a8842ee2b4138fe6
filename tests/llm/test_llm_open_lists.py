"""Open lists of the Jaccard join: components that link a lot meet by a few pairs, and no link is lost."""

import random

from abacora.llm import jaccard_join


def near_copies(n, groups, words=60):
    """Texts of which those of a group all link: each has one word of its own."""
    rng = random.Random(5)
    bases = [[f"g{g}w{rng.randrange(10**6)}" for _ in range(words)] for g in range(groups)]
    return [(i, " ".join([*bases[i % groups], f"own{i}"])) for i in range(n)]


def test_open_lists_give_few_pairs_of_components_that_link_a_lot(spark, monkeypatch):
    for name, value in (("LIST", 2), ("ROUNDS", 1), ("BLOCK", 100), ("FIRST", 8)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    hubs, verify, made = jaccard_join.hub_pairs, jaccard_join.verify, []
    # Hubs that tell nothing: all nodes are components of their own when open lists are looked at.
    monkeypatch.setattr(jaccard_join, "hub_pairs", lambda members, turn: hubs(members, turn).limit(0))
    monkeypatch.setattr(jaccard_join, "verify", lambda pairs, texts: (made.append(pairs.count()), verify(pairs, texts))[1])
    n, groups = 480, 2
    docs = spark.createDataFrame(near_copies(n, groups), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()}
    assert got == {i: i % groups for i in range(n)}
    every = groups * (n // groups) * (n // groups - 1) // 2
    assert sum(made) < every // 4


def test_waves_go_on_until_no_pair_is_left(spark, monkeypatch):
    """A wave of one pair a component settles little; members link with some others only."""
    for name, value in (("LIST", 2), ("ROUNDS", 1), ("FIRST", 1), ("GROWTH", 2), ("MOST", 4)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        t = list(base)
        for k in rng.sample(range(120), rng.choice([1, 2, 3, 4])):
            t[k] = f"x{i}y{k}"
        rows.append((i, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == {i: find(i) for i in sets}


def test_near_copies_that_do_not_link_are_no_rows(spark, monkeypatch):
    """Long texts of one base just below the threshold: bitmaps of their sets told nothing, and all pairs were handed on."""
    for name, value in (("LIST", 2), ("ROUNDS", 1), ("BLOCK", 16), ("WEIGHT", 8000)):
        monkeypatch.setattr(jaccard_join, name, value, raising=False)
    materialize, made = jaccard_join.materialize, []

    def count(df, name):
        out = materialize(df, name)
        if name == "jaccard-across":
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "materialize", count)
    n, rng = 48, random.Random(3)
    base, rows = [f"b{i}" for i in range(700)], []
    for i in range(n):
        t = list(base)
        for k in rng.sample(range(6, 690, 6), 13):
            t[k] = f"own{i}x{k}"
        rows.append((i, " ".join(t)))
    rows.append((n, rows[7][1] + " one more"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    linked = [(j, i) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = {i: i for i in sets}
    for _ in sets:
        for j, i in linked:
            want[i] = want[j] = min(want[i], want[j])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.join(docs).collect()} == want
    assert len(linked) < n
    assert made and sum(made) <= 2 * n
