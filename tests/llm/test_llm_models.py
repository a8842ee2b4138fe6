"""Centroid clustering, the hidden Markov model and periodic runs against brute force, with edge cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from abacora.llm import centroid_clustering as clustering
from abacora.llm import hidden_markov as hmm
from abacora.llm import periodic_runs, queries


def texts(seed, n=40):
    rng = random.Random(seed)
    vocabulary = [["ka", "Ke", "ki", "ko"], ["lume", "lama", "lim", "lom", "KA"]]
    out = [" ".join(rng.choices(vocabulary[i % 2], k=rng.randint(1, 40))) for i in range(n)]
    return out + [None, "", " \n\t ", "one", "A a", "x " * 30, " ".join(rng.choices(vocabulary[0], k=5000)), out[0], out[0]]


# Centroid clustering


def reference_clusters(rows, k, rounds, d):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    x = np.array([[math.floor(256 * a) for a in v] for _, v in kept])
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"2:{kept[j][0]}".encode()).hexdigest(), x[j].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        far = ((x[:, None] - c[None]) ** 2).sum(2)
        at = far.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = [int(s) // int((at == j).sum()) for s in x[at == j].sum(0)]
    best = far.min(1)
    return sorted((str(i), int(at[j]), int(best[j]), int(best[at == at[j]].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[at[j]])).encode()).hexdigest()) for j, (i, _) in enumerate(kept))


@pytest.mark.parametrize("seed,k,rounds", [(1, 5, 3), (2, 40, 5), (3, 3, 0)])
def test_clusters_equal_brute_force_with_ties_repeats_and_unusable_vectors(spark, seed, k, rounds):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.1, 2.0]) for _ in range(6)]) for i in range(120)]
    rows += [(7, rows[7][1]), (8, rows[8][1]), (200, None), (201, [1.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] * 6), (None, [0.3] * 6)]
    rows += [(300 + i, [0.5] * 6) for i in range(60)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, v int").repartition(5)
    got = sorted((str(r[0]), *r[1:]) for r in clustering.cluster(table, k=k, rounds=rounds, dimensions=6).collect())
    assert got == reference_clusters(rows, k, rounds, 6)


def test_clusters_of_few_or_no_vectors_and_of_too_large_components(spark):
    schema = "vec_id long, embedding array<double>"
    assert clustering.cluster(spark.createDataFrame([], schema)).count() == 0
    two = clustering.cluster(spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], schema)).collect()
    assert {r["distance"] for r in two} == {0} and len({r["cluster"] for r in two}) == 2
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e9] * 64)], schema)).collect()


def test_partial_distance_search_equals_full_search_and_finishes_fewer_pairs():
    rng = np.random.default_rng(5)
    centroids = rng.integers(-200, 200, (40, 64))
    x = centroids[rng.integers(0, 40, 2000)] + rng.integers(-20, 20, (2000, 64))
    x[:50] = centroids[3]
    centroids[9] = centroids[3]
    full = ((x[:, None] - centroids[None]) ** 2).sum(2)
    at, far, finished = clustering.nearest(x, centroids)
    assert (at == full.argmin(1)).all() and (far == full.min(1)).all()
    assert 2000 <= finished < 2000 * 40 // 4


# Hidden Markov model


def dense(codes, sizes, emit, m):
    """Forward and backward without scaling, text by text."""
    k = len(m.start)
    logs, starts, moves, words, o = [], np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k)), 0
    for n in sizes:
        c, o = codes[o : o + n], o + n
        a, b = np.zeros((n, k)), np.ones((n, k))
        a[0] = m.start * emit[c[0]]
        for t in range(1, n):
            a[t] = (a[t - 1] @ m.moves) * emit[c[t]]
        for t in range(n - 2, -1, -1):
            b[t] = m.moves @ (emit[c[t + 1]] * b[t + 1])
        whole = a[-1].sum()
        logs.append(math.log10(whole))
        g = a * b / whole
        starts += g[0]
        np.add.at(words, c, g)
        for t in range(n - 1):
            moves += a[t][:, None] * m.moves * (emit[c[t + 1]] * b[t + 1])[None] / whole
    return np.array(logs), starts, moves, words


@pytest.mark.parametrize("segment,group", [(1, 8), (3, 40), (7, 1 << 17), (1024, 64)])
def test_recursions_equal_dense_ones_however_texts_are_cut(monkeypatch, segment, group):
    monkeypatch.setattr(hmm, "GROUP", group)
    rng = np.random.default_rng(segment)
    k = hmm.STATES
    sizes = rng.integers(1, 30, 7).astype(np.int64)
    codes, emit = rng.integers(0, 20, sizes.sum()), rng.random((20, k)) * 0.2 + 1e-3
    moves, start = rng.random((k, k)) + 0.01, rng.random(k)
    m = hmm.Model(start / start.sum(), moves / moves.sum(1)[:, None], 100, 20, np.full(k, 10.0))
    want = dense(codes, sizes, emit, m)
    assert np.allclose(hmm.likelihood(codes, sizes, emit.T.copy(), m, segment), want[0])
    starts, moves, words = hmm.expect(codes, sizes, emit.T.copy(), m, segment)
    assert np.allclose(starts, want[1]) and np.allclose(moves, want[2]) and np.allclose(words.T, want[3])


def plain_training(rows):
    """The same training over plain dictionaries in one place; lean(id) of the first round is read from the words' order."""
    tokens = [[*(t or "").encode().lower().split(), b" "] for _, t, _ in rows]
    learn = [bool(mark) for _, _, mark in rows]
    count = {}
    for ws, own in zip(tokens, learn):
        for w in ws if own else []:
            count[w] = count.get(w, 0) + 1
    return tokens, learn, count


def test_scores_equal_one_place_training(spark, monkeypatch):
    """All texts in one chunk, so that the number of a word is its place: Baum-Welch over dense recursions gives the same scores."""
    monkeypatch.setattr(hmm, "UNIT", 1 << 40)  # rounds grow differences on so few texts, so counts are kept finely here
    order = [(0, 1), (0, 1)]  # one chunk: the first part has it, the second nothing
    rows = [(i, t, i % 7 != 2) for i, t in enumerate(t for t in texts(4, 24) if len(t or "") < 300)]
    tokens, learn, count = plain_training(rows)
    n, v, k = sum(count.values()), len(count), hmm.STATES
    first = {}
    for ws in tokens:
        for w in ws:
            first.setdefault(w, len(first))
    df = spark.createDataFrame([(first[w], count[w]) for w in first if w in count], "id long, c long")
    number = {r["id"]: np.array([r[f"n{s}"] for s in range(k)], float) / hmm.UNIT for r in hmm._leaning(df).collect()}
    m = hmm.Model(np.full(k, 1 / k), np.full((k, k), (1 - hmm.STAY) / (k - 1)), n, v, np.full(k, n / k))
    np.fill_diagonal(m.moves, hmm.STAY)
    rare = {c: [w for w in count if count[w] == c] for c in range(1, hmm.OWN)}
    for c in rare:
        m.shared[c] = c / k
    expected = {w: number.get(first[w], np.zeros(k)) for w in count}
    vocabulary = list(first)
    codes = {w: i for i, w in enumerate(vocabulary)}

    def emissions():
        c = np.array([count.get(w, 0) for w in vocabulary])
        return m.emissions(c, np.array([expected.get(w, np.zeros(k)) for w in vocabulary]).T).T

    for i, of in order:
        own = [ws for ws, a in zip(tokens, learn) if a][i::of]
        _, starts, moves, words = dense(np.array([codes[w] for ws in own for w in ws]), [len(ws) for ws in own], emissions(), m)
        expected = {w: words[codes[w]] for w in count}
        shared = np.zeros((hmm.OWN, k))
        for c, ws in rare.items():
            if ws:
                shared[c] = sum(words[codes[w]] for w in ws) / len(ws)
        start, moves = starts + hmm.FLOOR, moves + hmm.FLOOR
        m = hmm.Model(start / start.sum(), moves / moves.sum(1)[:, None], n, v, words.sum(0), shared)
    want = dense(np.array([codes[w] for ws in tokens for w in ws]), [len(ws) for ws in tokens], emissions(), m)[0]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark boolean").coalesce(1)
    got = {r["doc_id"]: r for r in hmm.train_and_score(docs, F.col("mark"), parts=2).collect()}
    for (i, _, _), ws, score in zip(rows, tokens, want):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in count for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r["score"] == pytest.approx(score, rel=1e-3)


def test_emissions_are_a_distribution():
    rng = np.random.default_rng(2)
    count = np.array([1, 1, 2, 3, 9, 14, 40, 0])
    expected = rng.random((8, hmm.STATES)) * count[:, None]
    expected *= (count / np.maximum(expected.sum(1), 1e-9))[:, None]
    shared = np.zeros((hmm.OWN, hmm.STATES))
    for c in range(1, hmm.OWN):
        shared[c] = expected[count == c].mean(0)
    m = hmm.Model(np.full(hmm.STATES, 1 / hmm.STATES), np.eye(hmm.STATES), 70, 7, expected.sum(0), shared)
    assert np.allclose(m.emissions(count, expected.T).sum(1), 1)


def test_held_out_texts_score_better_than_by_counts_alone_and_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(hmm, "CHUNK", 2000)
    rows = [(i, t, "de", i) for i, t in enumerate(texts(9, 200))] + [(None, "ka ke", None, None), (3, "twice lume", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words string, c long").repartition(6)
    got = hmm.train_and_score(docs, F.col("doc_id") % 7 != 2).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 1
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] % 7 == 2 and r["n_tokens"] > 5]
    assert sum(r["score"] > r["base_score"] for r in held) >= 0.95 * len(held)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["n_tokens"] for i in (200, 201, 202, 203)] == [1, 1, 1, 2] and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    none = hmm.train_and_score(docs, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["score"] == pytest.approx(r["base_score"]) for r in none)
    assert hmm.train_and_score(docs.limit(0), F.lit(True)).count() == 0
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hmm_")]


# Periodic runs


def reference_runs(ws, shortest=12):
    n, got = len(ws), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and ws[j] == ws[j + p]:
                j += 1
            if j > i and j - i + p >= max(shortest, 2 * p):
                got.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((s, size, p) for (s, size), p in got.items())


def reference_report(doc_id, text):
    ws = (text or "").encode().split()
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
    runs = reference_runs(ws)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    digest = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in sorted(runs, key=lambda r: (r[0], r[2])))
    return (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), digest(lines.encode()), digest(b" ".join(w for i, w in enumerate(ws) if i not in gone)))


def test_periodic_runs_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    made = [" ".join(rng.choices(["a", "b", "c"], k=rng.randint(0, 60))) for _ in range(120)] + texts(3)
    made += [" x\x00  y " * 12, "word " * 4000, " ".join(f"w{i % 37}" for i in range(700)) + " tail", "\n".join(["p q"] * 9)]
    docs = spark.createDataFrame([(i * 5, t, "en", 1, 2) for i, t in enumerate(made)], "doc_id long, text string, lang string, start int, number int").repartition(4)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(made) and sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in got) > 5
    for i, t in enumerate(made):
        assert got[i * 5] == reference_report(i * 5, t), t


@pytest.mark.parametrize("candidates,words,shortest", [(7, 50, 12), (1 << 19, 1, 2), (100, 1 << 18, 30)])
def test_runs_do_not_depend_on_pieces(monkeypatch, spark, candidates, words, shortest):
    monkeypatch.setattr(periodic_runs, "CANDIDATES", candidates)
    rng = random.Random(words)
    for _ in range(60):
        some = []
        for _ in range(rng.randint(1, 5)):
            t = [rng.randrange(rng.choice([1, 2, 40])) for _ in range(rng.choice([0, 1, 12, 13, 90]))]
            p = rng.randint(1, len(t) or 1)
            some.append((t[:p] * len(t))[: len(t)] if rng.random() < 0.5 else t)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in some])]).astype(np.int64)
        who, start, size, period = periodic_runs.find_runs(np.array([c for t in some for c in t], np.int64), offsets, shortest)
        for i, t in enumerate(some):
            assert list(zip(start[who == i], size[who == i], period[who == i])) == reference_runs(t, shortest)


def test_runs_of_null_ids_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a b " * 8), (1, "a b " * 8), (1, "a b " * 8), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_runs"], r["starts"], r["lengths"], r["periods"], r["n_dropped"], bytes(r["collapsed"])) for r in periodic_runs.runs(docs).collect()), key=str)
    run = (1, [0], [16], [2], 14, b"a b")
    none = (0, [], [], [], 0, b"")
    assert got == sorted([(None, *run), (1, *run), (1, *run), (2, *none), (3, *none)], key=str)
    assert periodic_runs.runs(docs.limit(0)).count() == 0
