"""Language ID and toxicity against plain versions of their scorers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abacora.llm import language_id, toxicity
from abacora.llm._shared import hash_words


# Language ID: sets of grams in place of filters


def plain_grams(text):
    folded = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in f"   {text.lower()}   ".encode())
    return [folded[i : i + 5] for i in range(len(folded) - 4)]


def corpora(seed, n=240):
    rng = random.Random(seed)
    tongues = {"aa": ["kaluna", "mireto", "sola", "venti", "pora"], "bb": ["zwerk", "stryn", "oft", "brelm", "grund"], "cc": ["été", "naïve", "œuvre", "sola", "venti"]}
    return [(i, " ".join(rng.choices(tongues[lang], k=rng.randint(1, 30))) + rng.choice(["", ".", " 12!", "\n"]), lang) for i in range(n) for lang in [rng.choice(list(tongues))]]


def test_languages_equal_plain_sets_of_grams(spark):
    rows = corpora(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = language_id.train(docs, F.lit(True))
    counts = {}
    for _, t, lang in rows:
        for g in plain_grams(t):
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += 1
    rates = {lang: {g: c / sum(x for x in cs.values() if x > 1) for g, c in cs.items() if c > 1} for lang, cs in counts.items()}
    kept = {lang: {g for g, r in rs.items() if r >= language_id.SHARE * max(o.get(g, 0) for o in rates.values())} for lang, rs in rates.items()}
    own = {lang: sum(rates[lang][g] for g in gs) for lang, gs in kept.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, filters).collect()}
    assert filters.false_rate.max() < 1e-6
    for i, t, _ in rows:
        grams = plain_grams(t)
        shares = {lang: sum(g in kept[lang] for g in grams) / len(grams) / own[lang] for lang in sorted(kept)}
        best = max(shares, key=lambda lang: shares[lang])
        assert got[i][0] == best and got[i][1] == pytest.approx(shares[best] / sum(shares.values()), rel=1e-6)


def test_full_filters_are_corrected(monkeypatch):
    """With slots so few that filters hold much that nobody put in, corrected shares of strange text stay near 0 and the right language wins."""
    monkeypatch.setattr(language_id, "SLOT_BITS", 8)
    rows = corpora(5)
    grams = {lang: sorted({int.from_bytes(g, "little") for _, t, of in rows if of == lang for g in plain_grams(t)}) for lang in ("aa", "bb", "cc")}
    flat = [(lang, g) for lang, gs in grams.items() for g in gs]
    f = language_id.build(np.array([x for x, _ in flat], object), np.array([g for _, g in flat], np.uint64), np.full(len(flat), 1 / 100))
    assert f.false_rate.max() > 0.02
    rng = random.Random(1)
    strange = [" ".join("".join(rng.choices("qxjh", k=7)) for _ in range(400)) for _ in range(20)]
    totals, hits = f.hits(*language_id.text_buffers(language_id._lowered(pa.array(strange))))
    raw = hits / totals[:, None]
    corrected = f.shares(totals, hits) * f.own_rate
    assert raw.max() > 0.02 and np.abs(corrected).mean() < 0.4 * raw.mean()
    best, _, _ = language_id.decide(pa.array([t for _, t, _ in rows if len(t) > 40]), f)
    truth = [lang for _, t, lang in rows if len(t) > 40]
    assert sum(a == b for a, b in zip(best, truth)) >= 0.95 * len(truth)


def test_recall_of_every_language_held_out_and_clashing_columns(spark):
    rows = corpora(8, 600)
    docs = spark.createDataFrame([(i, t, lang, "x", 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, F.col("doc_id") % 4 != 2).collect()}
    for lang in ("aa", "bb", "cc"):
        held = [i for i, t, of in rows if of == lang and i % 4 == 2 and len(t) > 25]
        assert sum(got[i] == lang for i in held) >= 0.95 * len(held)


# Toxicity: a dictionary of the model's words, text by text


def number(word):
    raw = np.frombuffer(word, np.uint8)
    return hash_words(raw, np.array([0]), np.array([len(raw)]), lower=True)[0]


def stem_number(word, k):
    return toxicity.mix(np.array([number(word[:k]) + np.uint64(k)], np.uint64))[0] | toxicity._STEM


def plain_score(text, m):
    words = []
    for w in (text or "").encode().split():
        for _ in range(4):
            w = w[1:] if w and toxicity._TRIM[w[0]] else w
            w = w[:-1] if w and toxicity._TRIM[w[-1]] else w
        if w:
            words.append(bytes(b + 32 if 65 <= b <= 90 else b for b in w))
    at = {int(h): i for i, h in enumerate(m.lexicon)}
    counts = [0] * len(at)
    stems = {i for h, i in at.items() if h & int(toxicity._STEM)}
    for w in words:
        if (i := at.get(int(number(w) & ~toxicity._STEM))) is not None:
            counts[i] += 1
        for k in toxicity.PREFIXES:
            if len(w) > k and (i := at.get(int(stem_number(w, k)))) is not None:
                counts[i] += 1
    met = sum(counts[i] for i in stems)
    if met < 2 or met < toxicity.STEM_RATE * len(words):
        counts = [0 if i in stems else c for i, c in enumerate(counts)]
    raw = (text or "").encode()
    upper, letters = sum(65 <= b <= 90 for b in raw), sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw)
    doubled = sum(a in b"!?#$%&*" and b in b"!?#$%&*" for a, b in zip(raw, raw[1:]))
    again = sum(a == b for a, b in zip(words, words[1:]))
    hits = sum(counts)
    more = [hits > 0, hits > 1, math.log1p(hits), min(1, 50 * hits / max(len(words), 1)), upper / max(letters, 1), min(1, doubled / 10), again / max(len(words), 1)]
    z = sum(w * x for w, x in zip(m.weights, [*map(math.log1p, counts), *more])) + m.bias
    return 1 / (1 + math.exp(-max(-40, min(40, z))))


def test_scores_equal_a_plain_scorer_with_the_fitted_weights(spark):
    rng = random.Random(4)
    clean, bad = [a + b for a in ("ka", "mo", "ri", "tu") for b in ("lan", "mer", "nos", "pit")], ["vilecraft", "vilehound", "Gorrak", "shnorble"]
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        ws = rng.choices(clean, k=rng.randint(1, 40)) + (rng.choices(bad, k=rng.randint(2, 5)) if toxic else [])
        rng.shuffle(ws)
        rows.append((i, rng.choice([" ", "\n"]).join(rng.choice([w, w.upper(), f"({w}!)", f"{w}??!!"]) for w in ws), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "!!! ??? ..."), (903, "vilecrafts vilecrafty vilehounds")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.lexicon) and (model.lexicon & toxicity._STEM != 0).any()
    clashing = docs.withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(clashing, model).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert got[i] == pytest.approx(plain_score(t, model), rel=1e-5)
