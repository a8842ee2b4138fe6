"""Leaks that stand beside other variants, are edited, are short against their item, or have few ordinary words."""

import random

import pytest
import regex

from abacora.llm import decontaminate

ITEM = "If Anna Smith has 5 kg of apples and buys 12 more, how many kg does Anna have now?"

LONG = ITEM + " Later Anna gives 3 kg of them to her friend Mary Jones and keeps all the other ones at home for Anna and her mother."


def found(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"], r["verdict"]) for r in decontaminate.leaks(docs, bench).collect()}


def test_every_alignment_is_judged_where_it_matches(spark):
    muddled = "If Bob Jones has 7 kg of apples and buys 31 more, how many kg does Carl have now?"
    half = "If Anna Smith has 5 kg of apples and buys 12 more, how many kg does any other farm give Carl"
    texts = [
        muddled + " " + ITEM,  # an exact copy after a muddled one
        LONG.replace("and buys", "and then buys"),  # a word put in
        LONG.replace("apples and", "apples"),  # a word left out
        half,  # a part, and another name at the place of a slot beyond it
        muddled,
        muddled + " " + muddled,
    ]
    got = found(spark, [ITEM, LONG], texts)
    assert {x for x in got if x[1] == 0} >= {(0, 0, "verbatim"), (3, 0, "verbatim")}
    assert {x for x in got if x[1] == 1} >= {(1, 1, "verbatim"), (2, 1, "verbatim")}
    assert not {x for x in got if x[0] in (4, 5)}


def test_items_of_few_ordinary_words_are_met_literally(spark):
    items = ["What is 12 times 7?", "Add 3 5 7 9 11 13 and 15", LONG]
    texts = ["Tell me: what is 12 times 7? Thanks", "Please add 3 5 7 9 11 13 and 15 now", "What is 13 times 7?", "Add 4 6 7 9 12 13 and 15", LONG]
    assert found(spark, items, texts) == {(0, 0, "verbatim"), (1, 1, "verbatim"), (4, 2, "verbatim")}


def test_long_passages_of_longer_items_are_leaks(spark):
    words = [a + b for a in ("ka", "mo", "ri", "tu", "se") for b in (x + y for x in "bdfglmnprst" for y in "aeiou")][:200]
    item = " ".join(words)
    texts = ["so " + " ".join(words[40:140]) + " it", " ".join(words[60:73]), " ".join(words[60:72]), " ".join(reversed(words))]
    assert found(spark, [item], texts) == {(0, 0, "verbatim"), (1, 0, "verbatim")}


def test_runs_of_numbers_and_of_muddled_copies(spark):
    numbers = " ".join(str(i * i) for i in range(40))
    item = ITEM + " " + numbers + " " + " ".join(f"{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(80))
    muddled = "If Bob Jones has 7 kg of apples and buys 31 more, how many kg does Carl have now?"
    assert found(spark, [item], ["see " + " ".join(numbers.split()[5:30]), muddled + " " + numbers, muddled]) == {(0, 0, "verbatim"), (1, 0, "verbatim")}


def test_recall_of_reparameterised_items(spark):
    """Items with other numbers and names are found in nine of ten cases at least; with slots that contradict each other never."""
    rng = random.Random(4)
    things, verbs, names = "apples books coins stamps tickets".split(), "buys sells loses finds gives".split(), "Anna Bob Carla David Eva Frank Gina Hugo".split()
    filler = [a + b for a in ("ka", "mo", "ri", "tu") for b in ("lan", "mer", "nos", "pit", "ruk")]
    items, same, muddled = [], [], []
    for _ in range(40):
        middle, thing, verb = " ".join(rng.sample(filler, 2)), rng.choice(things), rng.choice(verbs)
        say = lambda who, also, n, k, t, v, mid: f"On one day, {who} has {n} {t} and {v} {k} more of them {mid} before noon, so how many {t} does {also} hold at the end?"
        a, b, c = rng.sample(names, 3)
        items.append(say(a, a, rng.randint(2, 99), rng.randint(2, 99), thing, verb, middle))
        same.append("Hello. " + say(b, b, rng.randint(100, 999), rng.randint(1000, 9999), thing, verb, middle) + " Thanks")
        muddled.append(say(b, c, rng.randint(100, 999), rng.randint(1000, 9999), thing, verb, middle))
    got = found(spark, items, same + muddled)
    assert len({(d, i) for d, i, v in got if d == i and v == "reparameterised"}) >= 36
    assert not {d for d, i, _ in got if d == i + 40}  # no 13 words in a row of its item, and a name that stands for two


# A plain matcher over every document and item


def plain_words(text):
    return regex.findall(decontaminate.WORD, text or "")


def plain_templates(text):
    n, name, unit = decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT
    out = regex.sub(r"(?<=[\p{L}0-9,;)] )\p{Lu}(?=\p{Ll})\p{L}*", name, text or "")
    out = regex.sub(r"[0-9]+(?:[.,][0-9]+)*", f" {n} ", out).lower()
    out = regex.sub(f"{n} +(?:{'|'.join(decontaminate.UNITS)})(?!\\p{{L}})", f"{n} {unit}", out)
    return [w for w in regex.split(f"[^\\p{{L}}{n}{name}{unit}]+", out) if w]


def row_length(places, own):
    return max((b + own - a for a in places for b in places if a <= b and all(any(x <= p < x + own for x in places) for p in range(a, b + own))), default=0)


def plain_leak(doc, item):
    """(share, verdict) of one text and one item text, or None."""
    words, low, temps = plain_words(doc), [w.lower() for w in plain_words(doc)], plain_templates(doc)
    iw, it = plain_words(item), plain_templates(item)
    own = min(len(it), decontaminate.WINDOW)
    if not own:
        return None
    slot = [t in (decontaminate.NUMBER, decontaminate.NAME, decontaminate.UNIT) for t in it]
    places = range(len(it) - own + 1)
    rich = {a for a in places if sum(not s for s in slot[a : a + own]) >= min(own, decontaminate.LITERALS)}
    counting = rich or set(places)
    ilow = [w.lower() for w in iw]
    met = {}
    for a in places:
        side, mine = (temps, it) if a in rich else (low, ilow)
        for p in range(len(side) - own + 1):
            if side[p : p + own] == mine[a : a + own]:
                met.setdefault(p - a, set()).add(a)
    hit = {a for ats in met.values() for a in ats if a in counting}
    if not (2 * len(hit) >= len(counting) or max((row_length(ats, own) for ats in met.values()), default=0) >= decontaminate.RUN) or not met:
        return None
    hit, run, best = set(), 0, None
    for offset, ats in met.items():
        covered = {p for a in ats for p in range(a, a + own) if slot[p]}
        value = {p: (ilow[p], words[p + offset].lower() if 0 <= p + offset < len(words) else "") for p in covered}
        consistent = len(set(value.values())) == len({v for v, _ in value.values()})
        exact = all(v == w for v, w in value.values())
        kept = ats if consistent else {a for a in ats if all(not slot[p] or ilow[p] == low[p + offset] for p in range(a, a + own))}
        run = max(run, row_length(kept, own))
        hit |= {a for a in ats if a in counting} if consistent else set()
        best = max(best or (False, -1, False), (consistent, len(ats), exact or not consistent))
    if 2 * len(hit) < len(counting) and run < decontaminate.RUN:
        return None
    return len(hit) / len(counting), "short" if len(it) < decontaminate.LEAST_WORDS else "verbatim" if best[2] else "reparameterised"


def plain_pairs(items, texts):
    out = {}
    for d, doc in texts:
        for i, item in items:
            if d is not None and i is not None and (got := plain_leak(doc, item)):
                rank = (got[1] != "short", got[0], got[1] == "verbatim")
                if (d, i) not in out or rank > out[d, i][0]:
                    out[d, i] = (rank, got[1])
    return {(d, i, v) for (d, i), (_, v) in out.items()}


@pytest.mark.parametrize("seed,broadcast", [(1, 500_000), (2, 0)])
def test_pairs_equal_a_plain_matcher(spark, monkeypatch, seed, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    rng = random.Random(seed)
    names, plain = ["Anna", "Bob", "Carla Diaz"], "so we buy some of the old apples and then give them all away to one kind friend who sells very few".split()
    filler = [a + b for a in ("ka", "mo", "ri") for b in ("lan", "mer", "nos")]

    def item():
        who, also, n, k = rng.choice(names), rng.choice(names), rng.randint(2, 99), rng.randint(2, 99)
        said = rng.sample(plain, rng.choice([0, 2, 6, 14]))
        return lambda who=who, also=also, n=n, k=k: f"One day {who} has {n} kg and {' '.join(said)} {k} for {also}, then {who} keeps {n} of it"

    made = [item() for _ in range(12)]
    items = [(i, f()) for i, f in enumerate(made)] + [(20, "alpha"), (21, "two words"), (22, "What is 12 times 7?"), (23, None), (24, ""), (None, "so we buy"), (5, "a second text of item five, with 3 apples and more")]
    texts = []
    for d in range(60):
        f, bits = rng.choice(made), rng.choices(filler, k=6)
        body = rng.choice([f, lambda f=f: f("Zoe", "Eve", 123, 45), lambda f=f: f("Zoe").replace("Zoe keeps", "Gus keeps"), lambda f=f: " ".join(f().split()[: rng.randint(4, 16)]), lambda: "the alpha male and two words", lambda: "what is 12 times 7 " * 3, lambda f=f: f().replace(" and ", " and then ", 1)])()
        texts.append((d, " ".join(bits[:3]) + ". " + body + " " + " ".join(bits[3:])))
    texts += [(0, "zzz other text"), (1, items[2][1]), (None, items[2][1]), (70, None), (71, ""), (72, items[12][1] + " a second text of item five, with 9 apples and more"), texts[3]]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], r["item_id"], r["verdict"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == plain_pairs(items, texts)
    assert {v for _, _, v in got} == {"verbatim", "reparameterised", "short"}


def test_texts_under_one_id_and_short_items(spark):
    items = spark.createDataFrame([(1, ITEM), (2, "alpha"), (3, "some other text"), (3, LONG)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM), (1, "zzz other text"), (2, "the alpha male"), (3, LONG), (4, "clean")], "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"], r["verdict"]) for r in decontaminate.leaks(docs, items).collect()} >= {(1, 1, "verbatim"), (2, 2, "short"), (3, 3, "verbatim")}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {2, 4}


def test_documents_are_read_twice_for_any_lengths(spark, tmp_path):
    words = "one two three four five six seven eight nine".split()
    items = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(1, 10)] + [(20, "3 4 5 6")], "item_id long, text string")
    spark.createDataFrame([(1, " ".join(words)), (2, "3 4 5 6"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id")
    windows = decontaminate.with_windows(docs, "doc_id", "text", list(range(1, 9)), [4])
    assert scans(windows) == 1
    out = decontaminate.leaks(docs, items)
    assert scans(out) == 1 and {r["doc_id"] for r in out.collect()} == {1, 2}
