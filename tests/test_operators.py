"""Operators on small tables and against sequential versions written for the tests."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from abacora.operators import align, curate, dedup, reports, score, select, taxonomy, vote
from abacora.sources import records


def scored(spark, pairs):
    rows = spark.createDataFrame(pairs, "model_output string, response_vi string, type string")
    return score.score_rows(rows)


def test_evaluate_fixtures(spark):
    rows = scored(spark, [("####đáp án là: 42", "Câu trả lời là: 42", "A"), ("####đáp án là: 72 ô", "Đáp án là: 72", ""), ("hm", "Đáp án là: 1", None)])
    s = score.summary(rows).first()
    assert (s["n"], s["raw_score"], s["exact_count"], s["extractable"], s["max_raw_score"]) == (3, 20, 2, 2, 30)
    assert {r["type"]: r["n"] for r in score.score_by_type(rows).collect()} == {"A": 1, "UNKNOWN": 2}
    empty = score.summary(rows.limit(0)).first()
    assert (empty["n"], empty["raw_score"], empty["score_10"], empty["rel_error_mean"]) == (0, 0, 0.0, None)


def test_score_steps_and_diagnostics(spark):
    errors = [0.01, 0.0100001, 0.10, 0.5, 0.51, None]
    df = spark.createDataFrame([(e,) for e in errors], "e double")
    assert [r[0] for r in df.select(score.score_one(F.col("e"), F.lit(True))).collect()] == [10, 5, 5, 1, 0, 0]
    d = score.diagnostics(spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 4.0, 9.0)], "rel_error double")).first()
    assert d["p90_rel_error"] == pytest.approx(7.0) and d["worst_5_errors"] == [9.0, 4.0, 0.5, 0.1, 0.0]
    assert score.diagnostics(spark.createDataFrame([], "rel_error double")).count() == 0


def test_published_invariants():
    assert 303 * 10 + 16 * 5 + 175 == 3285 and 157 * 10 + 7 * 5 + 77 == 1682


def test_align(spark):
    gold = spark.createDataFrame([("1", 5.0), ("2", 6.0)], "id string, gold double")
    pred = spark.createDataFrame([("1", 0, 1.0), ("1", 3, 2.0), ("2", 1, 3.0), ("9", 2, 4.0)], "id string, row_idx long, pred double")
    assert sorted((r["id"], r["pred"]) for r in align.align_by_id(pred, gold, ["pred"], ["gold"], check=True).collect()) == [("1", 2.0), ("2", 3.0)]
    with pytest.raises(align.MissingPredictions, match="missing 1 ids, e.g. .'2'"):
        align.align_by_id(pred.filter("id <> '2'"), gold, ["pred"], ["gold"], check=True)
    with pytest.raises(ValueError):
        align.align_by_position(pred.select("row_idx", "pred"), gold.withColumn("row_idx", F.lit(0)), check=True)


def test_vote_fixture_and_order(spark):
    texts = ["####đáp án là: 37", "48 - 11 = 37\n####đáp án là: 37 ô", "####đáp án là: 38"]
    for order in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        c = spark.createDataFrame([("r", i, texts[k]) for i, k in enumerate(order)], "record_id string, sample_idx int, text string")
        v = vote.vote_candidate_texts(c).first()
        assert (v["chosen"], v["reason"], v["vote_count"]) == ("####đáp án là: 37", "numeric_majority", 2)
    c = spark.createDataFrame([("a", 0, "none here"), ("a", 1, "none"), ("b", 0, "it is 5")], "record_id string, sample_idx int, text string")
    out = {r["record_id"]: (r["chosen"], r["reason"]) for r in vote.vote_candidate_texts(c, spark.createDataFrame([("a",), ("b",), ("c",)], "record_id string")).collect()}
    assert out == {"a": ("none", "no_parseable_answer"), "b": ("####đáp án là: 5", "single_parseable_answer"), "c": ("", "empty_candidates")}


def test_taxonomy(spark):
    rows = [("", False, 0, None, None, ["extraction_failure", "premature_eos"]), ("a b c d e", True, 0, 5.0, -5.0, ["operator_sign_mistake"]), ("a b c d e", True, 0, 500.0, 5.0, ["decimal_placement_error"]), ("a b c d e", True, 0, 7.0, 5.0, ["arithmetic_mistake"]), ("a b c d e", True, 0, 0.0, 5.0, ["arithmetic_mistake"]), ("a b c d e", True, 0, None, 5.0, ["formatting_drift"]), ("x y z " * 6, True, 10, 5.0, 5.0, ["repetition_loop"]), ("a b c d e", True, 5, 5.0, 5.1, ["reasoning_collapse"]), ("a b c d e", True, 10, 5.0, 5.0, ["clean_pass"])]
    df = spark.createDataFrame([r[:5] for r in rows], "model_output string, extractable boolean, score int, pred_num double, gold_num double")
    got = df.select(taxonomy.failures(F.col("model_output"), F.col("extractable"), F.col("score"), F.col("pred_num"), F.col("gold_num")).alias("f")).collect()
    assert [r["f"] for r in got] == [r[5] for r in rows]


def test_dedup_fixtures(spark):
    q = "Lan có 5 quả táo và mua thêm 7 quả, hỏi Lan có bao nhiêu quả táo?"
    r = spark.createDataFrame([(0, "GSM_AnsAug", q, ""), (1, "GSM_Rephrased", q, ""), (2, "GSM_SV", q.replace("5", "6"), ""), (3, None, "", ""), (4, None, None, "")], "row_idx long, type string, query string, target string")
    out = {x["row_idx"]: (x["decision"], x["kept_idx"]) for x in dedup.decide(r).collect()}
    assert out == {0: ("exact", 1), 1: ("kept", None), 2: ("kept", None), 3: ("kept", None), 4: ("kept", None)}


def sequential(rows):
    """Walk in rank order; each record is compared with the kept ones that share numbers and a SimHash band."""
    import hashlib
    import re

    def sig(features):
        total = [0] * 64
        for f in features:
            v = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "big")
            total = [t + (1 if v >> i & 1 else -1) for i, t in enumerate(total)]
        return sum(1 << i for i, t in enumerate(total) if t >= 0)

    kept, decision = [], {}
    for i, text in sorted(rows, key=lambda r: (len(r[1].split()), r[0])):
        tokens = re.findall(r"-?\d+(?:\.\d+)?|[a-z]+|[+\-*/=<>]", text)
        features = {f"u:{t}" for t in tokens} | {f"b:{a}_{b}" for a, b in zip(tokens, tokens[1:])}
        numbers = re.findall(r"-?\d+(?:\.\d+)?", text)
        s = sig(features)
        if any(k[0] == text for k in kept):
            decision[i] = "exact"
            continue
        near = [k for k in kept if k[2] == numbers and any((k[3] ^ s) >> 16 * b & 0xFFFF == 0 for b in range(4))]
        if len(tokens) >= 6 and numbers and any(len(features & k[1]) / len(features | k[1]) >= 0.9 or difflib.SequenceMatcher(None, text, k[0]).ratio() >= 0.94 for k in near):
            decision[i] = "similar"
            continue
        kept.append((text, features, numbers, s))
        decision[i] = "kept"
    return decision


def test_dedup_against_a_sequential_walk(spark):
    rng = random.Random(4)
    words = "lan mua ban keo tao cam xoai gia tien con lai them bot hop thung".split()
    base = [" ".join(rng.choices(words, k=14)) + f" {rng.randint(1, 9)} va {rng.randint(10, 19)}" for _ in range(12)]
    rows = []
    for i in range(120):
        t = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(14)] = rng.choice(words)
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame([(i, None, t, "") for i, t in rows], "row_idx long, type string, query string, target string")
    got = {r["row_idx"]: r["decision"] for r in dedup.decide(df).collect()}
    wanted = sequential(rows)
    # A copy of a record that was dropped as similar is similar, too.
    assert {i for i in got if got[i] == "kept"} == {i for i in wanted if wanted[i] == "kept"}
    assert got == wanted


def test_greedy_is_not_components(spark):
    e = spark.createDataFrame([(0, 1), (1, 2)], "u long, v long")
    assert [(r["node"], r["witness"]) for r in dedup.greedy(e).collect()] == [(1, 0)]
    assert dedup.greedy(e.limit(0)).count() == 0


@pytest.mark.parametrize(("most", "n"), [(200_000, 400), (3, 9)])
def test_greedy_settles_long_chains(spark, monkeypatch, most, n):
    monkeypatch.setattr(dedup, "SETTLE_EDGES", most)
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert sorted((r["node"], r["witness"]) for r in dedup.greedy(e).collect()) == [(i, i - 1) for i in range(1, n + 1, 2)]


def test_targets(spark):
    given = ["Lan có 2 + 3 = 5 quả. Đáp án là: 5", "Đáp án là: 2.5", "không có gì", None]
    df = spark.createDataFrame([(t,) for t in given], "response_vi string")
    out = [r[0] for r in df.select(curate.build_target(F.col("response_vi"))).collect()]
    assert out == ["2 + 3 = 5 quả\n####đáp án là: 5", "####đáp án là: 2.5", None, None]
    assert curate.attach_targets(df).count() == 2


def test_stage_accounting(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "x int")
    out = curate.stage_accounting(df, [("a", F.col("x") > 1), ("b", F.col("x") > 4)]).orderBy("stage_no").collect()
    assert [(r["stage"], r["rows_left"]) for r in out] == [("input", 10), ("a", 8), ("b", 5)]


def test_retrieve(spark):
    q = spark.createDataFrame([(1, "Có 5 quả táo"), (2, "")], "query_id long, text string")
    r = spark.createDataFrame([(1, "5 quả cam"), (2, "táo xanh"), (3, "không liên"), (4, "5 quả cam")], "record_id long, text string")
    assert [(x["record_id"], x["place"]) for x in select.retrieve(q, r, 2).orderBy("place").collect()] == [(1, 1), (4, 2)]


def test_parsers(spark):
    log = "<tr><td>1</td><td>0.5</td><td>0.75</td></tr> Epoch 1: checkpoint-7 raw_score=10 exact=1 [eval:sc] raw=3/10 exact=1 extractable=2/3 median_re=None [eval:baseline] raw=1/10 exact=1 extractable=2/3 median_re=1 CFG {\"a\": {\"b\": 1}} x"
    df = spark.createDataFrame([(log,)], "text string")
    assert reports.training_losses(df).collect() == [(1, 0.5, 0.75)]
    assert reports.epoch_scores(df).first()["checkpoint"] == "checkpoint-7"
    assert [(r["label"], r["median_rel_error"]) for r in reports.decoding_scores(df).collect()] == [("sc", None)]
    assert df.select(reports.json_after(F.col("text"), "CFG")).first()[0] == '{"a": {"b": 1}}'


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1", "query_vi": "a"},\n {"id": "2", "query_vi": "ê"}]', "utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": "1", "query_vi": "a"}\n\n{"id": "2", "query_vi": "ê"}\n', "utf-8")
    a, b = (records.load_records(spark, str(tmp_path / f)).orderBy("row_idx").select("row_idx", "id", "query_vi").collect() for f in ("a.json", "b.jsonl"))
    assert a == b == [(0, "1", "a"), (1, "2", "ê")]
    with pytest.raises(ValueError, match="leaked"):
        records.validate_predictions(spark.createDataFrame([("1", "q", "t", "o", 1)], "id string, query_vi string, type string, model_output string, score int"))
    rows = spark.createDataFrame([("h1", 1), ("h2", 2)], "source_hash string, v int")
    out = str(tmp_path / "out")
    records.append_new(rows.limit(1), out)
    records.append_new(rows, out)
    assert spark.read.json(out).count() == 2


def test_streamed_scores_equal_batch(spark, tmp_path):
    from abacora.streaming.scoring import scored_stream

    spark.createDataFrame([("####đáp án là: 4", "Đáp án là: 4")], "model_output string, response_vi string").write.parquet(str(tmp_path / "in"))
    s = scored_stream(spark.readStream.schema("model_output string, response_vi string").parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["score"] for r in spark.sql("SELECT score FROM scored").collect()] == [10]


def test_samples(spark):
    df = spark.createDataFrame([(i, "GSM_A" if i < 90 else "MATH_B") for i in range(100)], "k int, t string")
    assert {r["t"]: r["count"] for r in select.sample_by_type(df, 20, "t", "k").groupBy("t").count().collect()} == {"GSM_A": 10, "MATH_B": 10}
    assert select.sample_by_type(df, 20, "t", "k", weights={"MATH": 0.5}).filter("t = 'MATH_B'").count() >= 10


@pytest.mark.parametrize(
    ("given", "wanted"),
    [('x ```json\n{"a": 1}\n``` y {"b": 2}', {"a": 1}), ('{"a": {"b": "}"}}', {"a": {"b": "}"}}), ("Say {no} then {'k': (1, 2)} end", {"k": (1, 2)}), ('bad {"a": } good {"c": [1]}', {"c": [1]}), ('{x {"d": 4}}', {"d": 4}), ("[1, 2]", None), (None, None), ("{" * 50, None)],
)
def test_objects_of_replies(given, wanted):
    assert reports.parse_object(given) == wanted


def test_json_arrays_and_tails(spark, tmp_path):
    import json

    from abacora.functions import answers
    from abacora.sources import records

    df = spark.createDataFrame([(2, "b\n", None), (1, 'a"', 1.5)], "row_idx int, t string, x double")
    records.save_json(df, str(tmp_path / "out"))
    read = lambda p: json.loads("".join(f.read_text() for f in sorted(p.glob("part-*"))))
    assert read(tmp_path / "out") == [{"row_idx": 1, "t": 'a"', "x": 1.5}, {"row_idx": 2, "t": "b\n", "x": None}]
    records.save_json(df.limit(0), str(tmp_path / "none"))
    assert read(tmp_path / "none") == []
    tails = [r[0] for r in spark.createDataFrame([("a. Đáp án là: 3. Đáp án là: 4 kg",), ("x",), (None,)], "t string").select(answers.final_answer_tail(F.col("t"))).collect()]
    assert tails == ["Đáp án là: 4 kg", None, None]
    assert [r[0] for r in df.select(reports.json_object(F.lit("so {'a': 1}"))).collect()] == ['{"a": 1}'] * 2


def test_missing_predictions_raise(spark):
    pred, gold = spark.createDataFrame([(1, 0, 2.0)], "id int, row_idx int, pred double"), spark.createDataFrame([(1, 1.0), (2, 1.0)], "id int, gold double")
    with pytest.raises(align.MissingPredictions, match="1 ids"):
        align.align_by_id(pred, gold, ["pred"], ["gold"])
    assert align.align_by_id(pred, gold, ["pred"], ["gold"], check=False).count() == 1


def test_lookups_by_position(spark):
    rows = spark.createDataFrame([("1",), ("7",), ("x",), (None,)], "id string")
    pred = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, pred string")
    assert {r["id"]: r["pred"] for r in align.lookup_by_position(rows, pred).collect()} == {"1": "b", "7": None, "x": None, None: None}
    gold = spark.createDataFrame([(1, "g"), (0, "h")], "row_idx long, gold string")
    assert [tuple(r) for r in align.in_original_order(align.with_examples(gold.select("row_idx"), pred, gold)).collect()] == [(0, "a", "h"), (1, "b", "g")]


def test_target_decisions(spark):
    rows = [("####đáp án là: 3", "####đáp án là: 3", "k"), ("####đáp án là: 3", "s1 = 3\n####đáp án là: 3", "k"), ("####đáp án là: 3", "a", "k"), ("####đáp án là: 3", "b\n####đáp án là: 3", "k"), ("####đáp án là: x y", "####đáp án là: 3", None), (None, None, None), ("####đáp án là: 3", "", "k")]
    df = spark.createDataFrame(rows, "response_vi string, target string, kind string")
    got = curate.target_decisions(df, kind=F.col("kind"))
    assert [(r["decision"], r["target_kind"]) for r in got.collect()] == [("kept", "k"), ("kept", "fdd_lite_pot"), ("anchor_error", None), ("kept", "k"), ("skipped", None), ("skipped", None), ("skipped", None)]
    r = curate.target_report(got).first()
    assert (r["input_records"], r["kept_records"], r["skipped_records"], r["anchor_errors"]) == (7, 3, 4, 1)
    assert curate.target_report(got.limit(0)).first()["input_records"] == 0
