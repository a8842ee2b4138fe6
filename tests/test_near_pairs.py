"""All near-duplicate pairs against brute force."""

import random
import re

from abacora.plans import corpus_queries


def test_near_dup_pairs_equal_brute_force(spark, tmp_path):
    rng = random.Random(5)
    vocabulary, texts = [f"w{i}" for i in range(60)], []
    for _ in range(12):
        base = rng.sample(vocabulary, rng.randint(10, 40))
        texts += [" ".join(base)] * 2
        for _ in range(6):  # more near copies than the former cap of 4
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rng.shuffle(copy)
            texts.append(" ".join(copy).upper())
    texts += ["", None, "w1 only", "w1 else", "a b c d e f g h i", "a b c d e f g h i j"]
    rows = list(enumerate(texts)) + [(None, texts[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set(re.findall(r"\w+", (t or "").lower())) for t in texts]
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 9 * len(sets[i] | sets[j])}
    got = corpus_queries.near_dup_pairs_jaccard(spark, str(tmp_path)).collect()
    assert len(got) == len(wanted) and {(r["query_id"], r["record_id"]) for r in got} == wanted
    assert all(abs(r["score"] - len(sets[r["query_id"]] & sets[r["record_id"]]) / len(sets[r["query_id"]] | sets[r["record_id"]])) < 1e-6 for r in got)
    assert len(texts) - 1 in {j for _, j in wanted}  # 9 of 10: the border is in


def test_simhash_bands_read_documents(spark, tmp_path):
    texts = ["two apples and 3 pears", "two apples and 3 pears", "something else 7", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["band"]): (r["sig"], r["value"]) for r in corpus_queries.simhash_bands(spark, str(tmp_path)).collect()}
    assert len(got) == 4 * len(texts) and all(got[0, b] == got[1, b] for b in range(4)) and got[0, 0][0] != got[2, 0][0]
    assert all(value == sig >> 16 * band & 0xFFFF for (_, band), (sig, value) in got.items())


def test_tokens_are_read_without_a_clean_up_of_white_space(spark):
    from pyspark.sql import functions as F

    from abacora.functions import text as X
    from abacora.operators import select

    df = spark.createDataFrame([("  Hai\r\n\r\n\r\n\r\nBA \t  x_1  ",), ("ΟΔΟΣ 　",), ("",), (None,)], "t string")
    old = F.array_distinct(F.regexp_extract_all(F.lower(X.normalize_space(F.col("t"))), F.lit(r"(?U)\w+"), F.lit(0)))
    rows = df.select(select.retrieval_tokens(F.col("t")).alias("a"), old.alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]
    plan = df.select(select.retrieval_tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_trigrams_of_a_document_are_counted_once(spark, tmp_path):
    spark.createDataFrame([(0, "a b c " * 20), (1, "x y"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = corpus_queries.repetition_docs(spark, str(tmp_path))
    assert {tuple(r) for r in df.collect()} == {(0, 20, True, True), (1, 0, False, False), (2, 0, False, False)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("concat_ws") == 1
