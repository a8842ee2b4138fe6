"""JSON arrays read in pieces, appends that count once, carried values over blocks."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abacora.operators import align, scratch, vote
from abacora.sources import json_array
from abacora.sources.append_log import AppendLog

_C = T.StructType([T.StructField("c", T.StringType())])
_DEEP = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(_C))])
SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("deep", _DEEP)])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def hard_records(n=400):
    rng = random.Random(1)
    signs = ["{", "}", "[", "]", '"', "\\", ",", "é", "\n", "a", "😀", '\\"', "}}", '{"id": 5}']
    return [{"id": i, "text": "".join(rng.choices(signs, k=rng.randint(0, 12))), "deep": {"a": i, "b": [{"c": "}" * (i % 3)}]}} for i in range(n)]


@pytest.mark.parametrize("style", [{}, {"indent": 2}, {"ensure_ascii": False, "separators": (",", ":")}])
def test_arrays_are_read_by_many_tasks_in_order(spark, tmp_path, small_splits, style):
    records = hard_records()
    path = tmp_path / "a.json"
    path.write_text(json.dumps(records, **style), encoding="utf-8")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 4
    got = [r.asDict(True) for r in json_array.read_array(spark, str(path), SCHEMA).orderBy("row_idx").collect()]
    assert [r.pop("row_idx") for r in got] == list(range(len(records))) and got == records


def test_broken_records_by_mode_empty_arrays_and_several_files(spark, tmp_path, small_splits):
    (tmp_path / "a.json").write_text('[{"id": 1, "text": "x"}, {"id": oops}, {"id": 3}]')
    (tmp_path / "b.json").write_text("[ ]")
    (tmp_path / "c.json").write_text('[{"id": 4}, {"id": 5, "text": "cut')
    (tmp_path / "d.json").write_text('[{"id": 6}')
    read = lambda mode: sorted(((r["row_idx"], r["id"]) for r in json_array.read_array(spark, str(tmp_path), SCHEMA, mode).collect()))
    assert read("PERMISSIVE") == [(0, 1), (1, None), (2, 3), (3, 4), (4, None), (5, 6)]
    assert read("DROPMALFORMED") == [(0, 1), (2, 3), (3, 4), (5, 6)]
    with pytest.raises(PySparkException, match="malformed record 1"):
        read("FAILFAST")


ROWS = "source_hash string, n int"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(3)


def held(log):
    return sorted(((r["source_hash"], r["n"]) for r in log.read().collect()), key=str)


def test_batches_count_once_and_keys_stay_distinct(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/out")
    first = [(f"k{i}", i) for i in range(200)] + [("k1", -5), (None, 1), (None, 1)]
    assert log.append(table(spark, first), "b0") == 202
    assert log.append(table(spark, first), "b0") == 0
    assert log.append(table(spark, [("k3", 9), ("new", 1), (None, 1)]), "b1") == 2
    rows = held(log)
    assert len(rows) == 204 and rows.count((None, 1)) == 3 and ("k1", -5) in rows and ("k1", 1) not in rows and ("k3", 3) in rows
    assert {r["source_hash"] for r in log.keys().collect()} == {f"k{i}" for i in range(200)} | {"new"}
    assert [c["batch"] for c in log.commits()] == ["b0", "b1"]


def test_killed_before_the_commit_and_run_again(spark, tmp_path, monkeypatch):
    log = AppendLog(spark, f"file://{tmp_path}/out")
    log.append(table(spark, [("a", 1)]), "b0")
    monkeypatch.setattr(AppendLog, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        log.append(table(spark, [("a", 1), ("b", 2)]), "b1")
    assert held(log) == [("a", 1)]
    monkeypatch.undo()
    assert log.append(table(spark, [("a", 1), ("b", 2)]), "b1") == 1
    assert held(log) == [("a", 1), ("b", 2)]


def test_a_second_writer_between_write_and_commit(spark, tmp_path, monkeypatch):
    log, other = AppendLog(spark, f"file://{tmp_path}/out"), AppendLog(spark, f"file://{tmp_path}/out")
    log.append(table(spark, [("a", 1)]), "b0")
    write, met = AppendLog._write, []

    def slow(self, rows, name):
        out = write(self, rows, name)
        if self is log and not met:
            met.append(other.append(table(spark, [("b", 7), ("c", 7)]), "other"))
        return out

    monkeypatch.setattr(AppendLog, "_write", slow)
    assert log.append(table(spark, [("a", 2), ("b", 2), ("d", 2), (None, 2)]), "b1") == 2
    assert met == [2] and held(log) == sorted([("a", 1), ("b", 7), ("c", 7), ("d", 2), (None, 2)], key=str)
    assert log._commit(1, "late", "x", 0, 1) is False


def test_filters_hold_every_key_and_spare_old_batches(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/out")
    for b in range(3):
        log.append(table(spark, [(f"{b}-{i}", i) for i in range(3000)]), f"b{b}")
    done = log.commits()
    keys = table(spark, [(f"1-{i}", 0) for i in range(3000)])
    probable = log.may_hold(keys, done)
    by_name = {r["name"]: r["n"] for r in probable.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert by_name[done[1]["name"]] == 3000
    assert sum(n for name, n in by_name.items() if name != done[1]["name"]) < 0.06 * 6000
    strange = table(spark, [("zzz", 0)])
    assert log.held(strange, done).count() == 0 and log.held(keys.limit(0), done).count() == 0
    asked = table(spark, [("0-5", 0), ("2-7", 0), ("zzz", 0), (None, 0)])
    assert {r["source_hash"] for r in log.held(asked, done).collect()} == {"0-5", "2-7"}
    resumed = align.resume(asked.filter("source_hash is not null"), log.read()).select("source_hash").collect()
    assert {r["source_hash"] for r in resumed} == {"zzz"}


def test_stream_keeps_rows_without_a_key(spark, tmp_path):
    from abacora.streaming.scoring import append_stream

    given = f"{tmp_path}/in"
    table(spark, [("a", 1), (None, 2), (None, 3)]).write.parquet(given)
    run = lambda: append_stream(spark.readStream.schema(ROWS).parquet(given), f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    table(spark, [("a", 4), ("b", 5), (None, 6)]).write.mode("append").parquet(given)
    run()
    assert held(AppendLog(spark, f"file://{tmp_path}/out")) == sorted([("a", 1), ("b", 5), (None, 2), (None, 3), (None, 6)], key=str)


def test_last_before_over_a_hot_key(spark):
    rng = random.Random(2)
    rows = [(rng.choice([7] * 6 + [1, 2, None]), i, rng.choice([None, None, float(i)])) for i in range(900)]
    rng.shuffle(rows)
    want, last = set(), {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        want.add((k, t, v, last.get(k)))
        if v is not None:
            last[k] = v
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "k int, t int, v double").repartition(5)
        got = vote.last_before(df, "k", ["t"], "v", "seen")
        assert {tuple(r) for r in got.collect()} == want and got.columns == ["k", "t", "v", "seen"]
        assert vote.last_before(df.limit(0), "k", ["t"], "v", "seen").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_scratch_is_deleted(spark):
    import os

    kept = scratch.stored(spark.range(5), "kept")
    gone = scratch.stored(spark.range(5), "gone")
    scratch.discard(gone, None)
    local = lambda p: p.removeprefix("file://")
    assert os.path.exists(local(kept.scratch)) and not os.path.exists(local(gone.scratch))
    assert kept.count() == 5
