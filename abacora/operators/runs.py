"""Run folders and their diagnostics (SRC5, AGG8): reports, optional files, classes of rows, failures by type, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .curate import repetitive
from .dedup import top_per_group

#: Files of a run folder; only the first must be there.
MEMBERS = ("valid_report", "valid_output", "experiment_report", "run_config", "run_status")
#: Classes of a report's rows, in the order of their lists.
CLASSES = ("good", "partial", "non_extractable", "extractable_not_numeric", "extractable_wrong", "repetitive", "quoted_answer")
QUOTED = r"Đáp\s*án\s*là\s*:\s*[\"'“”‘’`]"
_ROW = "struct<id: string, type: string, score: double, rel_error: double, gold_answer: string, pred_answer: string, gold_num: double, pred_num: double, extractable: boolean>"
_SUMMARY = "struct<n: long, raw_score: long, total_score: long, max_raw_score: long, max_score: long, score_10: double, score_pct: double, extractable: long, numeric_pairs: long, buckets: map<string, long>>"
_OUTPUT = "array<struct<id: string, query_vi: string, type: string, model_output: string>>"
_RATES = ("tagged_answer_extractable_rate", "numeric_tagged_answer_rate", "exact_correct_rate", "mean_correctness_reward", "mean_format_reward", "no_signal_group_rate", "has_equation_in_think_rate", "repeated_think_rate", "answer_number_in_think_rate", "malformed_tag_rate")
_EXPERIMENT = f"struct<config: map<string, string>, training: struct<wall_time_minutes: double>, preflight_passed: boolean, preflight_reason: string, {', '.join(f'{r}: double' for r in _RATES)}>"


def scan_folders(spark: SparkSession, root: str) -> DataFrame:
    """SRC5: name, path and the text of each member (null if it is not there) of every child folder with a report. One listing, one split a file."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{{{','.join(MEMBERS)}}}.json").text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    base = F.replace(F.col("_metadata.file_path"), F.concat(F.element_at(parts, -2), F.lit("/"), F.element_at(parts, -1)), F.lit(""))
    each = files.select(F.element_at(parts, -2).alias("name"), F.regexp_replace(F.element_at(parts, -1), r"\.json\z", "").alias("member"), base.alias("base"), "value")
    # Children only: files of deeper folders have a longer base.
    children = each.filter(F.rtrim(F.regexp_replace("base", "^[a-z0-9]+:/*", "/"), F.lit("/")).endswith(root.rstrip("/").split("://")[-1].lstrip("/")))
    runs = children.groupBy("name").agg(F.concat(F.max("base"), F.max("name")).alias("path"), *[F.max(F.when(F.col("member") == m, F.col("value"))).alias(m) for m in MEMBERS])
    return runs.filter("valid_report is not null")


def run_metrics(folders: DataFrame) -> DataFrame:
    """name, path, status, config and metrics of every run. A run's own configuration fills only what its report doesn't say."""
    s = folders.withColumn("s", F.from_json("valid_report", f"summary {_SUMMARY}")["summary"]).withColumn("x", F.from_json(F.coalesce("experiment_report", F.lit("{}")), _EXPERIMENT))
    own = F.coalesce(F.from_json("run_config", "map<string, string>"), F.create_map().cast("map<string,string>"))
    told = F.coalesce(F.col("x.config"), F.create_map().cast("map<string,string>"))
    config = F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(told, k)), told)
    n = F.coalesce("s.n", F.lit(0))
    bucket = lambda b: F.coalesce(F.col("s.buckets")[b], F.lit(0))
    rate = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    first = lambda *c: F.coalesce(*[F.nullif(F.col(f"s.{x}"), F.lit(0)) for x in c], F.lit(0))
    return s.select(
        "name", "path", F.from_json("run_status", "map<string, string>").alias("status"), config.alias("config"), n.alias("n"), F.coalesce("s.score_10", F.lit(0.0)).alias("score_10"), F.coalesce("s.score_pct", F.lit(0.0)).alias("score_pct"),
        first("raw_score", "total_score").alias("raw_score"), first("max_raw_score", "max_score").alias("max_raw_score"), *[bucket(b).alias(f"bucket_{b}_count") for b in ("10", "5", "1", "0")], (bucket("5") + bucket("1")).alias("partial_count"),
        rate(bucket("10")).alias("bucket_10_rate"), rate(F.coalesce("s.extractable", F.lit(0))).alias("extractable_rate"), rate(F.coalesce("s.numeric_pairs", F.lit(0))).alias("numeric_pair_rate"),
        F.col("x.training.wall_time_minutes").alias("runtime_minutes"), "x.preflight_passed", "x.preflight_reason", *[F.col(f"x.{r}") for r in _RATES],
    )


def run_rows(folders: DataFrame) -> DataFrame:
    """name, row_idx and the rows of every report, with the output that the row's id finds by position."""
    report = folders.select("name", F.posexplode(F.from_json("valid_report", f"rows array<{_ROW}>")["rows"]).alias("row_idx", "r"))
    output = folders.select("name", F.posexplode(F.from_json("valid_output", _OUTPUT)).alias("at", "o")).select("name", "at", "o.query_vi", "o.model_output")
    rows = report.select("name", "row_idx", "r.*").withColumn("at", F.col("id").try_cast("int"))
    return rows.join(output, ["name", "at"], "left").drop("at")


def classes(output: Column) -> Column:
    """The classes that a scored row is in: by its score, by what is wrong with it, and by its output's text."""
    numbers = F.col("gold_num").isNotNull() & F.col("pred_num").isNotNull()
    extractable, said = F.coalesce(F.col("extractable"), F.lit(False)), F.coalesce(output, F.lit(""))
    found = {
        "good": F.col("score") == 10, "partial": F.col("score").isin(1, 5), "non_extractable": ~extractable, "extractable_not_numeric": extractable & ~numbers,
        "extractable_wrong": extractable & numbers & (F.col("score") == 0), "repetitive": repetitive(said), "quoted_answer": said.rlike(QUOTED),
    }
    return F.filter(F.array(*[F.when(F.coalesce(found[c], F.lit(False)), F.lit(c)) for c in CLASSES]), lambda c: c.isNotNull())


def with_classes(rows: DataFrame, output: str = "model_output") -> DataFrame:
    return rows.withColumn("classes", classes(F.col(output)))


def class_counts(classed: DataFrame, run: str = "name") -> DataFrame:
    """AGG8: how many rows of each run are in each class."""
    return classed.groupBy(run).agg(F.count("*").alias("rows"), *[F.count_if(F.array_contains("classes", c)).alias(f"{c}_count") for c in CLASSES])


def failures_by_type(classed: DataFrame, run: str = "name") -> DataFrame:
    """AGG8: rows, zero scores, and rows without an answer or a number, by run and type."""
    has = lambda c: F.count_if(F.array_contains("classes", c))
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown"))
    return classed.groupBy(run, kind.alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("score") == 0).alias("score0"), has("non_extractable").alias("non_extractable"), has("extractable_not_numeric").alias("bad_parse"))


def class_examples(classed: DataFrame, run: str = "name", most: int = 5) -> DataFrame:
    """AGG8: the first rows of every class of every run, with their texts cut short."""
    # explode would make Catalyst copy the classes' definition into filters on their size and nullness, so they would be worked out three times.
    each = classed.withColumn("class", F.explode_outer("classes")).filter("class is not null")
    kept = top_per_group(each, [run, "class"], [F.col("row_idx")], most)
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n).alias(c)
    texts = [cut(c, n) for c, n in (("query_vi", 500), ("model_output", 900)) if c in classed.columns]
    return kept.select(run, "class", "row_idx", *[c for c in ("id", "type", "score", "rel_error", "gold_answer", "pred_answer") if c in classed.columns], *texts)
