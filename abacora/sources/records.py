"""Reading and writing of records, predictions and runs (SRC1-8, SNK1-9)."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions import text as X
from ..operators.align import with_row_idx

PROBLEMS = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "type", "query_vi", "response_vi", "response_en", "model_output")])
LEAKS = ("response_vi", "response_en", "gold_answer", "gold_num", "pred_answer", "pred_num", "score", "rel_error", "extractable", "target", "_target", "solution_lines", "target_direct", "target_answer_only", "answer", "solution", "label", "labels")


def first_existing(*paths: str) -> str:
    """SRC8."""
    for p in paths:
        if Path(p).exists():
            return p
    raise FileNotFoundError(f"none of these exists: {', '.join(paths)}")


def _is_array(spark: SparkSession, path: str) -> bool:
    head = spark.read.text(path, wholetext=False).filter(F.trim("value") != "").limit(1).collect()
    return bool(head) and head[0]["value"].lstrip().startswith("[")


def load_records(spark: SparkSession, path: str, schema: T.StructType = PROBLEMS, mode: str = "PERMISSIVE", normal_form: bool = True) -> DataFrame:
    """SRC1-3: a JSON array or JSON lines, told apart by the first sign, with row_idx in file order and NFC texts.

    mode FAILFAST raises on malformed records, DROPMALFORMED drops them.
    """
    reader = spark.read.schema(schema).option("mode", mode)
    df = reader.json(path, multiLine=True) if _is_array(spark, path) else reader.json(path)
    df = df.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    out = with_row_idx(df, "_file", "_at").drop("_file", "_at")
    if normal_form:
        out = out.select(*[X.nfc(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in out.schema.fields])
    return out


def existing_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SRC4: distinct source_hash values of an output, broken lines skipped."""
    return spark.read.schema("source_hash string").option("mode", "DROPMALFORMED").json(path).filter("source_hash is not null").distinct()


def scan_runs(spark: SparkSession, root: str, schema: str = "summary struct<n: long, raw_score: long, score_10: double, score_pct: double, extractable: long, numeric_pairs: long, exact_count: long>") -> DataFrame:
    """SRC5: valid_report.json of every child folder, with the folder's name."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.schema(schema).json(f"{root}/*/valid_report.json", multiLine=True).select(name.alias("name"), "summary.*")


def notebook_text(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: all output texts of a notebook in order, one row."""
    out = "outputs array<struct<text: array<string>, data: struct<`text/html`: array<string>, `text/plain`: array<string>>>>"
    cells = spark.read.schema(f"cells array<struct<{out.replace(' array', ': array', 1)}>>").json(path, multiLine=True)
    each = cells.select(F.posexplode("cells").alias("i", "c")).select("i", F.posexplode("c.outputs").alias("j", "o"))
    joined = lambda c: F.when(c.isNotNull(), F.array_join(c, ""))
    parts = F.concat_ws("\n", joined(F.col("o.text")), joined(F.col("o.data.`text/html`")), joined(F.col("o.data.`text/plain`")))
    rows = each.select("i", "j", parts.alias("t"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("i", "j", "t"))).alias("x")).select(F.array_join(F.transform("x", lambda s: s["t"]), "\n").alias("text"))  # one notebook


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).csv(path, header=True)


def append_new(df: DataFrame, path: str, key: str = "source_hash") -> None:
    """SNK7: appends the rows whose key the output does not hold yet."""
    spark = df.sparkSession
    try:
        done = existing_hashes(spark, path) if key == "source_hash" else spark.read.json(path).select(key)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        write_jsonl(df, path)
        return
    write_jsonl(df.join(done, key, "left_anti"), path, "append")


def clean_predictions(df: DataFrame) -> DataFrame:
    """SNK4 and SNK5: the four permitted fields, the id by position where it is missing, outputs cut to their answers."""
    return df.select(F.coalesce(F.col("id").cast("string"), F.col("row_idx").cast("string")).alias("id"), "query_vi", "type", X.clean_model_output(F.coalesce("model_output", F.lit(""))).alias("model_output"))


def validate_predictions(df: DataFrame) -> DataFrame:
    """SNK6: raises on missing or leaked fields or other than string outputs; null outputs fail when read."""
    missing, leaked = [c for c in P.REQUIRED_FIELDS if c not in df.columns], sorted(set(df.columns) & set(LEAKS))
    if missing or leaked:
        raise ValueError(f"missing fields {missing}, leaked fields {leaked}")
    if dict(df.dtypes)["model_output"] != "string":
        raise ValueError("model_output must be a string")
    return df.withColumn("model_output", F.when(F.col("model_output").isNull(), F.raise_error(F.lit("model_output must be a string"))).otherwise(F.col("model_output")))


def file_hashes(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """SNK9: path and SHA-256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes:
        files = files.filter(F.col("path").rlike(f"(?:{'|'.join('\\' + s if s.startswith('.') else s for s in suffixes)})$"))
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def folder_hash(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ()) -> str:
    """SNK9: one hash over sorted relative paths and file hashes; the list of files is folded on the driver."""
    import hashlib

    rows = sorted((r["path"].split(path.rstrip("/") + "/", 1)[-1], r["sha256"]) for r in file_hashes(spark, path, suffixes).collect())
    total = hashlib.sha256()
    for name, digest in rows:
        total.update(name.encode() + b"\0" + digest.encode() + b"\0")
    return total.hexdigest()


def merge_report(old: dict, new: dict) -> dict:
    """SNK8: sections of new over old; config and paths only fill what is missing."""
    out = dict(old)
    for k, v in new.items():
        out[k] = {**v, **out.get(k, {})} if k in ("config", "paths") and isinstance(v, dict) else v
    return out


def save_json(df: DataFrame, path: str) -> None:
    """SNK1: the rows as one JSON array, in order of row_idx if there is one. The array is a single file by its format, so it is for reports and predictions, written by one task; the rows are not collected."""
    rows = df.orderBy("row_idx") if "row_idx" in df.columns else df
    one = rows.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).coalesce(1)

    def framed(frames):
        first = True
        for frame in frames:
            if len(frame):
                lines = frame["value"].tolist()
                yield pd.DataFrame({"value": [("[" if first and k == 0 else ",") + x for k, x in enumerate(lines)]})
                first = False
        yield pd.DataFrame({"value": ["]"]})

    made = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1) if df.isEmpty() else one.mapInPandas(framed, "value string")
    made.write.mode("overwrite").text(path)
