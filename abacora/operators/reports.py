"""Run leaderboards, best checkpoints and log parsers (AGG8-9, AGG20, SRT1-2, SRT8-9, PRS1-6, SNK12)."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .score import summary
from .taxonomy import diagnostic_class

RANK = ("score_10", "bucket_10_rate", "extractable_rate", "numeric_pair_rate")


def summarize_runs(rows: DataFrame, run: str = "run") -> DataFrame:
    """AGG8: metrics and diagnostic classes of every run."""
    c = rows.withColumn("class", diagnostic_class())
    classes = [F.count_if(F.col("class") == k).alias(f"{k}_count") for k in ("good", "partial", "extraction_failure", "parse_failure", "wrong_answer")]
    out = c.groupBy(F.col(run).alias("name")).agg(
        F.count("*").alias("n"), F.sum("score").alias("raw_score"), F.avg("score").alias("score_10"), F.avg((F.col("score") == 10).cast("double")).alias("bucket_10_rate"),
        F.avg(F.col("extractable").cast("double")).alias("extractable_rate"), F.avg((F.col("gold_num").isNotNull() & F.col("pred_num").isNotNull()).cast("double")).alias("numeric_pair_rate"), *classes,
    )
    return out.withColumn("score_pct", F.col("score_10") / 10)


def leaderboard(runs: DataFrame) -> DataFrame:
    """AGG9: runs with their rank, ties by name, and whether a run is the best of its size. One row per run, so a single sorted window is short."""
    order = [F.desc(c) for c in RANK] + [F.col("name")]
    return runs.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("best_of_n", F.row_number().over(Window.partitionBy("n").orderBy(*order)) == 1)


def best_checkpoint(rows: DataFrame, keys: tuple[str, ...] = ("raw_score", "exact_count", "extractable_count"), order: str = "idx", most: int = 1) -> DataFrame:
    """SRT1 and SRT2: the best by the keys, the first of equals."""
    return rows.orderBy(*[F.desc(k) for k in keys], order).limit(most)


def normalised_summary(rows: DataFrame) -> DataFrame:
    """AGG20."""
    return summary(rows).select("n", "raw_score", "max_raw_score", "score_10", "score_pct", "exact_count", F.col("extractable").alias("extractable_count"), F.col("numeric_pairs").alias("numeric_pair_count"))


def best_and_worst(by: DataFrame, name: str, score: str) -> DataFrame:
    return by.agg(F.max_by(name, score).alias("best"), F.min_by(name, score).alias("worst"))


def markdown(board: DataFrame, columns: list[str], most: int = 100) -> str:
    """SNK12: a ranked table as text, of `most` runs."""
    rows = board.orderBy("rank").select(*columns).limit(most).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    show = lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)
    return "\n".join([line(columns), line(["---"] * len(columns)), *[line([show(x) for x in r]) for r in rows]])


def _groups(text: Column, pattern: str, names: list[str]) -> Column:
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    return F.posexplode(zipped).alias("pos", "m")


def training_losses(logs: DataFrame, text: str = "text") -> DataFrame:
    """PRS1: rows of HTML loss tables."""
    pattern = r"<tr>\s*<td>([0-9]+)</td>\s*<td>([0-9.]+)</td>\s*<td>([0-9.]+)</td>\s*</tr>"
    out = logs.select(_groups(F.col(text), pattern, ["a", "b", "c"]))
    return out.select(F.col("m.a").try_cast("int").alias("epoch"), F.col("m.b").try_cast("double").alias("training_loss"), F.col("m.c").try_cast("double").alias("validation_loss"))


def epoch_scores(logs: DataFrame, text: str = "text") -> DataFrame:
    """PRS2."""
    pattern = r"Epoch\s+([0-9]+):\s+(checkpoint-[0-9]+)\s+raw_score=([0-9]+)\s+exact=([0-9]+)"
    out = logs.select(_groups(F.col(text), pattern, ["a", "b", "c", "d"]))
    return out.select(F.col("m.a").cast("int").alias("epoch"), F.col("m.b").alias("checkpoint"), F.col("m.c").cast("int").alias("raw_score"), F.col("m.d").cast("int").alias("exact_count"))


def decoding_scores(logs: DataFrame, text: str = "text") -> DataFrame:
    """PRS3: decoding sweeps; epochs, the baseline and the final validation are left out."""
    pattern = r"\[eval:([^\]]+)\]\s+raw=([0-9]+)/([0-9]+)\s+exact=([0-9]+)\s+extractable=([0-9]+)/([0-9]+)\s+median_re=([^\s]+)"
    m = logs.select(_groups(F.col(text), pattern, list("abcdefg"))).select("m.*")
    m = m.filter(~F.startswith("a", F.lit("epoch")) & ~F.col("a").isin("baseline", "final_valid"))
    raw, most = F.col("b").cast("int"), F.col("c").cast("int")
    return m.select(F.col("a").alias("label"), raw.alias("raw_score"), most.alias("max_raw_score"), (raw / F.greatest(most, F.lit(1))).alias("score_pct"), F.col("d").cast("int").alias("exact_count"), F.col("e").cast("int").alias("extractable_count"), F.col("f").cast("int").alias("n"), F.col("g").try_cast("double").alias("median_rel_error"))


def _table(logs: DataFrame, text: str, start: str, end: str, head: str) -> DataFrame:
    """Cells of the three-column rows of a markdown table between two marks."""
    block = F.split_part(F.substring_index(F.concat(F.col(text), F.lit("")), "\x00", 1), F.lit(start), F.lit(2))
    lines = F.split(F.split_part(block, F.lit(end), F.lit(1)), "\n")
    each = logs.filter(F.contains(F.col(text), F.lit(start))).select(F.posexplode(lines).alias("pos", "line"))
    kept = each.filter(F.startswith("line", F.lit("|")) & ~F.contains("line", F.lit(head)) & ~F.contains("line", F.lit("---")))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\|+|\|+\s*$", ""), r"\|"), lambda c: F.trim(c))
    return kept.select(cells.alias("c")).filter(F.size("c") == 3).select(F.col("c")[0].alias("name"), F.col("c")[1].try_cast("double").cast("int").alias("count"), F.col("c")[2].try_cast("double").alias("mean_score"))


def failure_table(logs: DataFrame, text: str = "text") -> DataFrame:
    """PRS5."""
    return _table(logs, text, "### FAILURE MATRIX DAMAGE DISTRIBUTION", "### SUB-TRACK", "failures").select(F.col("name").alias("failure"), F.col("count").alias("occurrences"), "mean_score")


def type_table(logs: DataFrame, text: str = "text") -> DataFrame:
    """PRS6."""
    return _table(logs, text, "### SUB-TRACK TRACKING PERFORMANCE", "[EXTRACTION SIMULATOR]", "count").withColumnRenamed("name", "type")


def json_after(text: Column, marker: str) -> Column:
    """PRS4: the first JSON object after a marker, as a string; null if there is none."""
    rest = F.split_part(text, F.lit(marker), F.lit(2))
    return F.when(F.contains(text, F.lit(marker)), _first_object(rest))


def _first_object(text: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(t):
            at = (t or "").find("{")
            if at < 0:
                return None
            try:
                found, _ = decoder.raw_decode(t, at)
            except ValueError:
                return None
            return json.dumps(found, ensure_ascii=False) if isinstance(found, dict) else None

        return s.map(one)

    return run(text)


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)


def _balanced(text: str) -> Iterator[str]:
    """Every part between a brace and the one that closes it, outer ones first; braces in quoted strings don't count."""
    opened: list[int] = []
    found, quoted, skip = [], False, False
    for at, sign in enumerate(text):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = sign == "\\", sign != '"'
        elif sign == '"':
            quoted = bool(opened)
        elif sign == "{":
            opened.append(at)
        elif sign == "}" and opened:
            found.append((opened.pop(), at + 1))
    return (text[a:b] for a, b in sorted(found))


def parse_object(text: str | None) -> dict | None:
    """ANS14: the object of a reply: that of a fenced block, of the whole text, or of the first balanced braces that hold one, as JSON or as a Python literal."""
    body = (text or "").strip()
    for part in [*(m[1].strip() for m in _FENCE.finditer(body)), body, *_balanced(body)]:
        if not part.startswith("{"):
            continue
        for read in (json.loads, ast.literal_eval):
            try:
                found = read(part)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                continue
            if isinstance(found, dict):
                return found
    return None


@F.pandas_udf(T.StringType())
def _object(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if (found := parse_object(t)) is None else json.dumps(found, ensure_ascii=False, default=str))


def json_object(text: Column) -> Column:
    """ANS14 as a JSON string; null if a text has no object."""
    return _object(text)
