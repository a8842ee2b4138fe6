"""Dataset audit, exploration counts and rewriting counters (AGG5-7, AGG10-14, FLT20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, numeric
from ..functions import patterns as P
from ..functions import text as X
from . import order_stats
from .score import type_or_unknown

QUANTILES = (0, 25, 50, 75, 90, 95, 99, 100)
TOKEN_QUANTILES = (50, 75, 85, 90, 95, 98, 99, 99.5, 100)


def _joined(query: str, response: str) -> Column:
    return F.concat(F.coalesce(F.col(query), F.lit("")), F.lit("\n"), F.coalesce(F.col(response), F.lit("")))


def risks(text: Column) -> dict[str, Column]:
    """FLT20."""
    return {"compound_fraction": text.rlike(P.COMPOUND_FRACTION), "asy_block": text.rlike(P.ASY_BLOCK), "inequality_command": text.rlike(P.INEQUALITY), "math_function": text.rlike(P.MATH_FUNCTION)}


def audit_split(records: DataFrame, query: str = "query_vi", response: str = "response_vi") -> DataFrame:
    """AGG5: one row of counters and rates."""
    gold = answers.extract_answer(F.col(response))
    t = records.select(F.coalesce(F.col(query), F.lit("")).alias("q"), F.coalesce(F.col(response), F.lit("")).alias("r"), _joined(query, response).alias("t"), gold.alias("gold"), numeric.parse_number(gold).alias("num"))
    risk = risks(F.col("t"))
    out = t.agg(
        F.count("*").alias("records"), F.count_if(F.col("q") == "").alias("missing_query"), F.count_if(F.col("r") == "").alias("missing_response"), F.count("gold").alias("gold_extractable"), F.count("num").alias("gold_numeric"),
        F.count_if(F.col("t").rlike(P.LATEX_COMMAND)).alias("records_with_latex"), F.coalesce(F.sum(F.regexp_count("t", F.lit(P.FRACTION))), F.lit(0)).cast("long").alias("frac_total"),
        F.count_if(risk["compound_fraction"]).alias("compound_frac_records"), F.count_if(risk["asy_block"]).alias("asy_records"), F.count_if(risk["inequality_command"]).alias("inequality_records"), F.count_if(risk["math_function"]).alias("math_function_records"),
    )
    rate = lambda c, name: (F.col(c) / F.greatest("records", F.lit(1))).alias(name)
    return out.select("*", rate("gold_numeric", "gold_numeric_rate"), rate("records_with_latex", "records_with_latex_rate"), rate("compound_frac_records", "compound_frac_record_rate"), rate("asy_records", "asy_record_rate"), rate("inequality_records", "inequality_record_rate"))


def type_counts(records: DataFrame, type_: str = "type") -> DataFrame:
    return records.groupBy(type_or_unknown(type_).alias("type")).agg(F.count("*").alias("n"))


def top_matches(records: DataFrame, text: str, pattern: str, most: int = 30, group: int = 1) -> DataFrame:
    """SRT3: the commonest matches of a pattern; ties by the match."""
    each = records.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))).alias("match"))
    return each.groupBy("match").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "match").limit(most)


def risk_examples(records: DataFrame, most: int = 20, query: str = "query_vi", response: str = "response_vi") -> DataFrame:
    """WIN9: the first risky records with their text before and after both clean-ups."""
    t = _joined(query, response)
    risk = risks(t)
    body = F.substring(t, 1, 2500)
    cols = [risk[k].alias(k) for k in ("compound_fraction", "asy_block", "inequality_command")]
    risky = records.filter(risk["compound_fraction"] | risk["asy_block"] | risk["inequality_command"]).orderBy("row_idx").limit(most)
    return risky.select("row_idx", "type", *cols, F.substring(t, 1, 700).alias("raw_excerpt"), F.substring(X.legacy_latex_cleanup(body), 1, 700).alias("legacy_excerpt"), F.substring(X.clean_math_text(body), 1, 700).alias("fixed_excerpt"))


def quantile_names(qs: tuple = QUANTILES, prefix: str = "p") -> list[str]:
    return [f"{prefix}{str(q).replace('.', '_')}" for q in qs]


def with_quantiles(head: DataFrame, rows: DataFrame, value: Column, qs: tuple, by: tuple[str, ...] = (), prefix: str = "p") -> DataFrame:
    """head, a row per group, with the exact interpolated percentiles of its values; null where a group has none."""
    names = quantile_names(qs, prefix)
    at = order_stats.quantiles(order_stats.value_counts(rows, value, by), [q / 100 for q in qs], by, names)
    g = F.struct(*[F.col(b) for b in by]) if by else F.lit(0)
    found = at.select(g.alias("_g"), *names)
    return head.withColumn("_h", g).join(found, F.col("_h") == F.col("_g"), "left").select(*head.columns, *names)


def eda(records: DataFrame, by: list[str], text: str) -> DataFrame:
    """AGG6: rows, missing and repeated texts (by 128-bit digest, so no text is shuffled) and length percentiles by group."""
    length = F.when(F.coalesce(F.col(text), F.lit("")) != "", F.length(text))
    head = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(X.strip(F.coalesce(F.col(text), F.lit(""))) == "").alias("missing"), (F.count(text) - F.countDistinct(F.unhex(F.md5(text)))).alias("duplicates"))
    return with_quantiles(head, records, length, QUANTILES, tuple(by))


def token_lengths(records: DataFrame, tokens: Column) -> DataFrame:
    """AGG7."""
    head = records.agg(F.count("*").alias("n"), F.avg(tokens).alias("mean"), F.max(tokens).alias("longest"))
    return with_quantiles(head, records, tokens, TOKEN_QUANTILES)


def summarize(records: DataFrame, length: Column, flags: dict[str, Column]) -> DataFrame:
    """AGG10: rates of flags; mean, median and the 95th percentile as the element at int(.95 (n - 1)), not interpolated."""
    shares = [F.avg(c.cast("double")).alias(f"{k}_rate") for k, c in flags.items()]
    head = with_quantiles(records.agg(F.count("*").alias("n"), *shares, F.avg(length).alias("mean")), records, length, (50,)).withColumnRenamed("p50", "median")
    p95 = order_stats.at_ranks(order_stats.value_counts(records, length), F.array(F.floor(0.95 * (F.col("n") - 1)).cast("long"))).select(F.col("value").alias("p95"))
    return head.join(F.broadcast(p95), how="left")  # one row


def inspect(records: DataFrame, target: str, most: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """AGG11: type distribution with mean target length, and a sample ordered by a hash of the row."""
    dist = records.groupBy(type_or_unknown().alias("type")).agg(F.count("*").alias("n"), F.avg(F.length(target)).alias("mean_length")).orderBy(F.desc("n"), "type")
    return dist, records.orderBy(F.xxhash64(F.lit(seed), F.col("row_idx"))).limit(most)


def rewriting_counts(records: DataFrame, fields: list[str], rewrite) -> DataFrame:
    """AGG13: by field, how many values a rewriting changes."""
    each = records.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), rewrite(F.col(f)).alias("new")) for f in fields])).alias("x")).select("x.*")
    return each.groupBy("field").agg(F.count("old").alias("n"), F.count_if(F.col("old") != F.col("new")).alias("changed"))


def anchor_contexts(records: DataFrame, text: str, width: int = 30, most: int = 20) -> DataFrame:
    """AGG14: what stands before the last number, from the last break on, by frequency."""
    before = F.regexp_extract(F.col(text), rf"(?s)^(.*?)-?[0-9]+(?:[.,][0-9]+)?[^0-9]*\z", 1)
    tail = F.regexp_replace(F.lower(F.substring(before, -width, width)), r"(?s)^.*[\n.,]", "")
    t = records.filter(F.col(text).rlike("[0-9]")).select(X.strip(tail).alias("context"))
    total = t.agg(F.count("*").alias("total"))
    return t.groupBy("context").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("context", "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), "context").limit(most)
