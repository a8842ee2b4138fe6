"""Queries on scores, alignment, extraction and voting. Domain text is made from number columns inside each query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, numeric
from ..functions import text as X
from ..operators import align, reports, score, taxonomy, vote


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Few input splits dealt over all cores before costly expressions; with enough splits (any large table) df as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if 2 * df.rdd.getNumPartitions() <= n else df


def _scored(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_extendedprice").alias("gold_num"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("pred_num"), (F.col("l_linenumber") != 6).alias("extractable"))
    return score.with_score(t)


_SCORED = """
s AS (SELECT l_returnflag AS type, l_extendedprice AS gold_num, CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 - l_discount) END AS pred_num, l_linenumber <> 6 AS extractable FROM lineitem),
e AS (SELECT *, CASE WHEN pred_num IS NOT NULL THEN abs(pred_num - gold_num) / greatest(1.0, abs(gold_num)) END AS rel_error FROM s),
r AS (SELECT *, CASE WHEN NOT extractable OR rel_error IS NULL THEN 0 WHEN rel_error <= 0.01 THEN 10 WHEN rel_error <= 0.10 THEN 5 WHEN rel_error <= 0.50 THEN 1 ELSE 0 END AS score FROM e)"""
_SUMS = """count(*) AS n, CAST(sum(score) AS BIGINT) AS raw_score, count(*) FILTER (score = 10) AS exact_count, count(*) FILTER (extractable) AS extractable, count(*) FILTER (pred_num IS NOT NULL AND gold_num IS NOT NULL) AS numeric_pairs,
  count(*) FILTER (score = 10) AS bucket_10, count(*) FILTER (score = 5) AS bucket_5, count(*) FILTER (score = 1) AS bucket_1, count(*) FILTER (score = 0) AS bucket_0"""


def score_by_type(spark, sf_dir):
    out = score.score_by_type(_scored(spark, sf_dir))
    return _round(out, "mean_score", "score_pct", "extractable_rate", "numeric_pair_rate")


def _round(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def score_summary(spark, sf_dir):
    return _round(score.summary(_scored(spark, sf_dir)), "rel_error_mean", "score_10", "score_pct")


def rel_error_diagnostics(spark, sf_dir):
    d = score.diagnostics(_scored(spark, sf_dir)).withColumn("worst_error", F.round(F.col("worst_5_errors")[0], 6)).withColumn("worst_n", F.size("worst_5_errors")).drop("worst_5_errors")
    return _round(d, "mean_rel_error", "median_rel_error", "p90_rel_error", "p95_rel_error", "p99_rel_error", "capped_mean_rel_error")


def align_by_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    gold = o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("gold_num"))
    line = table(spark, sf_dir, "lineitem")
    pred = line.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_idx"), F.col("l_extendedprice").alias("pred_num"), F.col("l_linenumber").alias("line"))
    pred = pred.groupBy("id", "row_idx").agg(F.max("pred_num").alias("pred_num"), F.max("line").alias("line"))
    return align.align_by_id(pred, gold, ["pred_num", "line"], ["gold_num"], check=False)


def align_positional(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    gold = n.select(F.col("n_nationkey").alias("row_idx"), F.col("n_name").alias("gold"))
    pred = n.select((24 - F.col("n_nationkey")).alias("row_idx"), F.col("n_name").alias("pred"))
    return align.align_by_position(pred, gold)


def _answers(spark, sf_dir) -> DataFrame:
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey"))
    q = F.col("l_quantity").cast("int").cast("string")
    kind = F.pmod(F.col("l_partkey"), F.lit(6))
    tail = F.element_at(F.array(F.lit(" ô tô"), F.lit("kg"), F.lit("huehue"), F.lit(""), F.lit(".5 mét"), F.lit(",25 lít")), (F.pmod(F.col("l_suppkey"), F.lit(6)) + 1).cast("int"))
    text = (
        F.when(kind == 0, F.concat(F.lit("Ta có kết quả.\n####đáp án là: "), q, tail)).when(kind == 1, F.concat(F.lit("ĐÁP ÁN LÀ "), q, tail)).when(kind == 2, F.concat(F.lit("Vậy câu trả lời là: "), q, tail, F.lit(".\nxong")))
        .when(kind == 3, F.concat(F.lit("so "), q, F.lit(" then \\boxed{"), q, F.lit("}"))).when(kind == 4, F.concat(F.lit("the answer is: "), q, tail)).otherwise(F.concat(F.lit("a 3 b "), q, F.lit(" end")))
    )
    return t.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), text.alias("text"))


_ANSWERS = """
a AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS q, l_partkey % 6 AS kind,
        CASE l_suppkey % 6 WHEN 0 THEN ' ô tô' WHEN 1 THEN 'kg' WHEN 2 THEN 'huehue' WHEN 3 THEN '' WHEN 4 THEN '.5 mét' ELSE ',25 lít' END AS tail FROM lineitem),
t AS (SELECT *, CASE kind WHEN 0 THEN 'Ta có kết quả.' || chr(10) || '####đáp án là: ' || q || tail WHEN 1 THEN 'ĐÁP ÁN LÀ ' || q || tail WHEN 2 THEN 'Vậy câu trả lời là: ' || q || tail || '.' || chr(10) || 'xong'
        WHEN 3 THEN 'so ' || q || ' then \\boxed{' || q || '}' WHEN 4 THEN 'the answer is: ' || q || tail ELSE 'a 3 b ' || q || ' end' END AS text,
        regexp_extract(q || tail, '^-?[0-9]+(?:[.,][0-9]+)?') AS num FROM a)"""


def clean_output_numbers(spark, sf_dir):
    t = _answers(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", X.clean_model_output(F.col("text")).alias("cleaned"))


def extract_gold_anchors(spark, sf_dir):
    t = _answers(spark, sf_dir)
    return t.select("l_orderkey", "l_linenumber", answers.extract_gold(F.col("text")).alias("gold"))


def extract_pred_numbers(spark, sf_dir):
    t = _answers(spark, sf_dir)
    t = t.select("l_orderkey", "l_linenumber", answers.extract_pred(F.col("text")).alias("pred"), answers.answer_for_voting(F.col("text")).alias("vote"))
    return t.withColumn("pred_num", numeric.parse_number(F.col("pred")))


def parse_expressions(spark, sf_dir):
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"))
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    kind = F.pmod(F.col("l_partkey"), F.lit(7))
    s = (
        F.when(kind == 0, F.concat(F.lit("\\frac{"), q, F.lit("}{"), n, F.lit("}"))).when(kind == 1, F.concat(q, F.lit("\\sqrt{4}"))).when(kind == 2, F.concat(F.lit("x = "), q, F.lit("^2")))
        .when(kind == 3, F.concat(q, F.lit(","), n)).when(kind == 4, F.concat(F.lit("("), q, F.lit(","), n, F.lit(")"))).when(kind == 5, F.concat(F.lit("("), q, F.lit("+"), n, F.lit(")("), n, F.lit(")"))).otherwise(F.concat(q, F.lit(" apples")))
    )
    return t.select("l_orderkey", "l_linenumber", F.round(numeric.parse_number(s), 6).alias("value"))


def _candidates(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    v = F.pmod(F.col("l_partkey"), F.lit(3)).cast("string")
    text = F.when(F.pmod(F.col("l_suppkey"), F.lit(5)) == 0, F.lit("no idea")).otherwise(F.concat(F.repeat(F.lit("x"), F.pmod(F.col("l_suppkey"), F.lit(4)).cast("int")), F.lit("####đáp án là: "), v))
    return t.groupBy("l_orderkey", "l_linenumber").agg(F.max(text).alias("text")).select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("sample_idx"), "text")


def vote_majority(spark, sf_dir):
    return vote.vote_candidate_texts(_candidates(spark, sf_dir))


def vote_self_consistency(spark, sf_dir):
    return vote.self_consistency(_candidates(spark, sf_dir))


def vote_reason_hist(spark, sf_dir):
    return vote.reason_histogram(vote.vote_candidate_texts(_candidates(spark, sf_dir)))


_CANDIDATES = """
c AS (SELECT l_orderkey AS record_id, l_linenumber AS sample_idx, max(CASE WHEN l_suppkey % 5 = 0 THEN 'no idea' ELSE repeat('x', CAST(l_suppkey % 4 AS INT)) || '####đáp án là: ' || (l_partkey % 3) END) AS text FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN text <> 'no idea' THEN CAST(right(text, 1) AS DOUBLE) END AS number FROM c),
g AS (SELECT record_id, number, count(*) AS votes, min(sample_idx) AS met FROM p WHERE number IS NOT NULL GROUP BY 1, 2)"""
_VOTED = _CANDIDATES + """,
m AS (SELECT record_id, max(votes) AS best FROM g GROUP BY 1),
w AS (SELECT p.*, g.votes, row_number() OVER (PARTITION BY p.record_id ORDER BY length(text), sample_idx) AS rn FROM p JOIN g USING (record_id, number) JOIN m ON m.record_id = p.record_id AND m.best = g.votes),
n AS (SELECT record_id, arg_min(text, (length(text), sample_idx)) AS text FROM p GROUP BY 1),
v AS (SELECT n.record_id, coalesce(w.text, n.text) AS chosen, CASE WHEN w.text IS NOT NULL THEN right(w.text, 1) END AS answer, w.number AS vote_key, coalesce(w.votes, 0) AS vote_count,
        CASE WHEN w.text IS NULL THEN 'no_parseable_answer' WHEN w.votes > 1 THEN 'numeric_majority' ELSE 'single_parseable_answer' END AS reason
      FROM n LEFT JOIN w ON w.record_id = n.record_id AND w.rn = 1)"""


def _framed(spark, sf_dir) -> DataFrame:
    t = spread(table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag"))
    k = F.pmod(F.col("l_partkey"), F.lit(6))
    gold = F.col("l_quantity")
    rows = t.select(
        F.col("l_returnflag").alias("type"), gold.alias("gold_num"), F.when(k == 0, -gold).when(k == 1, gold * 100).when(k == 2, gold * 3).when(k == 3, None).otherwise(gold).alias("pred_num"), (k != 4).alias("extractable"),
        F.when(k == 5, F.repeat(F.lit("a b c "), 8)).when(k == 4, F.lit("too short")).otherwise(F.lit("five words are in this")).alias("model_output"),
    )
    return taxonomy.diagnostic_frame(score.with_score(rows), extended=False)


def failure_taxonomy(spark, sf_dir):
    return _round(taxonomy.failure_counts(_framed(spark, sf_dir)), "mean_score")


def failure_types(spark, sf_dir):
    return _round(taxonomy.type_performance(_framed(spark, sf_dir)), "mean_score")


def group_advantage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return vote.group_advantage(o, "o_custkey", "o_totalprice").select("o_orderkey", F.round("advantage", 6).alias("advantage"))


def last_before_event(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") != "click", F.col("value")).alias("value"), "ts")
    return vote.last_before(e, "user_id", ["ts", "event_id"], "value", "last_value").select("event_id", "last_value")


def _runs(spark, sf_dir) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    rows = score.with_score(t.select(F.concat(F.lit("run"), F.pmod(F.col("l_suppkey"), F.lit(10)).cast("string")).alias("run"), F.col("l_extendedprice").alias("gold_num"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice") * (1 - F.col("l_discount") - F.col("l_tax"))).alias("pred_num"), (F.col("l_linenumber") != 6).alias("extractable")))
    return reports.summarize_runs(rows)


def leaderboard(spark, sf_dir):
    b = reports.leaderboard(_runs(spark, sf_dir).withColumn("n", F.lit(1000)))
    return _round(b.select("name", "raw_score", "score_10", "bucket_10_rate", "extractable_rate", "numeric_pair_rate", "rank", "best_of_n"), "score_10", "bucket_10_rate", "extractable_rate", "numeric_pair_rate")


def best_run(spark, sf_dir):
    r = _runs(spark, sf_dir).select("name", "raw_score", F.col("good_count").alias("exact_count"), F.lit(0).alias("extractable_count"), F.col("name").alias("idx"))
    return reports.best_checkpoint(r, most=3).select("name", "raw_score", "exact_count")


def fallback_gain(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    rows = t.select(F.col("l_quantity").alias("gold_num"), (F.pmod(F.col("l_partkey"), F.lit(3)) * 5).alias("score"), F.concat(F.lit("so 7 and "), F.col("l_linenumber").cast("string"), F.lit(" left")).alias("model_output"))
    return score.fallback_gain(rows)


def rewards(spark, sf_dir):
    t = _scored(spark, sf_dir)
    return t.groupBy("type").agg(F.round(F.avg(score.reward_grpo(F.col("rel_error"), F.col("extractable"))), 6).alias("grpo"), F.round(F.avg(score.reward_weighted(F.col("rel_error"), F.col("extractable"))), 6).alias("weighted"))


QUERIES = {f.__name__: f for f in (score_by_type, score_summary, rel_error_diagnostics, align_by_id, align_positional, clean_output_numbers, extract_gold_anchors, extract_pred_numbers, parse_expressions, vote_majority, vote_self_consistency, vote_reason_hist, failure_taxonomy, failure_types, group_advantage, last_before_event, leaderboard, best_run, fallback_gain, rewards)}

_FRAMED = """
f AS (SELECT l_returnflag AS type, l_quantity AS gold, l_partkey % 6 AS k, CASE l_partkey % 6 WHEN 0 THEN -l_quantity WHEN 1 THEN l_quantity * 100 WHEN 2 THEN l_quantity * 3 WHEN 3 THEN NULL ELSE l_quantity END AS pred, l_partkey % 6 <> 4 AS ex FROM lineitem),
g AS (SELECT *, CASE WHEN pred IS NOT NULL THEN abs(pred - gold) / greatest(1.0, abs(gold)) END AS e FROM f),
s AS (SELECT *, CASE WHEN NOT ex OR e IS NULL THEN 0 WHEN e <= 0.01 THEN 10 WHEN e <= 0.1 THEN 5 WHEN e <= 0.5 THEN 1 ELSE 0 END AS score FROM g),
x AS (SELECT *, CASE k WHEN 4 THEN ['extraction_failure', 'premature_eos'] WHEN 5 THEN ['repetition_loop'] WHEN 3 THEN ['formatting_drift'] WHEN 0 THEN ['operator_sign_mistake'] WHEN 1 THEN ['decimal_placement_error'] WHEN 2 THEN ['arithmetic_mistake'] END AS labels FROM s)"""
_RUNS = """
s AS (SELECT 'run' || (l_suppkey % 10) AS name, l_extendedprice AS gold, CASE WHEN l_linenumber <> 7 THEN l_extendedprice * (1 - l_discount - l_tax) END AS pred, l_linenumber <> 6 AS ex FROM lineitem),
e AS (SELECT *, CASE WHEN pred IS NOT NULL THEN abs(pred - gold) / greatest(1.0, abs(gold)) END AS err FROM s),
r AS (SELECT *, CASE WHEN NOT ex OR err IS NULL THEN 0 WHEN err <= 0.01 THEN 10 WHEN err <= 0.1 THEN 5 WHEN err <= 0.5 THEN 1 ELSE 0 END AS score FROM e),
b AS (SELECT name, CAST(sum(score) AS BIGINT) AS raw_score, avg(score) AS score_10, avg(CAST(score = 10 AS INT)) AS bucket_10_rate, avg(CAST(ex AS INT)) AS extractable_rate, avg(CAST(pred IS NOT NULL AS INT)) AS numeric_pair_rate, count(*) FILTER (score = 10) AS exact_count FROM r GROUP BY 1)"""

ORACLES = {
    "score_by_type": f"WITH {_SCORED} SELECT type, {_SUMS}, round(sum(score) / count(*), 6) AS mean_score, round(sum(score) / (10.0 * count(*)), 6) AS score_pct, round(count(*) FILTER (extractable) / count(*), 6) AS extractable_rate, round(count(*) FILTER (pred_num IS NOT NULL) / count(*), 6) AS numeric_pair_rate FROM r GROUP BY type",
    "score_summary": f"WITH {_SCORED} SELECT {_SUMS}, round(avg(rel_error), 6) AS rel_error_mean, 10 * count(*) AS max_raw_score, round(sum(score) / count(*), 6) AS score_10, round(sum(score) / (10.0 * count(*)), 6) AS score_pct FROM r",
    "rel_error_diagnostics": f"""WITH {_SCORED}, d AS (SELECT rel_error AS x FROM r WHERE rel_error IS NOT NULL), c AS (SELECT 10 * quantile_cont(x, 0.5) AS cap FROM d)
        SELECT count(*) AS n_with_error, round(avg(x), 6) AS mean_rel_error, round(quantile_cont(x, 0.5), 6) AS median_rel_error, round(quantile_cont(x, 0.9), 6) AS p90_rel_error, round(quantile_cont(x, 0.95), 6) AS p95_rel_error, round(quantile_cont(x, 0.99), 6) AS p99_rel_error, round(avg(least(x, cap)), 6) AS capped_mean_rel_error, round(max(x), 6) AS worst_error, CAST(least(count(*), 5) AS INT) AS worst_n FROM d, c""",
    "align_by_id": """WITH p AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS pred_num FROM lineitem GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS rn FROM p)
        SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS gold_num, pred_num, l_linenumber AS line FROM orders JOIN b ON o_orderkey = l_orderkey AND rn = 1""",
    "align_positional": "SELECT a.n_nationkey AS row_idx, a.n_name AS gold, b.n_name AS pred FROM nation a JOIN nation b ON b.n_nationkey = 24 - a.n_nationkey",
    "clean_output_numbers": f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE WHEN kind = 0 THEN 'Ta có kết quả.' || chr(10) || '####đáp án là: ' || num ELSE text END AS cleaned FROM t",
    "extract_gold_anchors": f"WITH {_ANSWERS} SELECT l_orderkey, l_linenumber, CASE WHEN kind IN (0, 1, 2) THEN num WHEN kind = 3 THEN q END AS gold FROM t",
    "extract_pred_numbers": f"""WITH {_ANSWERS}, u AS (SELECT *, CASE WHEN kind IN (0, 1, 2, 4) THEN num WHEN kind IN (3, 5) THEN q END AS pred FROM t)
        SELECT l_orderkey, l_linenumber, pred, CAST(replace(pred, ',', '.') AS DOUBLE) AS pred_num, replace(pred, ',', '.') AS vote FROM u""",
    "parse_expressions": """WITH b AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS INT) AS DOUBLE) AS q, CAST(l_linenumber AS DOUBLE) AS n, l_partkey % 7 AS k FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(CASE k WHEN 0 THEN q / n WHEN 1 THEN q * 2 WHEN 2 THEN q * q WHEN 3 THEN q + n / 10 WHEN 5 THEN (q + n) * n END, 6) AS value FROM b""",
    "vote_majority": f"WITH {_VOTED} SELECT * FROM v",
    "vote_reason_hist": f"WITH {_VOTED} SELECT reason, count(*) AS n FROM v GROUP BY 1",
    "vote_self_consistency": f"""WITH {_CANDIDATES}, w AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY votes DESC, met) AS rn FROM g), k AS (SELECT p.record_id, arg_min(p.text, (length(p.text), p.sample_idx)) AS text FROM p JOIN w ON w.record_id = p.record_id AND w.number = p.number AND rn = 1 GROUP BY 1),
        n AS (SELECT record_id, arg_min(text, (length(text), sample_idx)) AS text FROM p GROUP BY 1) SELECT n.record_id, coalesce(k.text, n.text) AS chosen FROM n LEFT JOIN k USING (record_id)""",
    "failure_taxonomy": f"WITH {_FRAMED} SELECT unnest(labels) AS failure, count(*) AS occurrences, round(avg(score), 6) AS mean_score FROM x GROUP BY 1",
    "failure_types": f"WITH {_FRAMED} SELECT type, count(*) AS count, round(avg(score), 6) AS mean_score FROM x GROUP BY 1",
    "group_advantage": "SELECT o_orderkey, round(CASE WHEN stddev_pop(o_totalprice) OVER w <= 1e-8 THEN 0.0 ELSE (o_totalprice - avg(o_totalprice) OVER w) / (stddev_pop(o_totalprice) OVER w + 1e-8) END, 6) AS advantage FROM orders WINDOW w AS (PARTITION BY o_custkey)",
    "last_before_event": "SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_value FROM events",
    "leaderboard": f"WITH {_RUNS}, k AS (SELECT *, row_number() OVER (ORDER BY score_10 DESC, bucket_10_rate DESC, extractable_rate DESC, numeric_pair_rate DESC, name) AS rank FROM b) SELECT name, raw_score, round(score_10, 6) AS score_10, round(bucket_10_rate, 6) AS bucket_10_rate, round(extractable_rate, 6) AS extractable_rate, round(numeric_pair_rate, 6) AS numeric_pair_rate, CAST(rank AS INT) AS rank, rank = 1 AS best_of_n FROM k",
    "best_run": f"WITH {_RUNS} SELECT name, raw_score, exact_count FROM b ORDER BY raw_score DESC, exact_count DESC, name LIMIT 3",
    "fallback_gain": """WITH t AS (SELECT l_quantity AS g, CAST(l_linenumber AS DOUBLE) AS v, (l_partkey % 3) * 5 AS score FROM lineitem), e AS (SELECT abs(v - g) / greatest(1.0, abs(g)) AS e FROM t WHERE score = 0),
        p AS (SELECT CASE WHEN e <= 0.01 THEN 10 WHEN e <= 0.1 THEN 5 WHEN e <= 0.5 THEN 1 ELSE 0 END AS gain FROM e) SELECT count(*) AS zero_rows, count(*) FILTER (gain > 0) AS recovered_rows, CAST(sum(gain) AS BIGINT) AS recovered_points FROM p""",
    "rewards": f"""WITH {_SCORED} SELECT type, round(avg(CASE WHEN rel_error IS NULL THEN 0 WHEN rel_error <= 0.01 THEN 1.0 WHEN rel_error <= 0.1 THEN 0.25 WHEN rel_error <= 0.5 THEN 0.05 ELSE 0 END + CASE WHEN extractable THEN 0.05 ELSE 0 END), 6) AS grpo,
        round(avg(0.95 * CASE WHEN rel_error IS NULL THEN 0 WHEN rel_error <= 0.01 THEN 1.0 WHEN rel_error <= 0.1 THEN 0.5 WHEN rel_error <= 0.5 THEN 0.1 ELSE 0 END + 0.05 * CASE WHEN extractable THEN 1.0 ELSE -0.5 END), 6) AS weighted FROM r GROUP BY 1""",
}
