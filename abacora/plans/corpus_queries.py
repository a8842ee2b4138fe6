"""Queries on text, duplicates, audits, selection, retrieval and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..functions import vietnamese as V
from ..operators import align, audit, curate, dedup, reports, select
from ..sources import records
from .scoring_queries import spread, table


def normalize_space_docs(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.md5(X.normalize_space(F.col("text"))).alias("space_md5"), F.md5(X.dedup_key(F.col("text"))).alias("key_md5"))


def canonicalize_docs(spark, sf_dir):
    c = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", X.canonicalize_query(F.col("text")).alias("c"))
    return c.select("doc_id", F.md5("c").alias("canonical_md5"), F.size(X.query_tokens(F.col("c"))).alias("tokens"), F.array_join(X.number_signature(F.col("c")), " ").alias("numbers"))


def feature_counts(spark, sf_dir):
    c = table(spark, sf_dir, "benchmark").select("item_id", X.query_tokens(X.canonicalize_query(F.col("text"))).alias("t"))
    return c.select("item_id", F.size("t").alias("tokens"), F.size(X.feature_set(F.col("t"))).alias("features"))


def exact_dedup_docs(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rank = F.struct(F.length("text").alias("n"), F.col("doc_id").alias("i"))
    return dedup.first_by_key(d, X.dedup_key(F.col("text")), rank).select("doc_id")


def _problems(spark, sf_dir) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kind = F.element_at(F.array(*[F.lit(t) for t in ("GSM_AnsAug", "GSM_Rephrased", "MATH_SV", "other")]), (F.pmod(F.col("doc_id"), F.lit(4)) + 1).cast("int"))
    return d.select(F.col("doc_id").alias("row_idx"), kind.alias("type"), F.col("text").alias("query"), F.lit("").alias("target"))


def near_dedup_docs(spark, sf_dir):
    return dedup.decide(_problems(spark, sf_dir)).select("row_idx", "type", "decision", "kept_idx")


def dedup_report(spark, sf_dir):
    return dedup.report(dedup.decide(_problems(spark, sf_dir), dedup.DedupConfig(similar=False)))


def type_priority_rank(spark, sf_dir):
    p = _problems(spark, sf_dir).withColumn("rank", dedup.keep_rank(F.col("type"), F.col("target"), F.col("query"), F.col("row_idx")))
    best = p.groupBy("type").agg(F.min("rank").alias("r"))
    return best.select("type", F.col("r.p").alias("priority"), F.col("r.q").alias("query_words"), F.col("r.i").alias("row_idx"))


def near_dup_pairs_jaccard(spark, sf_dir):
    """All pairs of documents whose sets of words have a Jaccard of 0.9 or more, each once, smaller id first."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    p = dedup.near_pairs(d, "doc_id", select.retrieval_tokens(F.col("text")))
    return p.select(F.col("a").alias("query_id"), F.col("b").alias("record_id"), F.round("jaccard", 6).alias("score"))


def simhash_bands(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    t = d.select("doc_id", S.query_simhash64(X.canonicalize_query(F.col("text"))).alias("sig"))
    return t.select("doc_id", "sig", F.explode(S.bands(F.col("sig"))).alias("b")).select("doc_id", "sig", "b.band", "b.value")


def repetition_docs(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    d = d.select("doc_id", "text", S.max_trigram_count(F.col("text")).alias("trigrams"))  # once for both columns that need it
    return d.select("doc_id", "trigrams", (dedup.word_count(F.col("text")) >= 40).alias("long_enough"), curate.repetitive(F.col("text"), F.col("trigrams")).alias("repetitive"))


def audit_counters(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.replace(F.col("html"), F.lit("</"), F.lit("\\")).alias("query_vi"), F.concat(F.lit("đáp án là: "), F.col("page_id").cast("string")).alias("response_vi"))
    cols = ("records", "missing_query", "missing_response", "gold_extractable", "gold_numeric", "records_with_latex", "frac_total", "inequality_records")
    return audit.audit_split(p).select(*cols)


def top_commands(spark, sf_dir):
    return audit.top_matches(table(spark, sf_dir, "pages"), "html", "<([a-z][a-z0-9]*)", 30)


def eda_percentiles(spark, sf_dir):
    e = audit.eda(table(spark, sf_dir, "documents"), ["lang"], "text")
    return e.select("lang", "n", "missing", "duplicates", *[F.round(c, 6).alias(c) for c in e.columns if c[0] == "p"])


def token_lengths(spark, sf_dir):
    t = audit.token_lengths(table(spark, sf_dir, "documents"), curate.token_count(F.col("text")))
    return t.select("n", *[F.round(c, 4).alias(c) for c in t.columns if c != "n"])


def stage_accounting(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id", "left")
    gates = [("language", F.col("lang").isin("en", "fr")), ("length", F.col("n_chars") <= 5000), ("digits", ~F.col("text").rlike("[0-9]")), ("label", F.coalesce("quality", F.lit(1)) == 1)]
    return curate.stage_accounting(d, gates)


def balanced_sample(spark, sf_dir):
    return select.sample_by_type(table(spark, sf_dir, "part"), 60, "p_brand", "p_partkey", 7).select("p_partkey", "p_brand")


def weighted_sample(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") <= 25, "GSM_A").otherwise("MATH_B"))
    return select.sample_by_type(p, 40, "kind", "p_partkey", 7, {"GSM": 0.75}).groupBy("kind").agg(F.count("*").alias("n"))


def quality_diverse(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return select.quality_diverse(p, ["p_brand"], "p_size", "p_partkey", 50, 3).select("p_partkey", "p_brand", "p_size")


def magnitude_buckets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(select.magnitude_bucket(F.col("o_totalprice") / 1000).alias("bucket"), select.length_bucket(F.repeat(F.lit("x"), (F.col("o_orderkey") % 600).cast("int"))).alias("length")).agg(F.count("*").alias("n"))


def operation_signatures(spark, sf_dir):
    words = F.array(*[F.lit(w) for w in ("thêm 3", "mỗi 5", "a - b", "gấp đôi", "phần trăm", "x = 1/2", "none here")])
    t = table(spark, sf_dir, "lineitem").select(F.concat_ws(" ", F.element_at(words, (F.pmod("l_partkey", F.lit(7)) + 1).cast("int")), F.element_at(words, (F.pmod("l_suppkey", F.lit(7)) + 1).cast("int"))).alias("t"))
    return t.groupBy(select.operation_signature(F.col("t")).alias("signature")).agg(F.count("*").alias("n"))


def retrieval_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    r = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), "text"))
    return select.retrieve(q, r, 3, tokens=lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0)))).withColumn("score", F.round("score", 6))


def resume_antijoin(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("source_hash", align.source_hash(F.col("doc_id").cast("string"), F.col("text")))
    return align.resume(d, d.filter("doc_id % 3 = 0"), "source_hash").select("doc_id", "source_hash")


def parse_html_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    log = n.select(F.concat(F.lit("<table><tr>\n "), cell(F.col("n_nationkey").cast("string")), F.lit("\n"), cell(F.concat(F.lit("1."), F.col("n_regionkey").cast("string"))), cell(F.lit("2.5")), F.lit("</tr></table> Epoch 3: checkpoint-"), F.col("n_nationkey").cast("string"), F.lit(" raw_score=77 exact=5")).alias("text"))
    losses, scores = reports.training_losses(log), reports.epoch_scores(log).select(F.regexp_extract("checkpoint", "([0-9]+)$", 1).cast("int").alias("epoch"), "raw_score", "exact_count")
    return align.with_losses(scores, losses, 100)


def decoding_logs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    label = F.when(F.col("n_nationkey") % 5 == 0, "baseline").otherwise(F.concat(F.lit("sc"), F.col("n_nationkey").cast("string")))
    log = n.select(F.concat(F.lit("x [eval:"), label, F.lit("] raw="), F.col("n_nationkey").cast("string"), F.lit("/100 exact=3 extractable=9/10 median_re="), F.when(F.col("n_regionkey") == 1, "None").otherwise("0.5"), F.lit(" y")).alias("text"))
    return reports.decoding_scores(log)


def failure_tables(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    log = r.select(F.concat(F.lit("a\n### FAILURE MATRIX DAMAGE DISTRIBUTION\n| failures | n | m |\n|---|---|---|\n| mode"), F.col("r_regionkey").cast("string"), F.lit(" | "), (F.col("r_regionkey") * 3).cast("string"), F.lit(" | 1.5 |\n### SUB-TRACK TRACKING PERFORMANCE\n| type | count | mean |\n| T | 4 | 2.5 |\n[EXTRACTION SIMULATOR] b")).alias("text"))
    return reports.failure_table(log).select(F.lit("failure").alias("kind"), F.col("failure").alias("name"), F.col("occurrences").alias("n"), "mean_score").unionByName(reports.type_table(log).select(F.lit("type").alias("kind"), F.col("type").alias("name"), F.col("count").alias("n"), "mean_score"))


def conversation_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    bank = lambda role: c.filter(F.col("role") == role).select(F.col("conv_id").alias("record_id"), F.lit(role).alias("checkpoint"), F.col("turn").alias("sample_idx"), "text")
    from ..operators import vote

    return vote.candidate_counts(vote.candidate_bank(bank("user"), bank("assistant")))


def validate_schema(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.lit("q").alias("query_vi"), F.col("role").alias("type"), F.col("text").alias("model_output"))
    return records.validate_predictions(c).groupBy("type").agg(F.count("model_output").alias("n"))


def targets(spark, sf_dir):
    t = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    q, n = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    text = F.concat(F.lit("Ta tính. Ta có "), q, F.lit(" + "), n, F.lit(" = 9 quả. Vậy xong. Đáp án là: "), q)
    return curate.attach_targets(t.select("l_orderkey", "l_linenumber", text.alias("response_vi"))).select("l_orderkey", "l_linenumber", F.col("target"))


def number_words(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    tens = F.array(*[F.lit(w) for w in ("hai", "ba", "bốn", "năm", "sáu")])
    k = F.col("n_nationkey")
    text = F.concat(F.lit("có "), F.element_at(tens, (k % 5 + 1).cast("int")), F.lit(" trăm "), F.element_at(tens, (F.floor(k / 5) + 1).cast("int")), F.lit(" mươi bảy quả thứ hai nhân 2"))
    return t.select("n_nationkey", V.vi_math_text(text).alias("text"))


def arithmetic_checks(spark, sf_dir):
    t = table(spark, sf_dir, "nation")
    k, r = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    text = F.concat(k, F.lit(" + "), r, F.lit(" = "), k, F.lit(" ; 2*3 = 6"))
    from ..functions import numeric

    return t.select("n_nationkey", numeric.arithmetic_score(text).alias("share"))


def event_gaps(spark, sf_dir):
    """Row numbers over a whole table without one global window."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return align.with_row_idx(e, "ts", "event_id").select("event_id", "row_idx")


def token_weights(spark, sf_dir):
    """WIN10: the largest weight within three places of each row of an order."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("w"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(-3, 3)
    return t.select("l_orderkey", "l_linenumber", F.max("w").over(w).alias("weight"))


QUERIES = {f.__name__: f for f in (normalize_space_docs, canonicalize_docs, feature_counts, exact_dedup_docs, near_dedup_docs, dedup_report, type_priority_rank, near_dup_pairs_jaccard, simhash_bands, repetition_docs, audit_counters, top_commands, eda_percentiles, token_lengths, stage_accounting, balanced_sample, weighted_sample, quality_diverse, magnitude_buckets, operation_signatures, retrieval_topk, resume_antijoin, parse_html_rows, decoding_logs, failure_tables, conversation_turns, validate_schema, targets, number_words, arithmetic_checks, event_gaps, token_weights)}

_WS = r"[\s\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_KEY = _STRIP(f"regexp_replace(lower(coalesce(text, '')), '{_WS}+', ' ', 'g')")
_SPACE = _STRIP("regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_TOKENS = r"-?[0-9]+(?:\.[0-9]+)?|[a-z]+|[+\-*/=<>]"
_PLAIN = f"trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')), '[^0-9a-z+\\-*/=<>.% ]+', ' ', 'g'))"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '\S+'))"
_PROBLEMS = "p AS (SELECT doc_id AS row_idx, ['GSM_AnsAug', 'GSM_Rephrased', 'MATH_SV', 'other'][doc_id % 4 + 1] AS type, text FROM documents)"
_RETRIEVE = lambda q, r, k: f"""
q0 AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {q}),
q AS MATERIALIZED (SELECT query_id, unnest(t) AS token, len(t) AS qn FROM q0),
r0 AS MATERIALIZED (SELECT {r[1]} AS record_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM {r[0]}),
r AS MATERIALIZED (SELECT record_id, unnest(t) AS token, len(t) AS rn FROM r0),
s AS (SELECT query_id, record_id, sum(CASE WHEN regexp_matches(token, '[0-9]') THEN 3.0 ELSE 1.0 END) / sqrt(any_value(qn) * any_value(rn)::DOUBLE) AS score FROM q JOIN r USING (token) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_id) AS place FROM s)"""  # noqa: E731

ORACLES = {
    "normalize_space_docs": f"SELECT doc_id, md5({_SPACE}) AS space_md5, md5({_KEY}) AS key_md5 FROM documents",
    "feature_counts": f"""WITH t AS (SELECT item_id, regexp_extract_all({_PLAIN}, '{_TOKENS}') AS t FROM benchmark)
        SELECT item_id, len(t) AS tokens, len(list_distinct(t)) + len(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1]))) AS features FROM t""",
    "exact_dedup_docs": f"SELECT arg_min(doc_id, (length(text), doc_id)) AS doc_id FROM documents WHERE {_KEY} <> '' GROUP BY {_KEY}",
    "type_priority_rank": f"WITH {_PROBLEMS}, r AS (SELECT type, CASE type WHEN 'GSM_Rephrased' THEN 0 WHEN 'GSM_AnsAug' THEN 1 WHEN 'MATH_SV' THEN 7 ELSE 99 END AS priority, {_WORDS} AS w, row_idx FROM p) SELECT type, min(priority) AS priority, min(w) AS query_words, arg_min(row_idx, (w, row_idx)) AS row_idx FROM r GROUP BY type",
    "repetition_docs": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w, text FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w), c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS n FROM c GROUP BY 1),
        l AS (SELECT doc_id, trim(unnest(string_split_regex(lower(text), '\r\n|[\n\r\x0b\x0c\x1c-\x1e]'))) AS l FROM documents), lc AS (SELECT doc_id, l, count(*) AS n FROM l WHERE l <> '' GROUP BY 1, 2), lm AS (SELECT doc_id, max(n) AS n FROM lc GROUP BY 1)
        SELECT w.doc_id, CAST(coalesce(m.n, 0) AS INT) AS trigrams, len(w.w) >= 40 AS long_enough, len(w.w) >= 40 AND (coalesce(m.n, 0) >= 4 OR coalesce(lm.n, 0) >= 3) AS repetitive FROM w LEFT JOIN m USING (doc_id) LEFT JOIN lm USING (doc_id)""",
    "audit_counters": r"""WITH t AS (SELECT replace(html, '</', '\') AS q, page_id FROM pages) SELECT count(*) AS records, count(*) FILTER (coalesce(q, '') = '') AS missing_query, CAST(0 AS BIGINT) AS missing_response, count(*) AS gold_extractable, count(*) AS gold_numeric,
        count(*) FILTER (regexp_matches(q, '\\[A-Za-z]+')) AS records_with_latex, CAST(sum(len(regexp_extract_all(q, '\\(?:d|t)?frac\s*\{[^{}]+\}\s*\{[^{}]+\}'))) AS BIGINT) AS frac_total, count(*) FILTER (regexp_matches(q, '\\(?:leq?|geq?|neq?|equiv)\b')) AS inequality_records FROM t""",
    "top_commands": "WITH m AS (SELECT unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1)) AS match FROM pages) SELECT match, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, match LIMIT 30",
    "eda_percentiles": "SELECT lang, count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS missing, count(text) - count(DISTINCT text) AS duplicates, " + ", ".join(f"round(quantile_cont(CASE WHEN text <> '' THEN length(text)::DOUBLE END, {q / 100}), 6) AS p{q}" for q in audit.QUANTILES) + " FROM documents GROUP BY lang",
    "token_lengths": f"WITH t AS (SELECT {_WORDS} * 1.3::DOUBLE AS n FROM documents) SELECT count(*) AS n, round(avg(n), 4) AS mean, round(max(n), 4) AS longest, " + ", ".join(f"round(quantile_cont(n, {q / 100}), 4) AS p{str(q).replace('.', '_')}" for q in audit.TOKEN_QUANTILES) + " FROM t",
    "stage_accounting": """WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), d AS (SELECT d.*, coalesce(quality, 1) AS quality FROM documents d LEFT JOIN q USING (doc_id)),
        s AS (SELECT lang IN ('en', 'fr') AS a, n_chars <= 5000 AS b, NOT regexp_matches(text, '[0-9]') AS c, quality = 1 AS e FROM d)
        SELECT unnest([0, 1, 2, 3, 4]) AS stage_no, unnest(['input', 'language', 'length', 'digits', 'label']) AS stage, unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND e)]) AS rows_left FROM s""",
    "weighted_sample": """WITH t AS (SELECT CASE WHEN p_size <= 25 THEN 'GSM_A' ELSE 'MATH_B' END AS kind, md5('7|' || p_partkey) AS h FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY h) AS rn FROM t),
        k AS (SELECT kind FROM n ORDER BY rn > CASE WHEN kind = 'GSM_A' THEN 30 ELSE 0 END, h LIMIT 40) SELECT kind, count(*) AS n FROM k GROUP BY 1""",
    "balanced_sample": """WITH t AS (SELECT p_partkey, p_brand, md5('7|' || p_partkey) AS h FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY h) AS rn, (SELECT count(DISTINCT p_brand) FROM part) AS types FROM t),
        f AS (SELECT *, rn <= greatest(ceil(60.0 / types), 1) AS first FROM n) SELECT p_partkey, p_brand FROM f ORDER BY NOT first, CASE WHEN first THEN p_brand END, CASE WHEN first THEN rn END, h LIMIT 60""",
    "quality_diverse": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, md5('3|' || p_partkey)) AS round FROM part) SELECT p_partkey, p_brand, p_size FROM t ORDER BY round, md5('3|' || p_brand) LIMIT 50",
    "magnitude_buckets": "WITH t AS (SELECT o_totalprice / 1000 AS a, o_orderkey % 600 AS n FROM orders) SELECT CASE WHEN a < 1 THEN '<1' WHEN a < 10 THEN '1-9' WHEN a < 100 THEN '10-99' WHEN a < 1000 THEN '100-999' ELSE '1000+' END AS bucket, CASE WHEN n < 180 THEN 'short' WHEN n < 450 THEN 'medium' ELSE 'long' END AS length, count(*) AS n FROM t GROUP BY 1, 2",
    "operation_signatures": """WITH w AS (SELECT ['thêm 3', 'mỗi 5', 'a - b', 'gấp đôi', 'phần trăm', 'x = 1/2', 'none here'] AS w), t AS (SELECT w[l_partkey % 7 + 1] || ' ' || w[l_suppkey % 7 + 1] AS t FROM lineitem, w),
        s AS (SELECT concat_ws('+', CASE WHEN regexp_matches(t, '\\+|thêm|cộng') THEN 'add' END, CASE WHEN regexp_matches(t, '-|bớt|trừ|mất|giảm') THEN 'sub' END, CASE WHEN regexp_matches(t, '\\*|×|nhân|gấp') THEN 'mul' END, CASE WHEN regexp_matches(t, '/|chia|mỗi') THEN 'div' END, CASE WHEN regexp_matches(t, '%|phần trăm') THEN 'percent' END, CASE WHEN regexp_matches(t, '[0-9]+\\s*/\\s*[0-9]+') THEN 'fraction' END, CASE WHEN regexp_matches(t, '=') THEN 'equation' END) AS s FROM t)
        SELECT CASE WHEN s = '' THEN 'other' ELSE s END AS signature, count(*) AS n FROM s GROUP BY 1""",
    "retrieval_topk": f"WITH {_RETRIEVE('benchmark', ('documents', 'doc_id'), 3)} SELECT query_id, CAST(place AS INT) AS place, record_id, round(score, 6) AS score FROM k WHERE place <= 3",
    "resume_antijoin": "WITH d AS (SELECT doc_id, sha256(doc_id || chr(10) || text) AS source_hash FROM documents) SELECT * FROM d WHERE source_hash NOT IN (SELECT source_hash FROM d WHERE doc_id % 3 = 0)",
    "parse_html_rows": "SELECT n_nationkey AS epoch, 77 AS raw_score, 5 AS exact_count, 1 + n_regionkey / 10.0 AS training_loss, 2.5 AS validation_loss, 2.5 - (1 + n_regionkey / 10.0) AS loss_gap, 0.77 AS score_pct FROM nation",
    "decoding_logs": "SELECT 'sc' || n_nationkey AS label, n_nationkey AS raw_score, 100 AS max_raw_score, n_nationkey / 100.0 AS score_pct, 3 AS exact_count, 9 AS extractable_count, 10 AS n, CASE WHEN n_regionkey <> 1 THEN 0.5 END AS median_rel_error FROM nation WHERE n_nationkey % 5 <> 0",
    "failure_tables": "SELECT 'failure' AS kind, 'mode' || r_regionkey AS name, r_regionkey * 3 AS n, 1.5 AS mean_score FROM region UNION ALL SELECT 'type', 'T', 4, 2.5 FROM region",
    "conversation_turns": "WITH c AS (SELECT conv_id, count(*) AS candidates FROM conversations WHERE role IN ('user', 'assistant') GROUP BY 1) SELECT candidates, count(*) AS records FROM c GROUP BY 1",
    "validate_schema": "SELECT role AS type, count(text) AS n FROM conversations GROUP BY 1",
    "targets": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) || ' + ' || l_linenumber || ' = 9 quả' || chr(10) || '####đáp án là: ' || CAST(l_quantity AS INT) AS target FROM lineitem",
    "number_words": "SELECT n_nationkey, 'có ' || (100 * (n_nationkey % 5 + 2) + 10 * (n_nationkey // 5 + 2) + 7) || ' quả thứ hai * 2' AS text FROM nation",
    "arithmetic_checks": "SELECT n_nationkey, CASE WHEN n_regionkey / greatest(1.0, n_nationkey) < 0.02 THEN 1.0 ELSE 0.5 END AS share FROM nation",
    "event_gaps": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events",
    "token_weights": "WITH t AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, max(w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS weight FROM t",
}
