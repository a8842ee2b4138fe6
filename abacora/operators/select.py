"""Selection of training records (QLT1-2, WIN6-7, SEL1-2, SRT5-6) and retrieval (JOIN7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import numeric
from ..functions import text as X
from .curate import family, has_operator
from .dedup import first_by_key
from .scratch import stored


def quality_score(target: Column, lines: Column, fallback: Column, gold: Column) -> Column:
    """QLT1: 0 to 8."""
    some = F.coalesce(F.size(lines), F.lit(0)) > 0
    operators = F.coalesce(F.exists(lines, has_operator), F.lit(False))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return 2 * one(some) + 2 * one(operators) + one(F.length(F.coalesce(target, F.lit(""))) <= 350) + one(~F.coalesce(fallback, F.lit(False))) + one(numeric.parse_number(gold).isNotNull()) + one(F.contains(F.coalesce(target, F.lit("")), F.coalesce(gold, F.lit(""))))


def magnitude_bucket(x: Column) -> Column:
    a = F.abs(x)
    return F.when(x.isNull(), "non_numeric").when(a < 1, "<1").when(a < 10, "1-9").when(a < 100, "10-99").when(a < 1000, "100-999").otherwise("1000+")


def length_bucket(text: Column) -> Column:
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n < 180, "short").when(n < 450, "medium").otherwise("long")


#: Signs and words of each operation, in this order.
OPERATIONS = (("add", r"\+|thêm|cộng"), ("sub", r"\-|bớt|trừ|mất|giảm"), ("mul", r"\*|×|nhân|gấp"), ("div", r"/|chia|mỗi"), ("percent", r"%|phần trăm"), ("fraction", r"\\frac|[0-9]+\s*/\s*[0-9]+"), ("equation", "="))


def operation_signature(text: Column) -> Column:
    tags = F.filter(F.array(*[F.when(text.rlike("(?iu)" + p), F.lit(name)) for name, p in OPERATIONS]), lambda t: t.isNotNull())
    return F.coalesce(F.nullif(F.array_join(tags, "+"), F.lit("")), F.lit("other"))


def quality_diverse(rows: DataFrame, bucket: list[str], quality: str, key: str, most: int, seed: int = 0) -> DataFrame:
    """WIN6: round-robin over buckets, best first; ties and the order of buckets by hashes instead of a random generator.

    Only the first `most` of a bucket can be taken, which the window's own limit applies before its shuffle.
    """
    h = lambda *c: F.md5(F.concat_ws("|", F.lit(str(seed)), *c))
    order = [F.desc(quality), h(F.col(key).cast("string"))]
    placed = rows.withColumn("round", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))).filter(F.col("round") <= most)
    return placed.orderBy("round", h(*[F.col(b).cast("string") for b in bucket])).limit(most)


def sample_by_type(rows: DataFrame, most: int, type_: str, key: str, seed: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """WIN7: balanced over types, or family shares by weight; then leftovers up to `most`, all in the order of a hash of the key."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))
    t = rows.withColumn("_h", h).withColumn("_t", F.coalesce(F.nullif(F.col(type_).cast("string"), F.lit("")), F.lit("unknown")))
    if weights is None:
        types = F.broadcast(t.agg(F.countDistinct("_t").alias("_types")))
        t = t.withColumn("_n", F.row_number().over(Window.partitionBy("_t").orderBy("_h"))).filter(F.col("_n") <= most).crossJoin(types)
        first = F.col("_n") <= F.greatest(F.ceil(F.lit(most) / F.greatest("_types", F.lit(1))), F.lit(1))
        ranked = t.withColumn("_late", (~first).cast("int"))
        order = ["_late", F.when(first, F.col("_t")), F.when(first, F.col("_n")), "_h"]
        return ranked.orderBy(*order).limit(most).drop("_h", "_t", "_n", "_types", "_late")
    pick = F.lit(None).cast("string")
    for name in reversed(list(weights)):
        pick = F.when(family(F.col("_t"), name), name).otherwise(pick)
    t = t.withColumn("_f", pick).withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy("_h"))).filter(F.col("_n") <= most)  # more of a family are never taken, so the window is limited before its shuffle
    want = F.lit(0)
    for name, w in weights.items():
        want = F.when(F.col("_f") == name, round(most * w)).otherwise(want)
    return t.orderBy((F.col("_n") > want).cast("int"), "_h").limit(most).drop("_h", "_t", "_f", "_n")


def select_train_records(rows: DataFrame, style: str = "natural", most: int | None = None, family_name: str = "", dedup: bool = False, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """SEL1: family filter, first record of each question, then a sampling style. Columns: row_idx, type, query."""
    out = rows.filter(family(F.col("type"), family_name))
    if dedup:
        out = first_by_key(out, X.dedup_key(F.col("query")), F.col("row_idx"))
    shares = {"gsm_heavy": {"GSM": 0.75}, "math_heavy": {"MATH": 0.75}}
    if style == "easy_first":
        out = out.orderBy(tokens if tokens is not None else F.length("query"), "row_idx")
        return out.limit(most) if most else out
    if not most:
        return out
    if style == "natural":
        return out.orderBy("row_idx").limit(most)
    if style == "balanced_type" or style in shares:
        return sample_by_type(out, most, "type", "row_idx", seed, shares.get(style))
    raise ValueError(f"unknown sampling style {style}")


def promote(runs: DataFrame, threshold: float = 0.468, least_n: int = 500, stubs: tuple[str, ...] = ("answer_only", "answer_stub")) -> DataFrame:
    """SEL2: the best run that has enough records, a score over the threshold and no answer-stub style; else no row."""
    ok = runs.filter((F.col("n") >= least_n) & (F.col("score_10") > threshold) & ~F.coalesce(F.col("train_style").isin(*stubs), F.lit(False)))
    return ok.orderBy(F.desc("score_10"), "name").limit(1)


def retrieval_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)))


#: Postings of a token looked at for a first threshold: of rare tokens, and of every token; and how many of the rows met are then scored.
SEED_LIST, SEED_EACH, SEED_SCORED = 64, 4, 16


def _points(common: Column) -> Column:
    """Three for a token with a digit, else one."""
    return F.size(common) + 2 * F.size(F.filter(common, lambda t: t.rlike("[0-9]")))


def _scored_pairs(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    both = pairs.select("query_id", "record_id").join(q.select("query_id", F.col("t").alias("qt")), "query_id").join(r.select("record_id", F.col("t").alias("rt")), "record_id")
    score = _points(F.array_intersect("qt", "rt")) / F.sqrt(F.size("qt").cast("double") * F.size("rt"))
    return both.select("query_id", "record_id", score.alias("score"))


def _best(scored: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(by), "record_id")
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def retrieval_candidates(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """query_id, record_id: every pair that can be among the k best of its query. q: query_id, t; r: record_id, t (distinct tokens).

    Tokens of a query are taken from rare to common. A record first met at a token holds no rarer token of the query, so
    its score is at most what the weights from there on allow at its size: min(rest, heaviest * n) / sqrt(qn * n). Postings lie in
    blocks by the size of their records, each with its own bound; a block is looked up only if its bound reaches the k-th best score
    already known, and a posting is taken only if its own does. The first threshold comes from exact scores of a few rows: of those met by
    the rarest tokens and by each token's shortest records.
    """
    postings = r.select("record_id", F.size("t").alias("rn"), F.explode("t").alias("token"))
    tokens = q.select("query_id", F.size("t").alias("qn"), F.explode("t").alias("token"))
    met = tokens.select("token").distinct().join(postings, "token")
    often = met.groupBy("token").agg(F.count("*").alias("df"))
    w = Window.partitionBy("query_id").orderBy("df", "token")
    weight = F.when(F.col("token").rlike("[0-9]"), 3.0).otherwise(1.0)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    ordered = tokens.join(often, "token").withColumn("weight", weight).select(
        "query_id", "qn", "token", "df", "weight", F.sum("weight").over(rest).alias("rest"), F.max("weight").over(rest).alias("heaviest"), F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    shortest = met.withColumn("at", F.row_number().over(Window.partitionBy("token").orderBy("rn", "record_id"))).filter(F.col("at") <= SEED_LIST)
    first = ordered.join(shortest, "token").filter(F.col("at") <= F.when(F.col("before") < SEED_LIST, SEED_LIST).otherwise(SEED_EACH))
    partial = first.groupBy("query_id", "record_id").agg((F.sum("weight") / F.sqrt(F.max("rn").cast("double"))).alias("partial"))
    known = _best(_scored_pairs(_best(partial, "partial", SEED_SCORED), q, r), "score", k)
    threshold = known.groupBy("query_id").agg((F.min(F.when(F.col("place") == k, F.col("score"))) * (1 - 1e-9)).alias("least"))
    ordered = ordered.join(threshold, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))

    def bound(n: Column) -> Column:
        return F.least("rest", F.col("heaviest") * n) / F.sqrt(F.col("qn").cast("double") * n)

    # Within a block the bound is largest at the size that the rest of the query just fills.
    low = F.pow(F.lit(2.0), F.col("block"))
    top = F.least(F.greatest(F.col("rest") / F.col("heaviest"), low), 2 * low)
    looked_up = ordered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(30)))).filter(bound(top) >= F.col("least"))
    blocks = met.withColumn("block", F.floor(F.log2("rn")).cast("int"))
    return looked_up.join(blocks, ["token", "block"]).filter(bound(F.col("rn")) >= F.col("least")).select("query_id", "record_id").distinct()


#: Up to so many tokens of all queries together every task holds their index and scores its own records.
SCAN_TOKENS = 500_000
#: Scores and meetings of a query with a token that are held at once while records are scored.
SCAN_CELLS = 1_000_000


def _scan(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """query_id, record_id, score: of some records at a time the k best of each query, ties by record id. Nothing is shuffled; every pair with a common token is scored."""
    held = q.select("query_id", "t").toArrow()  # at most SCAN_TOKENS tokens
    ids, lists = held.column("query_id").combine_chunks(), held.column("t").combine_chunks()
    coded, per = lists.flatten().dictionary_encode(), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words, place = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    weights = np.where(pc.match_substring_regex(words, "[0-9]").to_numpy(zero_copy_only=False), 3.0, 1.0)
    starts = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(words)))])
    owners = np.repeat(np.arange(len(per)), per)[np.argsort(place, kind="stable")]
    shared = q.sparkSession.sparkContext.broadcast((ids, per, words, weights, starts, owners))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, qn, words, weights, starts, owners = shared.value
        least = np.zeros(len(ids))  # the k-th best score of each query so far
        for batch in batches:
            rn = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            met = pc.index_in(batch.column(1).flatten(), value_set=words)
            row = np.repeat(np.arange(len(rn)), rn)[met.is_valid().to_numpy(zero_copy_only=False)]
            word = met.drop_null().to_numpy(zero_copy_only=False)
            often = starts[word + 1] - starts[word]
            rank = np.empty(len(rn), np.int64)
            rank[pc.sort_indices(batch.column(0), null_placement="at_start").to_numpy()] = np.arange(len(rn))
            cells = np.cumsum(np.maximum(np.bincount(row, often, len(rn)), len(ids)))
            edges = [0, *(np.flatnonzero(np.diff(cells // SCAN_CELLS)) + 1), len(rn)]
            for low, high in zip(edges, edges[1:]):
                here = slice(*np.searchsorted(row, [low, high]))
                w, n = word[here], often[here]
                at = np.repeat(starts[w] - np.cumsum(n) + n, n) + np.arange(n.sum())
                points = np.bincount(np.repeat(row[here] - low, n) * len(ids) + owners[at], np.repeat(weights[w], n), (high - low) * len(ids))
                found = np.flatnonzero(points)
                i, j = found // max(1, len(ids)) + low, found % max(1, len(ids))
                score = points[found] / np.sqrt(qn[j].astype(float) * rn[i])
                able = score >= least[j]
                i, j, score = i[able], j[able], score[able]
                order = np.lexsort((rank[i], -score, j))
                i, j, score = i[order], j[order], score[order]
                nth = np.arange(len(j)) - np.searchsorted(j, j)
                last, kept = nth == k - 1, nth < k
                least[j[last]] = score[last]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(j[kept])), batch.column(0).take(pa.array(i[kept])), pa.array(score[kept])], names=["query_id", "record_id", "score"])

    return r.select("record_id", "t").mapInArrow(run, T.StructType([q.schema["query_id"], r.schema["record_id"], T.StructField("score", T.DoubleType())]))


def retrieve(queries: DataFrame, records: DataFrame, k: int, query_id: str = "query_id", record_id: str = "record_id", text: str = "text", tokens=retrieval_tokens) -> DataFrame:
    """JOIN7: the k best records of each query by token overlap (numbers count three times) over the root of both sizes. Ties by record id.

    The queries' index goes to the records, which are read once, neither stored nor shuffled; what is handed on are the k best of each query
    of some records at a time. With more than SCAN_TOKENS tokens of queries the records are indexed instead, with bounds: only pairs that can be among the k
    best are made and scored (retrieval_candidates). A score over 0 needs a common token, so rows without one are nobody's.
    """
    q = stored(queries.select(F.col(query_id).alias("query_id"), tokens(F.col(text)).alias("t")).filter(F.size("t") > 0), "retrieval-queries")
    # No filter on t here: the optimizer would copy its definition below and work the tokens out twice.
    r = records.select(F.col(record_id).alias("record_id"), F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")).alias("t"))
    if (q.agg(F.sum(F.size("t"))).first()[0] or 0) <= SCAN_TOKENS:
        scored = _scan(q, r, k)
    else:
        r = stored(r, "retrieval-records").filter(F.size("t") > 0)
        scored = _scored_pairs(retrieval_candidates(q, r, k), q, r)
    return _best(scored, "score", k).select("query_id", "place", "record_id", "score")
