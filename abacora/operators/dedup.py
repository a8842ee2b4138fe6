"""Exact and near-duplicate removal by keep priority (DED1-2, WIN1-3, JOIN6, AGG16)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import similarity as S
from ..functions import text as X
from .scratch import stored


@dataclass(frozen=True)
class DedupConfig:
    similar: bool = True
    jaccard_threshold: float = 0.90
    sequence_threshold: float = 0.94
    require_number_signature_match: bool = True
    min_token_count: int = 6
    audit_examples: int = 12


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(P.WORD))


def keep_rank(type_: Column, target: Column, query: Column, row_idx: Column) -> Column:
    """WIN1 as a comparable struct: type priority, target words, query words, row."""
    return F.struct(_priority(type_).alias("p"), word_count(target).alias("t"), word_count(query).alias("q"), row_idx.cast("long").alias("i"))


def _priority(type_: Column) -> Column:
    out = None
    for name, p in P.TYPE_PRIORITY.items():
        out = F.when(type_ == name, p) if out is None else out.when(type_ == name, p)
    return out.otherwise(99)


def first_by_key(rows: DataFrame, key: Column, rank: Column, keep_empty: bool = False) -> DataFrame:
    """WIN2 (keep_empty) and WIN3: of each key the row of the smallest rank; rows of the empty key all stay or all go.

    A grouped minimum and a join on key and rank: both combine before they shuffle, a hot key is no single sorted window.
    """
    t = rows.withColumn("_key", key).withColumn("_rank", rank)
    full = t.filter((F.col("_key") != "") & F.col("_key").isNotNull())
    best = full.groupBy(F.col("_key").alias("_k")).agg(F.min("_rank").alias("_r"))
    kept = full.join(best, (F.col("_key") == F.col("_k")) & (F.col("_rank") == F.col("_r")), "left_semi")
    if keep_empty:
        kept = kept.unionByName(t.filter((F.col("_key") == "") | F.col("_key").isNull()))
    return kept.drop("_key", "_rank")


def _banded(nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """bucket, rank, gate: a row per node and band; nodes may share a witness only within a bucket, and only with the gate open are they dropped."""
    gate = (F.col("n_tokens") >= cfg.min_token_count) & ((F.size("numbers") > 0) | F.lit(not cfg.require_number_signature_match))
    each = nodes.select("rank", "numbers", gate.alias("gate"), F.explode(S.bands(F.col("sig"))).alias("b"))
    return each.select(F.struct("numbers", "b.band", "b.value").alias("bucket"), "rank", "gate")


def _verified(pairs: DataFrame, nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """The pairs (u, v) of ranks whose texts are similar."""
    body = nodes.select("rank", "canonical", "features")
    both = pairs.join(body.select(F.col("rank").alias("u"), F.col("canonical").alias("uc"), F.col("features").alias("uf")), "u").join(body.select(F.col("rank").alias("v"), F.col("canonical").alias("vc"), F.col("features").alias("vf")), "v")
    both = both.withColumn("jac", S.jaccard(F.col("vf"), F.col("uf")) >= cfg.jaccard_threshold)
    near = S.ratio_at_least(cfg.sequence_threshold)(F.when(~F.col("jac"), F.col("vc")), F.when(~F.col("jac"), F.col("uc")))
    return both.filter(F.col("jac") | near).select("u", "v")


def _pairs(smaller: DataFrame, larger: DataFrame) -> DataFrame:
    """(u, v): ranks of both tables that share a bucket, the larger one with its gate open, each pair once."""
    a, b = smaller.alias("a"), larger.filter("gate").alias("b")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rank") < F.col("b.rank"))
    return a.join(b, on).select(F.col("a.rank").alias("u"), F.col("b.rank").alias("v")).distinct()


def similar_edges(nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """JOIN6: (kept, dropped) of ranks: pairs that share number signature and a band, are similar, and whose later one passes the gate."""
    lean = _banded(nodes, cfg)
    return _verified(_pairs(lean, lean), nodes, cfg)


#: Buckets with so many pairs in all are compared pair by pair.
FEW_PAIRS = 200_000


def dropped_nodes(nodes: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(node, witness) of what a walk in rank order would drop, without squaring groups of copies.

    A node that is the smallest open one of all its buckets has no smaller node left to be compared with, so it is kept: a hub. Every
    round compares hubs with the open nodes of their buckets only and drops what is similar, so a group of copies costs as many pairs as it has
    members. When few pairs are left, or a round takes less than a third of them, the open rest is compared pair by
    pair (mutually unlike nodes of a bucket are compared in the walk as well) and settled by greedy(). A node dropped by a hub may have a smaller kept
    witness that was decided later; kept nodes below the witness are looked at in the end.
    """
    lean = _banded(nodes, cfg)
    busy = lean.groupBy("bucket").agg(F.count("*").alias("n"), F.max("gate").alias("g")).filter("n > 1 and g").select("bucket")
    lean = stored(lean.join(busy, "bucket", "left_semi"), "bands")
    open_, gone, before = lean, None, None
    while True:
        n = F.col("n").cast("double")
        load = open_.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.sum(n * (n - 1) / 2)).first()[0] or 0.0
        if load <= FEW_PAIRS or (before is not None and load > 0.67 * before):
            break
        before = load
        first = open_.groupBy("bucket").agg(F.min("rank").alias("rank"))
        later = open_.join(first.withColumnRenamed("rank", "first"), "bucket").filter(F.col("rank") > F.col("first")).select("rank").distinct()
        hubs = stored(first.select("rank").distinct().join(later, "rank", "left_anti"), "hubs")
        met = _pairs(open_.join(hubs, "rank", "left_semi"), open_)
        now = stored(_verified(met, nodes, cfg).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("witness")), "gone")
        gone = now if gone is None else gone.unionByName(now)
        # Hubs are decided: what is open has been compared with them.
        open_ = stored(open_.join(hubs, "rank", "left_anti").join(now.select(F.col("node").alias("rank")), "rank", "left_anti"), "open")
    rest = greedy(_verified(_pairs(open_, open_), nodes, cfg))
    if gone is None:
        return rest
    # Of the rest a node may be similar to a smaller hub only if the hub's round dropped it, so rest needs no second look; hubs' nodes do.
    found = stored(gone.unionByName(rest), "dropped")
    kept = lean.join(found.select(F.col("node").alias("rank")), "rank", "left_anti")
    told = gone.withColumnRenamed("node", "rank")
    a, b = kept.alias("a"), lean.join(told, "rank").alias("b")
    below = a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.rank") < F.col("b.witness"))).select(F.col("a.rank").alias("u"), F.col("b.rank").alias("v")).distinct()
    smaller = _verified(below, nodes, cfg).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("w"))
    return found.join(smaller, "node", "left").select("node", F.coalesce("w", "witness").alias("witness"))


#: So many open edges are settled in one task instead of in further rounds.
SETTLE_EDGES = 200_000


def greedy(edges: DataFrame) -> DataFrame:
    """(node, witness) of what a walk in rank order would drop, each compared with kept nodes only.

    Rounds settle it in parallel: a node without undecided smaller neighbours is kept, its larger
    neighbours are dropped; the smallest kept neighbour is the witness. Every round decides some nodes; once
    SETTLE_EDGES edges or fewer are open, one task walks them in order, so long chains need no long rounds.
    """
    edges = stored(edges, "edges")
    open_, dropped = edges, None
    while left := open_.count():
        if left <= SETTLE_EDGES:
            gone, open_ = _walk(open_), open_.limit(0)
        else:
            kept = stored(open_.select(F.col("u").alias("k")).distinct().join(open_.select(F.col("v").alias("k")).distinct(), "k", "left_anti"), "kept")
            gone = stored(open_.join(kept, F.col("u") == F.col("k")).groupBy(F.col("v").alias("node")).agg(F.min("u").alias("witness")), "gone")
            lost = gone.select("node")
            open_ = open_.join(lost, F.col("u") == F.col("node"), "left_anti").join(lost, F.col("v") == F.col("node"), "left_anti").join(kept, F.col("u") == F.col("k"), "left_anti")
            open_ = stored(open_, "open")
        dropped = gone if dropped is None else dropped.unionByName(gone)
    return dropped if dropped is not None else edges.select(F.col("v").alias("node"), F.col("u").alias("witness")).limit(0)


def _walk(open_: DataFrame) -> DataFrame:
    """node, witness of at most SETTLE_EDGES edges, in one task that reads them by larger and then smaller end. Ranks may be of any type that has an order."""

    def run(frames):
        gone, at, found = set(), None, None
        for frame in frames:
            rows = []
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist()):
                if v != at:
                    at, found = v, None
                if found is None and u not in gone:
                    found = u
                    gone.add(v)
                    rows.append((v, u))
            yield pd.DataFrame(rows, columns=["node", "witness"])

    kind = open_.schema["u"].dataType.simpleString()
    named = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).alias(c)
    back = lambda c: F.from_json(c, f"x {kind}")["x"].alias(c)
    in_order = open_.repartition(1).sortWithinPartitions("v", "u").select(named("u"), named("v"))
    return in_order.mapInPandas(run, "node string, witness string").select(back("node"), back("witness"))


def decide(records: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """DED1: records (row_idx, type, query, target) with decision (kept, exact, similar) and the row_idx of the kept witness.

    Copies of a record dropped as similar count as similar, as only kept records are compared with.
    """
    cfg = cfg or DedupConfig()
    r = records.withColumn("canonical", X.canonicalize_query(F.col("query"))).withColumn("rank", keep_rank(F.col("type"), F.col("target"), F.col("query"), F.col("row_idx")))
    r = stored(r.select("row_idx", "type", "canonical", "rank"), "canonical")
    reps = r.filter("canonical <> ''").groupBy("canonical").agg(F.min("rank").alias("rep"))
    out = r.join(reps, "canonical", "left")
    if not cfg.similar:
        return _decided(out.withColumn("witness", F.lit(None).cast(r.schema["rank"].dataType)))
    tokens = X.query_tokens(F.col("canonical"))
    nodes = reps.select(F.col("rep").alias("rank"), "canonical", X.number_signature(F.col("canonical")).alias("numbers"), F.size(tokens).alias("n_tokens"), X.feature_set(tokens).alias("features"))
    nodes = nodes.withColumn("sig", S.query_simhash64(F.col("canonical")))
    gone = dropped_nodes(stored(nodes, "nodes"), cfg)
    return _decided(out.join(gone, F.col("rep") == F.col("node"), "left"))


def _decided(rows: DataFrame) -> DataFrame:
    decision = F.when(F.col("witness").isNotNull(), "similar").when(F.col("rep").isNotNull() & (F.col("rep") != F.col("rank")), "exact").otherwise("kept")
    witness = F.when(F.col("witness").isNotNull(), F.col("witness.i")).when(F.col("rep") != F.col("rank"), F.col("rep.i"))
    return rows.select("row_idx", "type", "canonical", decision.alias("decision"), witness.alias("kept_idx"), "rank")


def deduplicate(records: DataFrame, cfg: DedupConfig | None = None) -> DataFrame:
    """The kept records; order by row_idx for the original order."""
    return records.join(decide(records, cfg).filter("decision = 'kept'").select("row_idx"), "row_idx", "left_semi")


def report(decided: DataFrame) -> DataFrame:
    """AGG16: counts by type, before and after, in one pass."""
    return decided.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("UNKNOWN")).alias("type")).agg(F.count("*").alias("before"), F.count_if(F.col("decision") == "kept").alias("after"), F.count_if(F.col("decision") == "exact").alias("dropped_exact"), F.count_if(F.col("decision") == "similar").alias("dropped_similar"))


def examples(decided: DataFrame, most: int = 12) -> DataFrame:
    """The first drops in rank order."""
    return decided.filter("decision <> 'kept'").orderBy("rank").limit(most).select("decision", F.col("row_idx").alias("dropped_idx"), F.col("type").alias("dropped_type"), "kept_idx")


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    """WIN9: the first `most` rows of each group; the limit is applied before the shuffle too."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


#: The Jaccard threshold of near_pairs as a fraction of integers, so that the border is exact.
PAIR_THRESHOLD = (90, 100)
#: Tokens ordered last by count; others are ordered by hash.
COMMON_MOST = 250_000


def _pack(rare: np.ndarray, ranks: np.ndarray) -> bytes:
    """A set as bytes: hashes of tokens without a rank, then the steps between the ranks, byte by byte of all so that they compress."""
    steps = np.diff(ranks, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(rare).to_bytes(4, "little") + rare.astype("<i8").tobytes() + zlib.compress(steps.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ranks of a set, both in order."""
    end = 4 + 8 * int.from_bytes(packed[:4], "little")
    steps = np.frombuffer(zlib.decompress(packed[end:]), np.uint8).reshape(4, -1).T
    return np.frombuffer(packed[4:end], "<i8"), np.cumsum(np.ascontiguousarray(steps).view("<u4").ravel().astype(np.int64))


def _packed(sets: DataFrame, ranked: np.ndarray) -> DataFrame:
    """id, n, packed: the sets (id, t) in one global order of tokens: those not in ranked by hash, then ranked ones by place, rare ones first."""
    by = np.argsort(ranked)
    shared = sets.sparkSession.sparkContext.broadcast((ranked[by], by))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in batches:
            per = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            h, r = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(per)), per)
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            code = np.where(known[at] == h, rank[at], -1) if len(known) else np.full(len(h), -1)
            place = np.lexsort((h, code, r))
            h, code, ends = h[place], code[place], np.cumsum(per)
            rare = ends - per + np.bincount(r[code < 0], minlength=len(per))
            packed = [_pack(h[low:mid], code[mid:high]) for low, mid, high in zip(ends - per, rare, ends)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(per), pa.array(packed, pa.binary())], names=["id", "n", "packed"])

    return sets.select("id", "t").mapInArrow(run, "id long, n long, packed binary")


def _postings(nodes: DataFrame) -> DataFrame:
    """key, u, n, left: the first n - ceil(t n) + 1 tokens of every set, rare ones first, and how many tokens stand from the key on."""
    t, of = PAIR_THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            own = n - -(-t * n // of) + 1
            keys = np.concatenate([np.concatenate(_unpack(p))[:k] for p, k in zip(batch.column(2).to_pylist(), own)] or [np.zeros(0, np.int64)])
            u, size = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), own), np.repeat(n, own)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(own) - own, own)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, u, size, size - pos)], names=["key", "u", "n", "left"])

    return nodes.select("u", "n", "packed").mapInArrow(run, "key long, u long, n long, left long")


#: Longs of a set's sketch: by 64 bits each whether the tokens of a bit are odd in number.
SKETCH = 4


def _sketches(nodes: DataFrame) -> DataFrame:
    """u, n, sketch: sets that differ in d tokens differ in d bits of their sketches at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.concatenate(_unpack(p)) for p in batch.column(2).to_pylist()]
            r = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
            bit = (np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * SKETCH)
            odd = (np.bincount(r * 64 * SKETCH + bit.astype(np.int64), minlength=len(codes) * 64 * SKETCH) & 1).astype(np.uint8)
            longs = np.packbits(odd).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(np.arange(0, len(longs) + 1, SKETCH, dtype=np.int32), longs)], names=["u", "n", "sketch"])

    return nodes.select("u", "n", "packed").mapInArrow(run, "u long, n long, sketch array<long>")


def _may_reach(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches leave the threshold in reach: a pair that reaches it differs in (of - t) / (of + t) of both sizes together at most."""
    t, of = PAIR_THRESHOLD
    flat = stored(_sketches(nodes).select("u", "n", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)]), "sketches")
    named = lambda end: flat.select(F.col("u").alias(end), *[F.col(c).alias(end + c) for c in flat.columns[1:]])
    differ = reduce(add, [F.bit_count(F.col(f"us{i}").bitwiseXOR(F.col(f"vs{i}"))) for i in range(SKETCH)])
    return pairs.join(named("u"), "u").join(named("v"), "v").filter((of + t) * differ <= (of - t) * (F.col("un") + F.col("vn"))).select("u", "v")


def _links(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """u, v, jaccard of the pairs that reach the threshold, by their whole sets."""
    t, of = PAIR_THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lru_cache(1024)(_unpack)  # the pairs of a set come one after another
        for batch in batches:
            both = [(whole(a), whole(b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            i = np.array([sum(len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)) for a, b in both], np.int64)
            n = np.array([sum(map(len, a + b)) for a, b in both], np.int64) - i
            link = pa.array(of * i >= t * n)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i / n)], names=["u", "v", "jaccard"])
            yield out.filter(link)

    whole = lambda end: nodes.select(F.col("u").alias(end), F.col("packed").alias(f"{end}s"))
    return pairs.join(whole("u"), "u").join(whole("v"), "v").select("u", "v", "us", "vs").mapInArrow(run, "u long, v long, jaccard double")


def near_pairs(rows: DataFrame, id_col: str, tokens: Column) -> DataFrame:
    """SET1 over JOIN6: (a, b, jaccard) of all ids a < b whose sets of tokens have a Jaccard of PAIR_THRESHOLD or more.

    Exact, without a cap: two such sets share a token among the first n - ceil(t n) + 1 of each in one
    global order, commonest last; a key is refused only if what is left from it on cannot reach the
    threshold, which never holds for a pair's first common key. Pairs are compared by short sketches, which refuse none that reaches it, before
    whole sets are brought together. Equal sets are one node for this and given as pairs again at the end. Tokens are told apart by
    64-bit hashes, common ones by their place in the order, so that sets are small where they are stored and shuffled; sets without tokens pair with nothing.
    """
    t, of = PAIR_THRESHOLD
    hashes = F.coalesce(F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x))), F.array().cast("array<long>"))
    sets = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), hashes.alias("t"))
    # Neither a filter nor a plain explode stands on t: the optimizer would copy its definition below and work the tokens out again.
    counted = sets.select(F.explode_outer("t").alias("k")).groupBy("k").agg(F.count("*").alias("n")).filter("n > 1 AND k IS NOT NULL")
    common = counted.orderBy(F.desc("n"), "k").limit(COMMON_MOST).toPandas()  # at most COMMON_MOST rows
    sets = stored(_packed(sets, common["k"].to_numpy(np.int64)[::-1]).filter("n > 0").withColumn("node", F.md5("packed")), "sets")
    members = sets.select("node", "id").distinct()
    nodes = stored(sets.groupBy("node").agg(F.min("id").alias("u"), F.first("n").alias("n"), F.first("packed").alias("packed")), "nodes")
    listed = stored(_postings(nodes), "postings")
    a, b = listed.alias("a"), listed.alias("b")
    fits = (of * F.least("a.n", "b.n") >= t * F.greatest("a.n", "b.n")) & ((of + t) * F.least("a.left", "b.left") >= t * (F.col("a.n") + F.col("b.n")))
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.u") < F.col("b.u")) & fits).select(F.col("a.u").alias("u"), F.col("b.u").alias("v")).distinct()
    links = _links(_may_reach(pairs, nodes), nodes)
    of_node = members.join(nodes.select("node", "u"), "node").select("u", "id")
    x, y = of_node.select("u", F.col("id").alias("x")), of_node.select(F.col("u").alias("v"), F.col("id").alias("y"))
    apart = links.join(x, "u").join(y, "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    same = x.join(y, (F.col("u") == F.col("v")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("jaccard"))
    return apart.filter("a < b").unionByName(same)
