"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by scaled forward recursion.

Tokens of a text are its words (maximal runs of bytes other than ASCII white space, A-Z in lower case) and one
end. The model has STATES states, a start vector, a transition matrix and a row of emissions for every word of
the training texts, however many there are:

    P(w | s) = ((1 - MIX) n(s, w) N / n(s) + MIX c(w) + 1) / (N + V + 1)

with n the expected counts of Baum-Welch, c(w) the count of w, N all training tokens and V the distinct ones; over
the V words and one unknown token it sums to 1, and an unknown token gets 1 / (N + V + 1) in every state. Words
seen less than OWN times share their expected counts with all words seen as often.

How it runs: texts are gathered to chunks of about CHUNK bytes with a dictionary each, so of a word that is
everywhere a chunk sends one row. Chunks are written once, bucketed by chunk, and never shuffled. Words are counted over all
chunks, and each chunk gets the counts of its words once. In every round the current expected counts of a chunk's words come to it
(join by word, shuffle by chunk), the chunk runs forward and backward over training texts, and its expected counts are
summed by word. The first PARTS rounds look at every PARTS-th chunk each, all chunks in turn (incremental
expectation maximisation), the last round at all of them. A corpus of fewer chunks than PARTS has fewer rounds. Expected counts are integers in units of 1 / UNIT, so sums do not depend on the order of tasks. The driver sees
start, transitions and totals only.

Long texts are cut into segments of SEGMENT tokens: a segment's transfer matrix is computed for all start states at
once, the matrices are chained, and with its true start (and end) vector each segment is worked on by itself. This is
the same recursion, exactly; memory doesn't grow with a text's length beyond its codes.

Starting point: every word leans to states by a hash of it, transitions stay in a state with STAY.

Edge cases: null and empty texts are one token, the end; rows repeat as given (and count as often in training); null ids
are kept, a null training mark counts as false; without any training text every token is unknown (N = V = 0); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, materialize, remove, scratch_path, shuffle_cleanup

STATES = 8
#: Rounds over a part of the chunks each (every PARTS-th one), one part after the other, before the last round over all of them.
PARTS = 4
#: Words seen at least so often have expected counts of their own.
OWN = 16
MIX = 0.02
STAY = 0.98
#: Least count of a transition or start, so that none is impossible.
FLOOR = 1.0
UNIT = 1 << 16
#: A word's shares by state are handed to the chunks in units of 1 / SHARE (16 bits, four in a long).
SHARE = (1 << 16) - 1
#: Text bytes a chunk (a longer text is a chunk of its own), tokens a segment, tokens worked on at once.
CHUNK = 16 << 20
SEGMENT = 8192
GROUP = 1 << 18
END = b" "
CODED = "chunk long, ids array<long>, train binary, sizes binary, codes binary, words array<binary>, counts array<long>"
PACKED = "chunk long, counts binary, own binary, numbers array<long>, c array<long>, firsts array<long>"
#: Buckets at most; below it there is one per CHUNK of text.
BUCKETS = 50_000
SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass
class Model:
    """Start vector, transitions, expected tokens by state, and what words seen less than OWN times share (by count and state)."""

    start: np.ndarray
    moves: np.ndarray
    tokens: int
    words: int
    by_state: np.ndarray
    shared: np.ndarray = field(default_factory=lambda: np.zeros((OWN, STATES)))

    def emissions(self, count: np.ndarray, expected: np.ndarray) -> np.ndarray:
        """P(w | s), states by words, from the words' counts and expected counts (states by words)."""
        rare = count < OWN
        expected = np.where(rare, self.shared[np.where(rare, count, 0)].T, expected)
        used = self.by_state > 1 / UNIT  # a state without tokens emits as the counts say
        own = np.where(used[:, None], expected * (self.tokens / np.where(used, self.by_state, 1))[:, None], count)
        return ((1 - MIX) * own + MIX * count + 1) / (self.tokens + self.words + 1)


def _layout(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences (longest first) step by step: token positions, first place of each step, and the place of the token before for all places after the first step."""
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
    first = np.concatenate([[0], np.cumsum(active)])
    step = np.repeat(np.arange(len(active)), active)
    seq = np.arange(first[-1]) - first[step]
    return starts[seq] + step, first, np.arange(first[1], first[-1]) - active[step[first[1] :] - 1]


def _transfers(e: np.ndarray, first: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """For every sequence the matrix from its first predicted states to its last states, up to a factor. e: states by places."""
    k, onward = len(moves), np.ascontiguousarray(moves.T)
    x = np.repeat(np.eye(k)[:, :, None], first[1], 2)
    for t in range(len(first) - 1):
        a, b = first[t], first[t + 1]
        now = (onward @ x[:, :, : b - a] if t else x[:, :, : b - a]) * e[:, a:b]
        x[:, :, : b - a] = now / now.sum((0, 1))
    return x.transpose(2, 0, 1)


def _forward(e: np.ndarray, first: np.ndarray, begin: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """States of each token given all up to it, and the factors taken out; states by places."""
    alpha, scale, p, onward = np.empty_like(e), np.empty(e.shape[1]), begin, np.ascontiguousarray(moves.T)
    for t in range(len(first) - 1):
        a, b = first[t], first[t + 1]
        x = p[:, : b - a] * e[:, a:b]
        s = x.sum(0)
        x /= s
        alpha[:, a:b] = x
        scale[a:b] = s
        p = onward @ x
    return alpha, scale


def _backward(e: np.ndarray, first: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """What follows each token, by state, up to a factor a token."""
    beta = np.empty_like(e)
    beta[:, first[-2] :] = end[:, : first[-1] - first[-2]]
    for t in range(len(first) - 3, -1, -1):
        a, b, c = first[t], first[t + 1], first[t + 2]
        y = moves @ (e[:, b:c] * beta[:, b:c])
        y /= y.sum(0)
        beta[:, a : a + c - b] = y
        beta[:, a + c - b : b] = end[:, c - b : b - a]
    return beta


@dataclass
class _Segments:
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    #: Predicted states before, states of the token before (0 at a text's start), and what follows the last token.
    begin: np.ndarray
    before: np.ndarray
    after: np.ndarray


def _cut(codes: np.ndarray, sizes: np.ndarray, emit: np.ndarray, m: Model, segment: int) -> _Segments:
    k = len(m.start)
    pieces = -(-sizes // segment)
    text = np.repeat(np.arange(len(sizes)), pieces)
    place = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    offset = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    start = offset[text] + place * segment
    size = np.minimum(segment, sizes[text] - place * segment)
    s = _Segments(start, size, text, np.tile(m.start, (len(text), 1)), np.zeros((len(text), k)), np.ones((len(text), k)))
    long = np.flatnonzero(pieces[text] > 1)
    matrices = np.empty((len(text) if len(long) else 0, k, k)) if len(long) else None
    for part in _groups(size[long], GROUP // k):
        rows = long[part]
        at, first, _ = _layout(start[rows], size[rows])
        matrices[rows] = _transfers(emit[:, codes[at]], first, m.moves)
    for i in long:
        if place[i]:
            last = s.begin[i - 1] @ matrices[i - 1]
            s.before[i] = last / last.sum()
            s.begin[i] = s.before[i] @ m.moves
    for i in long[::-1]:
        if place[i]:
            ahead = m.moves @ (matrices[i] @ s.after[i])
            s.after[i - 1] = ahead / ahead.sum()
    return s


def _groups(size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Rows with about `most` tokens in all, the longest first."""
    order = np.argsort(-size, kind="stable")
    total = np.cumsum(size[order])
    i = 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")))
        yield order[i:j]
        i = j


def likelihood(codes: np.ndarray, sizes: np.ndarray, emit: np.ndarray, m: Model, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of every text; texts lie one after another in codes, and none is empty. emit: states by words."""
    logs, s = np.zeros(len(codes)), _cut(codes, sizes, emit, m, segment)
    for rows in _groups(s.size, GROUP):
        at, first, _ = _layout(s.start[rows], s.size[rows])
        logs[at] = np.log10(_forward(np.take(emit, codes[at], 1), first, s.begin[rows].T, m.moves)[1])
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def expect(codes: np.ndarray, sizes: np.ndarray, emit: np.ndarray, m: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and (state, word) over the texts."""
    k, n_words = emit.shape
    starts, moves, words = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_words))
    s = _cut(codes, sizes, emit, m, segment)
    for rows in _groups(s.size, GROUP):
        at, first, before = _layout(s.start[rows], s.size[rows])
        word = codes[at]
        e = np.take(emit, word, 1)
        alpha, _ = _forward(e, first, s.begin[rows].T, m.moves)
        gamma = alpha * _backward(e, first, s.after[rows].T, m.moves)
        gamma /= gamma.sum(0)
        n = first[1]
        previous = np.take(alpha, before, 1)
        moves += previous @ (gamma[:, n:] / (m.moves.T @ previous)).T
        inner = s.before[rows].any(1)
        moves += s.before[rows][inner].T @ (gamma[:, :n].T[inner] / s.begin[rows][inner])
        starts += gamma[:, :n].T[~inner].sum(0)
        for i in range(k):
            words[i] += np.bincount(word, gamma[i], n_words)
    return starts, moves * m.moves, words


class _Numbers(dict):
    """Words numbered in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _coded(docs: DataFrame) -> DataFrame:
    """CODED of docs (id, text, train): chunks of texts as numbers of words of the chunk's dictionary."""

    def row(chunk: int, ids: list, train: list, sizes: list, codes: array, words: _Numbers) -> pa.RecordBatch:
        size, own = np.array(sizes, np.int64), np.array(train, bool)
        counts = np.bincount(np.frombuffer(codes, np.int32)[np.repeat(own, size)], minlength=len(words))
        values = [pa.array([chunk]), pa.array([ids], pa.list_(pa.int64())), pa.array([own.tobytes()]), pa.array([size.tobytes()]), pa.array([_squeeze(codes)], pa.binary()), pa.array([list(words)], pa.list_(pa.binary())), pa.ListArray.from_arrays([0, len(words)], counts)]
        return pa.RecordBatch.from_arrays(values, names=_names(CODED))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 24, 0
        ids, train, sizes, codes, words = [], [], [], array("i"), _Numbers()
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or b""
                if size and size + len(text) > CHUNK:
                    yield row(chunk, ids, train, sizes, codes, words)
                    chunk, size = chunk + 1, 0
                    ids, train, sizes, codes, words = [], [], [], array("i"), _Numbers()
                before = len(codes)
                codes.extend(map(words.__getitem__, text.lower().split()))
                codes.append(words[END])
                ids.append(batch.column(0)[i].as_py())
                train.append(bool(batch.column(2)[i].as_py()))
                sizes.append(len(codes) - before)
                size += len(text) + 1
        if ids:
            yield row(chunk, ids, train, sizes, codes, words)

    return docs.mapInArrow(work, CODED)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _squeeze(codes: array) -> bytes:
    """Compressed numbers, all lowest bytes first: their number, then the bytes."""
    planes = np.frombuffer(codes, np.uint8).reshape(-1, 4).T.tobytes()
    return len(codes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unsqueeze(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view(np.int32).ravel()


def _pack(of: pa.Table) -> pa.Table:
    """PACKED: the counts of a chunk's words over all training texts, numbers and counts of those with expected counts of their own, and what the chunk adds to the totals."""
    at, c, number = (of[name].to_numpy() for name in ("local", "c", "id"))
    chunk = of["chunk"][0].as_py()
    counts = np.zeros(at.max() + 1, np.int64)
    counts[at] = c
    own = np.flatnonzero(c >= OWN)
    own = own[np.argsort(at[own])]
    first = (number == (chunk << 24) + at.astype(np.int64)) & (c > 0)
    firsts = np.bincount(np.minimum(c[first], OWN), minlength=OWN + 1)
    longs = lambda x: pa.array([x.tolist()], pa.list_(pa.int64()))
    return pa.table([[chunk], pa.array([counts.tobytes()]), pa.array([at[own].astype(np.int32).tobytes()]), longs(number[own]), longs(c[own]), longs(firsts)], names=_names(PACKED))


def _unpack(row: pa.Table, of: pa.Table, training: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and sizes of the texts (only training ones for training), counts and expected counts of the words of one chunk, and which words have their own."""
    binary = lambda name, kind: np.frombuffer(row[name][0].as_py(), kind)
    codes, sizes, count, own = _unsqueeze(row["codes"][0].as_py()), binary("sizes", np.int64), binary("counts", np.int64), binary("own", np.int32)
    expected = np.zeros((STATES, len(count)))
    at, seen = own[of["place"].to_numpy()], of["seen"].to_numpy()
    for s in range(STATES):
        expected[s, at] = (of[f"w{s // 4}"].to_numpy() >> 16 * (s % 4) & 0xFFFF) * (seen / SHARE)
    if training:
        train = binary("train", bool)
        codes, sizes = codes[np.repeat(train, sizes)], sizes[train]
    return codes, sizes, count, expected, own


def train_and_score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """SCORED and train_tokens of every row, by a model trained on the rows where train holds."""
    spark = docs.sparkSession
    given = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").cast("binary").alias("text"), train.alias("train"))
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(BUCKETS, max(spark.sparkContext.defaultParallelism, size // CHUNK))
    tables: list[tuple[str, str]] = []

    def bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
        tables.append((f"{name}_{uuid.uuid4().hex}", scratch_path(spark, name)))
        with shuffle_cleanup(spark):
            df.write.bucketBy(buckets, by).sortBy(by).option("path", tables[-1][1]).saveAsTable(tables[-1][0])
        return spark.table(tables[-1][0])

    counts = None
    try:
        # Every task writes its chunks to their buckets itself, so texts are never shuffled.
        coded = bucketed(_coded(given), "hmm_texts", "chunk")
        local = coded.select("chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w"))
        # The place of a word's first row is its number: exact, and shorter than the word. A word has a row a chunk at most.
        local = local.select(F.shiftleft("chunk", 24).bitwiseOR(F.col("local").cast("long")).alias("number"), "w.words", "w.counts")
        every, met = Window.partitionBy("words"), F.col("counts") > 0
        known = local.select("number", F.sum("counts").over(every).alias("c"), F.min(F.when(met, F.col("number"))).over(every).alias("id"))
        place = [F.shiftright("number", 24).alias("chunk"), F.col("number").bitwiseAND((1 << 24) - 1).cast("int").alias("local")]
        # Only words with counts of their own and first rows need a number.
        known = known.select(*place, "c", F.when((F.col("c") >= OWN) | (F.col("id") == F.col("number")), F.col("id")).otherwise(-1).alias("id"))
        packed = bucketed(known.groupBy("chunk").applyInArrow(_pack, PACKED), "hmm_counts", "chunk")
        firsts = [F.coalesce(F.sum(F.col("firsts")[c]), F.lit(0)).alias(f"f{c}") for c in range(OWN + 1)]
        total = packed.agg(*firsts).first()
        n = coded.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
        words, rare = sum(total), {c: total[f"f{c}"] for c in range(1, OWN)}
        own = bucketed(packed.select("chunk", F.posexplode(F.arrays_zip("numbers", "c")).alias("place", "w")).select("chunk", "place", F.col("w.numbers").alias("id"), F.col("w.c").alias("c")).repartition(buckets, "id"), "hmm_own", "id")
        texts = coded.select("chunk", "ids", "train", "sizes", "codes").join(packed.select("chunk", "counts", "own", "numbers"), "chunk")
        part = F.pmod(F.shiftright("chunk", 24) + F.col("chunk").bitwiseAND((1 << 24) - 1), F.lit(parts))

        def within(i: int, of: DataFrame) -> tuple[DataFrame, DataFrame]:
            return texts.filter(part == i), _parameters(own.filter(part == i), of)

        m = Model(np.full(STATES, 1 / STATES), np.full((STATES, STATES), (1 - STAY) / max(1, STATES - 1)), n, words, np.full(STATES, max(1, n) / STATES))
        np.fill_diagonal(m.moves, STAY)
        for c in rare:
            m.shared[c] = c / STATES
        counts = _leaning(own.groupBy("id").agg(F.max("c").alias("c")))
        for chosen in [[i] for i in range(parts)] + [list(range(parts))] if n else []:
            # A part at a time also in the last round, so that only a part's shuffle lies on disk at once.
            steps = [materialize(_round(*within(i, counts), m), "hmm-part") for i in chosen]
            now = steps[0] if len(steps) == 1 else materialize(_summed(reduce(DataFrame.unionByName, steps)), "hmm-expected")
            discard(*(t for t in steps if t is not now))
            after = _next_model(m, now, rare)
            if not after.by_state.any():  # a corpus of so few chunks that this part has none
                discard(now)
                continue
            if hasattr(counts, "scratch"):
                discard(counts)
            counts, m = now, after
        model = m

        def score(chunk: pa.Table, of: pa.Table) -> pa.Table:
            codes, sizes, count, expected, _ = _unpack(chunk, of)
            first = np.cumsum(sizes) - sizes
            base = np.log10((count + 1) / (model.tokens + model.words + 1))[codes]
            sums = [np.add.reduceat(x, first) for x in ((count > 0)[codes].astype(np.int64), base)]
            found = likelihood(codes, sizes, model.emissions(count, expected), model)
            return pa.table([chunk["ids"].combine_chunks().flatten(), sizes, *sums, found], names=_names(SCORED))

        def scored(i: int) -> DataFrame:
            some, parameters = within(i, counts)
            done = some.drop("numbers").groupBy("chunk").cogroup(parameters.groupBy("of")).applyInArrow(score, SCORED)
            return materialize(done.withColumn("train_tokens", F.lit(n).cast("long")), "hmm-scores")

        return reduce(DataFrame.unionByName, [scored(i) for i in range(parts)])
    finally:
        discard(counts if hasattr(counts, "scratch") else None)
        for name, path in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(spark, path)


def _leaning(words: DataFrame) -> DataFrame:
    """The counts that training starts from: every word leans to some states by a hash of its number."""
    lean = [F.pow(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1 << 20)) / (1 << 20), F.lit(6)) + 0.05 for s in range(STATES)]
    total = sum(lean[1:], lean[0])
    return words.filter(F.col("c") >= OWN).select("id", *((F.col("c") * x / total * UNIT).cast("long").alias(f"n{s}") for s, x in enumerate(lean)))


def _parameters(own: DataFrame, counts: DataFrame) -> DataFrame:
    """of (the chunk), place, seen (the expected count) and its shares by state, four a long in units of 1 / SHARE, of every word of the chunks that has its own."""
    seen = sum([F.col(f"n{s}") for s in range(1, STATES)], F.col("n0"))
    share = lambda s: F.when(F.col("t") > 0, F.round(F.col(f"n{s}") / F.col("t") * SHARE)).otherwise(0).cast("long")
    packed = [sum([F.shiftleft(share(4 * w + i), 16 * i) for i in range(1, 4)], share(4 * w)).alias(f"w{w}") for w in range(STATES // 4)]
    lean = counts.filter("id >= 0").withColumn("t", seen).select("id", (F.col("t") / UNIT).cast("float").alias("seen"), *packed)
    return own.select("id", F.col("chunk").alias("of"), "place").join(lean, "id").select("of", "place", "seen", *(f"w{w}" for w in range(STATES // 4)))


def _round(texts: DataFrame, parameters: DataFrame, m: Model) -> DataFrame:
    """Expected counts by word number; below 0: -1 starts, -2 - s moves from s, -2 - STATES all tokens, -3 - STATES - c words seen c times."""
    names = [f"n{s}" for s in range(STATES)]

    def expectation(chunk: pa.Table, of: pa.Table) -> pa.Table:
        codes, sizes, count, expected, own = _unpack(chunk, of, True)
        starts, moves, words = expect(codes, sizes, m.emissions(count, expected), m)
        rare = [words[:, count == c].sum(1) for c in range(OWN)]
        columns = np.concatenate([np.array([starts, *moves, words.sum(1), *rare]).T, words[:, own]], 1)
        ids = np.concatenate([-1 - np.arange(2 + STATES + OWN), chunk["numbers"].combine_chunks().flatten().to_numpy()])
        columns = np.rint(columns * UNIT).astype(np.int64)
        met = columns.any(0)
        return pa.table([ids[met], *columns[:, met]], names=["id", *names])

    found = texts.drop("ids").groupBy("chunk").cogroup(parameters.groupBy("of")).applyInArrow(expectation, "id long, " + ", ".join(f"{n} long" for n in names))
    return _summed(found)


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("id").agg(*(F.sum(f"n{s}").alias(f"n{s}") for s in range(STATES)))


def _next_model(m: Model, counts: DataFrame, rare: dict[int, int]) -> Model:
    rows = {r["id"]: np.array(r[1:], float) / UNIT for r in counts.filter("id < 0").collect()}  # 2 + STATES + OWN rows
    none = np.zeros(STATES)
    start = rows.get(-1, none) + FLOOR
    moves = np.array([rows.get(-2 - s, none) for s in range(STATES)]) + FLOOR
    shared = np.array([rows.get(-3 - STATES - c, none) / rare.get(c, 1) for c in range(OWN)])
    return Model(start / start.sum(), moves / moves.sum(1)[:, None], m.tokens, m.words, rows.get(-2 - STATES, none), shared)
