"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Words, and beginnings of words of PREFIXES bytes, that labelled training rows show to be much more
   frequent in toxic texts are mined (pre-aggregated per task; the LEXICON best of either stay). The words
   are dealt into VOTERS lexicon voters, the strongest words one each, the weak rest sharing the last, the
   beginnings likewise into STEMS stem voters, which also know words that training never saw. Pattern voters
   look at repeats, density and the absence of such words, and at the text itself: shouting, doubled signs,
   and words said over and over.
2. A generative label model explains the votes without looking at labels: expectation
   maximisation gives each voter's chance of each vote under either class; correlations that the
   classes leave unexplained are measured between all pairs of voters, and a voter's weight is
   divided by one plus the sum of its positive correlations.
3. A logistic regression is trained on the posterior labels over per-word counts and patterns.

Fitting reads about SAMPLE_ROWS labelled rows at most (a documented bound; rows chosen by a hash of
the id). Scoring reads every whole text.

Edge cases: null or empty text has no words and gets the score of a text without evidence; rows
repeat as given; labels that are null are not used, several labels of one id count as toxic if any
does; without any labelled row of both classes every score is 0. Only id, text and label are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import chunks, hash_words, mix, scan_words, text_buffers

SAMPLE_ROWS = 20_000
#: Text bytes worked on at once.
PIECE = 1 << 20
LEXICON = 64
VOTERS = 12
STEMS = 4
#: Beginnings count if there are two at least and so many a word: clean texts hold one now and then.
STEM_RATE = 0.01
#: Bytes of the beginnings of words that are looked at.
PREFIXES = (5, 6, 7, 8)
#: A mined word is in at least so many toxic sample texts.
SUPPORT = 5
#: and at least so many times likelier in a toxic text than in another.
LIFT = 8.0
_TRIM = np.zeros(256, bool)
_TRIM[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
SCORED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])


_SIGN = np.zeros(256, bool)
_SIGN[list(b"!?#$%&*")] = True
_CLASSES = np.zeros((256, 3), np.int32)
_CLASSES[65:91, 0] = 1
_CLASSES[65:91, 1] = _CLASSES[97:123, 1] = 1


def _trimmed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes of lower-cased words without ASCII signs at their ends, then of the beginnings of longer words; their rows; the number of words."""
    starts, ends, rows = scan_words(data, offsets)
    for _ in range(4):
        cut = (ends > starts) & _TRIM[data[np.minimum(starts, len(data) - 1)]] if len(data) else np.zeros(0, bool)
        starts = starts + cut
        cut = (ends > starts) & _TRIM[data[ends - 1]] if len(data) else cut
        ends = ends - cut
    full = ends > starts
    starts, ends, rows = starts[full], ends[full], rows[full]
    hashes, at = [hash_words(data, starts, ends, lower=True)], [rows]
    for k in PREFIXES:
        long = ends - starts > k
        hashes.append(mix(hash_words(data, starts[long], starts[long] + k, lower=True) + np.uint64(k)) | _STEM)
        at.append(rows[long])
    hashes[0] = hashes[0] & ~_STEM
    return np.concatenate(hashes), np.concatenate(at), len(rows)


#: Set in the hashes of beginnings, clear in those of words.
_STEM = np.uint64(1 << 62)


def _per_text(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row the counts of the lexicon's (sorted) hashes, and what the patterns read: words, capitals, letters (A-Z), doubled signs, words that repeat the one before."""
    words, rows, whole = _trimmed_words(data, offsets)
    n = len(offsets) - 1
    own, own_rows = words[:whole], rows[:whole]
    again = (own[1:] == own[:-1]) & (own_rows[1:] == own_rows[:-1])
    ends = np.cumsum(np.concatenate([np.zeros((1, 3), np.int64), _CLASSES[data]]), 0)[offsets] if len(data) else np.zeros((n + 1, 3), np.int64)
    upper, letters, _ = np.diff(ends, axis=0).T
    sign = _SIGN[data]
    twice = np.concatenate([[0], np.cumsum(sign[1:] & sign[:-1])])
    doubled = twice[np.maximum(offsets[1:] - 1, 0)] - twice[np.minimum(offsets[:-1], max(0, len(data) - 1))] if len(data) else np.zeros(n, np.int64)
    total = np.stack([np.bincount(own_rows, minlength=n), upper, letters, np.maximum(doubled, 0), np.bincount(own_rows[1:][again], minlength=n)], 1)
    counts = np.zeros((n, len(lexicon)), np.float32)
    if len(lexicon) and len(words):
        at = np.minimum(np.searchsorted(lexicon, words), len(lexicon) - 1)
        hit = lexicon[at] == words
        np.add.at(counts, (rows[hit], at[hit]), 1)
        stems = lexicon & _STEM != 0
        met = counts[:, stems].sum(1)
        counts[np.ix_((met < 2) | (met < STEM_RATE * total[:, 0]), stems)] = 0
    return counts, total


def votes_of(counts: np.ndarray, total: np.ndarray, shards: np.ndarray) -> np.ndarray:
    """Votes in {-1, 0, 1}: a lexicon voter per shard (stems after words), then patterns."""
    words, upper, letters, doubled, again = total.T
    out = np.zeros((len(counts), VOTERS + STEMS + 6), np.int8)
    for v in range(VOTERS + STEMS):
        out[:, v] = counts[:, shards == v].sum(1) >= (2 if v in (VOTERS - 1, VOTERS + STEMS - 1) else 1)
    hits, n = counts[:, shards < VOTERS].sum(1), VOTERS + STEMS
    stems = counts[:, shards >= VOTERS].sum(1)
    none = (hits == 0) & (stems == 0)
    out[:, n] = np.where(hits >= 2, 1, np.where(none, -1, 0))
    out[:, n + 1] = np.where(hits + stems >= 0.005 * np.maximum(words, 1), np.where(none, -1, 1), -1)
    out[:, n + 2] = np.where((counts > 0).sum(1) >= 2, 1, np.where(none, -1, 0))
    # Signs of the text itself; most texts show none of them, and no sign says that a text is clean.
    out[:, n + 3] = (letters >= 40) & (upper >= 0.5 * letters)
    out[:, n + 4] = doubled >= 10
    out[:, n + 5] = (words >= 20) & (again >= 0.2 * words)
    return out


def label_model(votes: np.ndarray, prior: float, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 by row, P(vote | class) by voter (2 x 3), and the voters' correlations given the class."""
    onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
    n, m, _ = onehot.shape
    post = np.clip(0.5 + 0.4 * np.sign(votes.sum(1)), 0.05, 0.95)
    weight = np.ones(m)
    table = np.full((2, m, 3), 1 / 3)
    for step in range(rounds):
        for y, p in ((0, 1 - post), (1, post)):
            table[y] = (np.einsum("n,nmv->mv", p, onehot) + 1) / (p.sum() + 3)
        if step == rounds // 2:
            weight = 1 / (1 + np.clip(_correlations(votes, post), 0, None).sum(1))
        logit = np.log(prior / (1 - prior)) + np.einsum("nmv,mv,m->n", onehot, np.log(table[1]) - np.log(table[0]), weight)
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post, table, _correlations(votes, post)


def _correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Partial correlations of votes within the classes, the diagonal 0."""
    v = votes.astype(float)
    left = np.zeros((v.shape[1], v.shape[1]))
    for p in (post, 1 - post):
        centred = v - (p[:, None] * v).sum(0) / max(p.sum(), 1e-9)
        left += (centred * p[:, None]).T @ centred
    scale = np.sqrt(np.maximum(np.diag(left), 1e-9))
    left = left / scale[:, None] / scale[None, :]
    np.fill_diagonal(left, 0)
    return left


@dataclass
class ToxicityModel:
    lexicon: np.ndarray
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def features(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        return features(counts, total)

    def score(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(counts, total) @ self.weights + self.bias, -40, 40)))


def features(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    words, upper, letters, doubled, again = total.T
    hits = counts.sum(1)
    more = [hits > 0, hits > 1, np.log1p(hits), np.minimum(1, 50 * hits / np.maximum(words, 1)), upper / np.maximum(letters, 1), np.minimum(1, doubled / 10), again / np.maximum(words, 1)]
    return np.concatenate([np.log1p(counts), np.stack(more, 1)], 1)


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 400, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient descent with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, 0.0, 0.0
    step = 4.0 / max(1e-9, 0.25 * (x**2).sum(1).mean() + 0.25)
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(x @ w + b, -40, 40))) - y
        vw = 0.9 * vw - 0.1 * step * (x.T @ g / len(y) + l2 * w)
        vb = 0.9 * vb - 0.1 * step * g.mean()
        w, b = w + vw, b + vb
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """labels holds the rows that may be learned from (id_col, label_col)."""
    marks = labels.filter(labels[label_col].isNotNull() & labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(F.max(labels[label_col]).cast("double").alias("y"))
    n = marks.count()
    u = F.pmod(F.xxhash64(F.lit(29), F.col("id")), F.lit(1 << 20))
    picked = marks.filter(u < int((1 << 20) * min(1.0, SAMPLE_ROWS / max(1, n))))
    # About SAMPLE_ROWS short rows at most: small enough to send to every executor.
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(picked), "id").select("text", "y")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(0))
            for i, j, d, o in chunks(data, offsets, PIECE):
                words, at, _ = _trimmed_words(d, o)
                order = np.lexsort((at, words))
                words, at = words[order], at[order]
                once = np.ones(len(words), bool)
                once[1:] = (words[1:] != words[:-1]) | (at[1:] != at[:-1])
                words, toxic = words[once], y[i:j][at[once]]
                found, first = np.unique(words, return_index=True)
                yes = np.add.reduceat(toxic, first) if len(found) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.diff(np.append(first, len(words)))), pa.array(yes, pa.float64())], names=["word", "n", "yes"])

    sizes = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("yes")).first()
    if not sizes["yes"] or sizes["yes"] >= sizes["n"]:
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(7), -1e3, np.zeros(0), np.zeros((0, 0)))
    odds = (F.col("yes") + 0.5) / sizes["yes"] / ((F.col("n") - F.col("yes") + 1.5) / (sizes["n"] - sizes["yes"]))
    words = rows.mapInArrow(mine, "word long, n long, yes double").groupBy("word").agg(F.sum("n").alias("n"), F.sum("yes").alias("yes"))
    fit = words.filter((F.col("yes") >= SUPPORT) & (odds >= LIFT)).withColumn("stem", F.col("word").bitwiseAND(F.lit(int(_STEM))) != 0)
    place = Window.partitionBy("stem").orderBy((F.log(odds) * F.col("yes")).desc(), "word")
    kept = fit.withColumn("place", F.row_number().over(place) - 1).filter(F.col("place") < LEXICON).select("word", "stem", "place").collect()  # LEXICON words and stems at most
    mined = np.array([r["word"] for r in kept], np.int64).view(np.uint64)
    dealt = np.array([VOTERS + min(r["place"], STEMS - 1) if r["stem"] else min(r["place"], VOTERS - 1) for r in kept], np.int64)
    order = np.argsort(mined)
    lexicon, shards = mined[order], dealt[order]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j, d, o in chunks(data, offsets, PIECE):
                counts, total = _per_text(d, o, lexicon)
                cells = [c.nonzero()[0] for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array([c.tolist() for c in cells], pa.list_(pa.int32())), pa.array([r[c].tolist() for r, c in zip(counts, cells)], pa.list_(pa.float32())), pa.array(total.tolist(), pa.list_(pa.int64())), batch.column(1)[i:j]], names=["at", "n", "total", "y"])

    sample = rows.mapInArrow(look, "at array<int>, n array<float>, total array<long>, y double").toPandas()  # about SAMPLE_ROWS rows at most
    counts = np.zeros((len(sample), len(lexicon)), np.float32)
    for i, (at, n_) in enumerate(zip(sample["at"], sample["n"])):
        counts[i, at] = n_
    total, y = np.array(sample["total"].tolist(), np.int64).reshape(-1, 5), sample["y"].to_numpy()
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    votes = votes_of(counts, total, shards)
    post, table, correlations = label_model(votes, prior)
    if np.corrcoef(post, y)[0, 1] < 0:  # the model finds two classes; labels say which of them is toxic
        post = 1 - post
    w, b = fit_linear(features(counts, total), post)
    return ToxicityModel(lexicon, w, b, table, correlations)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # LEXICON words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = [m.score(*_per_text(d, o, m.lexicon)) for _, _, d, o in chunks(data, offsets, PIECE)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.concatenate([np.zeros(0), *out]))], names=["doc_id", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCORED)
