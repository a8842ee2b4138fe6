"""Periodic runs of words, found by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q and length of at least max(shortest, 2 q) that
can't be extended on either side keeping period q. Texts are worked on whole, many at once; no row leaves its task.

Naming: level 0 names a word within its text, level l names the 2**l words from a position on, by numbering the
pairs of names of its halves. A block that occurs once in its text gets no name (0) and neither does any block
around it, so only what repeats is sorted again, and levels end when nothing repeats. The longest common
extension of two positions is read off the levels from the highest down, one comparison each.

Candidates: a run of period p covers a position i with i + p in it where i is a multiple of p from the text's
start, and of its extensions to both sides one has half of what the run needs; so only grid positions whose
block of that size has the name of the block p further on are extended. Counting all periods these are n log n
positions. No hashes and no suffix sorting; equal names mean equal words.

Edge cases: null and empty texts have no words and no runs; rows repeat as given; null ids stay null; empty
tables give no rows; other columns are ignored. Of runs with equal length the one with the smallest start, then
period, is the longest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SHORTEST = 12
#: Words named together (a longer text is named alone) and candidates extended together.
WORDS = 1 << 18
CANDIDATES = 1 << 19
FOUND = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, n_dropped long, "
    "starts array<long>, lengths array<long>, periods array<long>, runs_sha256 string, collapsed_sha256 string, collapsed binary"
)


def name_levels(codes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Names of all blocks of 1, 2, 4, ... words by position; 0 where the block occurs once in its text or leaves it.

    codes are numbers from 0 by word, offsets the first position of every text and the end. Every array has a 0 at its end.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, keys = np.arange(n), text * (np.int64(codes.max()) + 1 if n else 1) + codes
    end = offsets[1:][text]
    levels, width = [], 1
    while len(at):
        _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
        names = np.where(counts[names] > 1, names + 1, 0)
        if not names.any():
            break
        level = np.zeros(n + 1, np.int32)
        level[at] = names
        levels.append(level)
        at = at[names > 0]
        at = at[at + 2 * width <= end[at]]
        left, right = level[at].astype(np.int64), level[at + width].astype(np.int64)
        both = right > 0
        at, keys = at[both], left[both] * (n + 1) + right[both]
        width *= 2
    return levels


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, first: np.ndarray, end: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from i on equal those from j on (or, backward, those before i and j), within [first, end)."""
    out = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step, level = 1 << k, levels[k]
        if forward:
            inside = j + out + step <= end
            a, b = np.where(inside, i + out, 0), np.where(inside, j + out, 0)
        else:
            inside = i - out - step >= first
            a, b = np.where(inside, i - out - step, 0), np.where(inside, j - out - step, 0)
        out += step * (inside & (level[a] == level[b]) & (level[a] > 0))
    return out


def _needed(p: np.ndarray, shortest: int) -> np.ndarray:
    """The level whose blocks one of the two extensions of a run of period p holds at least."""
    half = (np.maximum(p, shortest - p) + 1) // 2
    return np.log2(half).astype(np.int64)


def _grid(texts: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, position in it, period) of all multiples of the periods with another word a period further on, piece by piece."""
    for lo in range(0, len(p), 256):
        part = p[lo : lo + 256]
        count = np.maximum(0, (sizes[:, None] - 1) // part[None, :]).ravel()
        who, per = np.repeat(texts, len(part)), np.tile(part, len(texts))
        who, per, count = who[count > 0], per[count > 0], count[count > 0]
        done, total = 0, np.concatenate([[0], np.cumsum(count)])
        while done < total[-1]:
            stop = min(total[-1], done + CANDIDATES)
            a, b = np.searchsorted(total, done, "right") - 1, np.searchsorted(total, stop, "left")
            share = np.minimum(total[a + 1 : b + 1], stop) - np.maximum(total[a:b], done)
            cell = np.repeat(np.arange(a, b), share)
            yield who[cell], (np.arange(done, stop) - total[cell]) * per[cell], per[cell]
            done = stop


def find_runs(codes: np.ndarray, offsets: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start in it, length and period of every run, by text, start and period."""
    levels = name_levels(codes, offsets)
    sizes, found = np.diff(offsets), [np.zeros((0, 4), np.int64)]
    longest = int(sizes.max()) if len(sizes) else 0
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    periods = np.arange(1, longest // 2 + 1)
    needed = _needed(periods, shortest) if len(periods) else periods
    for k in range(len(levels)):
        p = periods[needed == k]
        if not len(p):
            continue
        # A run's own block repeats, so texts without a repeated block of this size have none of these periods.
        texts = np.unique(text_of[levels[k][:-1] > 0])
        texts = texts[(sizes[texts] >= 2 * p[0]) & (sizes[texts] >= shortest)]
        block = 1 << k
        for who, at, per in _grid(texts, sizes[texts], p):
            i, first, end = at + offsets[who], offsets[who], offsets[who + 1]
            j = i + per
            ahead = (levels[k][i] == levels[k][j]) & (levels[k][i] > 0)
            back = i - block >= first
            behind = np.where(back, i - block, 0)
            behind_too = np.where(back, j - block, 0)
            hit = ahead | (back & (levels[k][behind] == levels[k][behind_too]) & (levels[k][behind] > 0))
            hit &= (2 * per <= end - first) & (levels[0][i] == levels[0][j]) & (levels[0][i] > 0)
            i, j, per, who, first, end = i[hit], j[hit], per[hit], who[hit], first[hit], end[hit]
            f, b = extend(levels, i, j, first, end, True), extend(levels, i, j, first, end, False)
            length = f + b + per
            run = (length >= 2 * per) & (length >= shortest)
            found.append(np.unique(np.stack([who[run], (i - b - first)[run], length[run], per[run]], 1), axis=0))
    runs = np.unique(np.concatenate(found), axis=0)
    # A stretch met with several periods has the smallest of them, which comes first.
    fresh = np.ones(len(runs), bool)
    fresh[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    runs = runs[fresh]
    return tuple(runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))].T)


def _encode(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    flat = pa.array([w for ws in words for w in ws], pa.large_binary())
    return flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets


def _report(ids: list, words: list[list[bytes]], shortest: int) -> dict:
    codes, offsets = _encode(words)
    who, start, length, period = find_runs(codes, offsets, shortest)
    edge = np.zeros(len(codes) + 1, np.int32)
    drop_from, drop_to = offsets[who] + start + period, offsets[who] + start + length
    np.add.at(edge, drop_from, 1)
    np.add.at(edge, drop_to, -1)
    kept = np.cumsum(edge[:-1]) == 0
    cuts = np.searchsorted(who, np.arange(len(words) + 1))
    out = {name.split()[0]: [] for name in FOUND.split(", ")}
    for t, ws in enumerate(words):
        a, b = cuts[t], cuts[t + 1]
        s, n, p = start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist()
        mask = kept[offsets[t] : offsets[t + 1]]
        left = b" ".join(compress(ws, mask.tolist())) if b > a else b" ".join(ws)
        top = min(range(b - a), key=lambda i: (-n[i], s[i], p[i])) if b > a else None
        row = (
            ids[t], len(ws), b - a, *((s[top], n[top], p[top], 1000 * n[top] // p[top]) if b > a else (None,) * 4), int(len(ws) - mask.sum()),
            s, n, p, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in zip(s, n, p)).encode()).hexdigest(), hashlib.sha256(left).hexdigest(), left,
        )
        for column, value in zip(out.values(), row):
            column.append(value)
    return out


def plant(words: list[bytes], h: int) -> list[bytes]:
    """Every tenth text by its number h is made to repeat: from word g % n on it is a few of its own words, again and again."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = words[a : a + p]
    return words[:a] + (again * (-(-(n - a) // p)))[: n - a]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, number: Column | None = None, text_out: bool = True) -> DataFrame:
    """FOUND by row: the runs, the longest of them, and the text without repetitions; number: texts are changed by plant() with it first."""
    schema = StructType.fromDDL(FOUND)
    if not text_out:
        schema = StructType([f for f in schema.fields if f.name not in ("collapsed", "starts", "lengths", "periods")])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at, waiting, size = [], [], 0
            for t in range(len(ids)):
                text = batch.column(1)[t].as_py() or b""
                ws = text.split()
                at.append(ids[t])
                waiting.append(plant(ws, numbers[t]) if numbers[t] is not None else ws)
                size += len(ws)
                if size >= WORDS or t == len(ids) - 1:
                    made = _report(at, waiting, shortest)
                    yield pa.RecordBatch.from_pydict({f.name: made[f.name] for f in arrow}, arrow)
                    at, waiting, size = [], [], 0

    given = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"), (F.lit(None) if number is None else number).cast("long").alias("number"))
    return given.mapInArrow(work, schema)
