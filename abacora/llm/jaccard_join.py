"""N-gram Jaccard join of documents, size-aware: light sets by fixed-size subsets, heavy sets by inverted lists.

A document's set holds its distinct shingles of SHINGLE lower-cased (A-Z) words. Equal sets are one
node, named by a 128-bit digest, so copies cost no pairs. Shingles get one global order, those that
repeat within parts of the corpus last (by a sketch of their summed counts that has the same size for any
corpus), else by hash; any order is exact, this one keeps common passages out of the keys.

For a threshold t two linked sets of n shingles share at least ceil(t n). So among its first
n - ceil(t n) + k shingles each of the two has k in common. Heavy sets put their first
n - ceil(t n) + 1 shingles into inverted lists (k = 1). Light sets, of at most `boundary`
shingles, enumerate all 2-subsets of their first n - ceil(t n) + 2 as keys; those that a heavy set
can link with are in the lists too. The boundary is the one of least cost over the corpus' sizes.

A list gives a pair only if what either set has left from that key on can still reach the threshold
(the pair's first common key always passes). A list of at most LIST nodes gives all such pairs. From longer
lists, which may be spread over several tasks by a salt, every node is paired with one hub: that which most
of its lists name. These pairs are verified and components built; lists whose nodes are by then in one
component are done. A further round chooses other hubs for the rest. Lists that stay open are looked at in blocks
of BLOCK nodes and WEIGHT shingles, which hold the nodes' whole sets: pairs of different components that can link are counted
exactly, and only links that join components are handed on. So no link between components is lost, a block hands on
fewer links than it has components, and sets that do not link are no rows.

Edge cases: null text or none but separators: empty set, linked with nothing, its own component;
fewer than SHINGLE words: the whole sequence is one shingle; rows without doc_id get the component
of the equal sets (null if there are none) and link nothing else; repeated rows repeat in the
result; doc_id is expected to name one text (rows that repeat it wholly are fine); other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, discard, hash_words, lean, materialize, mix, scan_words, text_buffers, window_hashes
from .components import connected_components, spanning

SHINGLE = 5
#: The threshold as a fraction of integers, so that the border is exact.
THRESHOLD = (75, 100)
LIST = 16
LIGHT_MOST = 64
#: The sketch of shingle counts has 2 ** SKETCH_BITS levels of a byte each, whatever the corpus.
SKETCH_BITS = 22
_SKETCH_BLOCK = 16
#: Bits of a join key that are not sent: keys that fall together only give pairs that verification refuses.
KEY_SPARE = 16
#: A key that is met more often is spread over about count / HOT sublists; a hub over as many tasks.
HOT = 1024
#: Rounds in which the nodes of lists are paired with a hub, before all pairs of those still open are made.
ROUNDS = 2
#: Nodes and shingles of one block of an open list.
BLOCK = 1024
WEIGHT = 1 << 19
#: Shingles of sets that a task keeps from one block to the next.
KEPT = 1 << 20
#: Bits that tell which texts are needed, whatever the corpus; a text beyond them is joined away.
MARK_BITS = 26
_MARK_BLOCK = 16
#: Tasks over which open lists of the same components are dealt.
SPREAD = 32
#: Hot classes of equal sets are broadcast up to this many.
BROADCAST_ROWS = 100_000
#: Text bytes worked on at once.
PIECE = 1 << 20
#: Text bytes over which repeats of a shingle are counted at once.
COUNT_BYTES = 8 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes ordered by row, their rows, and the number per row."""
    n = len(offsets) - 1
    starts, ends, rows = scan_words(data, offsets)
    words = hash_words(data, starts, ends, lower=True)
    per = np.bincount(rows, minlength=n)
    h = window_hashes(words, k)
    inside = rows[: len(h)] == rows[k - 1 :] if len(h) else np.zeros(0, bool)
    hashes, at = [h[inside]], [rows[: len(h)][inside]]
    for short in range(1, k):
        own = np.flatnonzero(per == short)
        if len(own):
            first = np.searchsorted(rows, own)
            hashes.append(window_hashes(words, short)[first])
            at.append(own)
    h, r = np.concatenate(hashes), np.concatenate(at)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    once = np.ones(len(h), bool)
    once[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[once], r[once]
    return h, r, np.bincount(r, minlength=n)


def digests(h: np.ndarray, r: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set; together the set's name."""
    out = []
    for salt in (0x51ED270B7A3C4F11, 0x2545F4914F6CDD1D):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(salt)), out=total[1:])
        ends = np.searchsorted(r, np.arange(n + 1))
        out.append(total[ends[1:]] - total[ends[:-1]])
    return mix(out[0]), mix(out[1])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


@dataclass
class Order:
    """Levels (twice the logarithm) of the counts of shingles, by bucket."""

    levels: np.ndarray

    def level(self, h: np.ndarray) -> np.ndarray:
        return self.levels[_bucket(h)]


def sublists(level: np.ndarray) -> np.ndarray:
    """Into how many sublists keys of such counts are spread; 0: none."""
    count = np.exp2(level.astype(np.float64) / 2)
    return np.where(count > HOT, np.minimum(count // HOT + 1, 1 << 20), 0).astype(np.uint64)


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def _spare(n: np.ndarray | int, threshold=THRESHOLD):
    """n - ceil(t n)."""
    t, of = threshold
    return n - -(-t * n // of)


def choose_boundary(sizes: dict[int, int], mean_list: float, threshold=THRESHOLD) -> int:
    """The boundary of least cost for sets of these sizes: 2-subsets against list entries and the pairs that they make."""
    t, of = threshold

    def cost(boundary: int) -> float:
        total = 0.0
        for n, sets in sizes.items():
            p = _spare(n, threshold)
            if 2 <= n <= boundary:
                total += sets * comb(min(n, p + 2), 2)
            if n > boundary or of * n > t * boundary:
                total += sets * (p + 1) * (1 + mean_list * (p + 1) / max(n, 1))
        return total

    return min([0, *range(2, LIGHT_MOST + 1)], key=cost)


def keys(h: np.ndarray, r: np.ndarray, per: np.ndarray, order: Order, boundary: int, threshold=THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join keys, their rows, how many shingles a set can at most share with one whose first common key this is, and the key's level."""
    level = order.level(h)
    place = np.lexsort((h, level, r))
    h, r, level = h[place], r[place], level[place]
    first = np.concatenate([[0], np.cumsum(per)])
    pos, size = np.arange(len(h)) - first[r], per[r]
    t, of = threshold
    single = (pos <= _spare(size, threshold)) & ((size > boundary) | (of * size > t * boundary))
    out, rows, left, levels = [h[single]], [r[single]], [(size - pos)[single]], [level[single]]
    for n in range(2, boundary + 1):
        own = np.flatnonzero(per == n)
        p = min(n, _spare(n, threshold) + 2)
        if len(own):
            at = first[own][:, None] + np.arange(p)
            block, known = h[at], level[at]
            i, j = np.triu_indices(p, 1)
            out.append(mix(block[:, i] * np.uint64(0x9FB21C651E98DF25) + block[:, j]).ravel())
            rows.append(np.repeat(own, len(i)))
            left.append(np.tile(n - j + 1, len(own)))
            levels.append(np.minimum(known[:, i], known[:, j]).ravel())
    return np.concatenate(out), np.concatenate(rows), np.concatenate(left), np.concatenate(levels)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def describe(docs: DataFrame) -> DataFrame:
    """kind 0: a row per document (a doc_id, b and c the set's name, n its size). kind 1: of shingles that repeat within COUNT_BYTES of texts, by bucket (a): sum n of their counts, b of the squares."""

    names = ["kind", "a", "b", "c", "n"]

    def repeats(parts: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        found, n = found[n > 1], n[n > 1]
        at, which = np.unique(_bucket(found), return_inverse=True)
        total, squares = (np.bincount(which, w, len(at)).astype(np.int64) for w in (n, n.astype(np.float64) ** 2))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int8)), pa.array(at), pa.array(squares), pa.nulls(len(at), pa.int64()), pa.array(total)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j, d, o in chunks(data, offsets, PIECE):
                h, r, per = shingle_sets(d, o)
                one, two = digests(h, r, j - i)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int8)), batch.column(0)[i:j], _long(one), _long(two), _long(per)], names=names)
                parts.append(h[_single(one)[r]])
                held += len(d)
                if held >= COUNT_BYTES:
                    yield repeats(parts)
                    parts, held = [], 0
        if parts:
            yield repeats(parts)

    return docs.mapInArrow(lean(run), "kind byte, a long, b long, c long, n long")


def _single(names: np.ndarray) -> np.ndarray:
    """True at the first row of every name: copies are one set."""
    keep = np.zeros(len(names), bool)
    keep[np.unique(names, return_index=True)[1]] = True
    return keep


def sketch(common: DataFrame) -> Order:
    """The levels of kind 1 rows, put together block by block in tasks; 2 ** SKETCH_BITS bytes reach the driver."""
    low = 1 << _SKETCH_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at, n = (c.to_numpy() for c in batch.columns)
            for block in np.unique(at >> _SKETCH_BLOCK).tolist():
                own = at >> _SKETCH_BLOCK == block
                made.setdefault(block, np.zeros(low, np.uint8))[at[own] & (low - 1)] = np.minimum(255, np.rint(2 * np.log2(n[own])))
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["block", "levels"])

    summed = common.groupBy("a").agg(F.sum("n").alias("n"))
    blocks = summed.repartition(F.shiftright("a", _SKETCH_BLOCK)).mapInArrow(lean(run), "block long, levels binary").collect()  # a byte a bucket
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in blocks:
        levels[row["block"] * low : (row["block"] + 1) * low] = np.frombuffer(row["levels"], np.uint8)
    return Order(levels)


def postings(docs: DataFrame, order: Order, boundary: int) -> DataFrame:
    """key, salt, node, n: the keys of every set; n packs the set's size and what it can still share, size first; a salt above 0 is a sublist of a hot key."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # a byte a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j, d, o in chunks(data, offsets, PIECE):
                h, r, per = shingle_sets(d, o)
                node, _ = digests(h, r, j - i)
                k, rows, left, level = keys(h, r, per, shared.value, boundary)
                keep = _single(node)[rows]
                k, rows, left, level = k[keep], rows[keep], left[keep], level[keep]
                spread, own = sublists(level), node[rows]
                salt = np.where(spread > 0, 1 + mix(own + np.uint64(5)) % np.maximum(spread, np.uint64(1)), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_long(k >> np.uint64(KEY_SPARE)), pa.array(salt), _long(own), _long(per[rows] << 32 | left)], names=["key", "salt", "node", "n"])

    return docs.filter("doc_id is not null").mapInArrow(lean(run), "key long, salt int, node long, n long")


def _fits(a, b, threshold=THRESHOLD):
    """Whether sets of packed sizes a and b can link: by size, and by what is left of both from their first common key on.

    A pair is met at its first common key too, where this holds if it links at all, so later keys may refuse it.
    """
    t, of = threshold
    n, m, low = a >> 32, b >> 32, 0xFFFFFFFF
    return (of * np.minimum(n, m) >= t * np.maximum(n, m)) & ((of + t) * np.minimum(a & low, b & low) >= t * (n + m))


def _fitting(a: Column, b: Column, threshold=THRESHOLD) -> Column:
    """_fits() of columns."""
    t, of = threshold
    n, m, low = F.shiftright(a, 32), F.shiftright(b, 32), F.lit(0xFFFFFFFF)
    return (of * F.least(n, m) >= t * F.greatest(n, m)) & ((of + t) * F.least(a.bitwiseAND(low), b.bitwiseAND(low)) >= t * (n + m))


class _Pairs:
    """Pairs made distinct within a task, handed on when many."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.parts.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
            self.n += len(a)

    def take(self) -> np.ndarray:
        out = np.unique(np.concatenate(self.parts), axis=0) if self.parts else np.zeros((0, 2), np.int64)
        self.parts, self.n = [], 0
        return out

    def full(self) -> Iterator[np.ndarray]:
        """The pairs, if so many are held that they have to go."""
        if self.n > 1 << 19:
            p = self.take()
            if len(p) > 1 << 18:
                yield p
            else:
                self.add(p[:, 0], p[:, 1])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)


def candidates(sorted_postings: DataFrame) -> DataFrame:
    """kind 0: pairs (a, b) to verify. kind 1: a (key), b (node), n of lists that are longer than LIST or spread. Reads partitions sorted by key, salt, node and, downwards, n."""

    def out(rows: np.ndarray, kind: int) -> pa.RecordBatch:
        n = rows[:, 2] if kind else np.zeros(len(rows), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int8)), pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(n)], names=["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, late, going, before = _Pairs(), np.zeros((0, 4), np.int64), None, None

        def lists(rows: np.ndarray, last: bool):
            nonlocal late, going
            first = np.concatenate([[0], np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1])
            size = np.diff(np.append(first, len(rows)))
            long = (size > LIST) | (rows[first, 1] > 0)
            long[0] |= going is not None and tuple(rows[0, :2]) == going
            going = tuple(rows[-1, :2]) if long[-1] else None
            if (which := np.repeat(long, size)).any():
                yield out(rows[which][:, [0, 2, 3]], 1)
            small = ~long
            late = late[:0]
            if small[-1] and not last:  # it may go on
                late, small[-1] = rows[first[-1] :], False
            for s in np.unique(size[small]):
                if s < 2:
                    continue
                block = first[small & (size == s)][:, None] + np.arange(s)
                i, j = np.triu_indices(s, 1)
                a, b = rows[block[:, i].ravel()], rows[block[:, j].ravel()]
                ok = _fits(a[:, 3], b[:, 3]) & (a[:, 2] != b[:, 2])
                pairs.add(a[ok, 2], b[ok, 2])
                for p in pairs.full():
                    yield out(p, 0)

        for batch in batches:
            rows = _matrix(batch)
            if not len(rows):
                continue
            fresh = np.ones(len(rows), bool)  # the same set may come from several tasks, or with two keys that fall together: what refuses less stays
            fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1)
            fresh[0] = before is None or (rows[0, :3] != before).any()
            before = rows[-1, :3]
            rows = np.concatenate([late, rows[fresh]])
            if len(rows):
                yield from lists(rows, last=False)
        if len(late):
            yield from lists(late, last=True)
        yield out(pairs.take(), 0)

    return sorted_postings.mapInArrow(lean(run), "kind byte, a long, b long, n long")


class _Forest:
    """Components that links have joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def roots(self, x: np.ndarray) -> np.ndarray:
        label, which = np.unique(x, return_inverse=True)
        return np.array([self.find(c) for c in label.tolist()], np.int64)[which]


def across(blocks: DataFrame) -> DataFrame:
    """u, v: links between nodes (by rep) of open lists that join different components, those that a task's links have joined being one.

    Reads key, i, j, block, n, node, component, rep, packed sorted by key, i, j: two blocks of a list, or one (i = j). Every pair that can link
    is counted exactly, unless both are joined by then.
    """
    t, of = THRESHOLD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, forest, kept, weight = zstandard.ZstdDecompressor().decompress, _Forest(), {}, 0

        def sets_of(nodes: list[int], packed: list[bytes]) -> list[np.ndarray]:
            nonlocal weight
            found = {x: kept[x] for x in nodes if x in kept}
            new = {x: p for x, p in zip(nodes, packed) if x not in found}
            raw, names, held = [], [], 0

            def parse():
                nonlocal raw, names, held
                h, _, per = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
                found.update(zip(names, (x.copy() for x in np.split(h, np.cumsum(per)[:-1]))))
                raw, names, held = [], [], 0

            for x, p in new.items():
                raw.append(unpack(p))
                names.append(x)
                held += len(raw[-1])
                if held > PIECE:
                    parse()
            if raw:
                parse()
            if weight > KEPT:
                kept.clear()
                weight = 0
            for x in new:
                kept[x] = found[x]
                weight += len(found[x])
            return [found[x] for x in nodes]

        def pair_up(rows: np.ndarray, packed: list[bytes]) -> pa.RecordBatch | None:
            root = forest.roots(rows[:, 6])
            label, which, many = np.unique(root, return_inverse=True, return_counts=True)
            if len(label) < 2:
                return None
            order = np.argsort(which == many.argmax(), kind="stable")  # the largest component's nodes last: they meet only others
            rows, root, own, two = rows[order], root[order], len(rows) - int(many.max()), rows[0, 1] != rows[0, 2]
            sets = sets_of(rows[:, 5].tolist(), [packed[k] for k in order.tolist()])
            size = np.array([len(x) for x in sets], np.int64)
            start = np.cumsum(size) - size
            _, word = np.unique(np.concatenate(sets), return_inverse=True)
            has, links = np.zeros(word.max() + 1, bool), []
            for a in range(own):
                can = (root[a + 1 :] != root[a]) & _fits(rows[a, 4], rows[a + 1 :, 4])
                if two:
                    can &= rows[a + 1 :, 3] != rows[a, 3]
                if not can.any():
                    continue
                mine = word[start[a] : start[a] + size[a]]
                has[mine] = True
                shared = np.add.reduceat(has[word[start[a + 1] :]], start[a + 1 :] - start[a + 1], dtype=np.int64)
                has[mine] = False
                linked = a + 1 + np.flatnonzero(can & (of * shared >= t * (size[a] + size[a + 1 :] - shared)))
                for b in linked[np.unique(root[linked], return_index=True)[1]].tolist():  # one link to a component is enough
                    links.append((rows[a, 7], rows[b, 7]))
                    forest.up[max(root[a], root[b])] = low = min(root[a], root[b])
                    root[(root == root[a]) | (root == root[b])] = low
            if links:
                return pa.RecordBatch.from_arrays([pa.array([int(x) for x in side], pa.int64()) for side in zip(*links)], names=["u", "v"])
            return None

        late, texts = np.zeros((0, 8), np.int64), []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, texts = np.concatenate([late, _matrix(batch.select(range(8)))]), texts + batch.column(8).to_pylist()
            edge = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1).tolist()]
            for x, y in zip(edge, edge[1:]):
                if (made := pair_up(rows[x:y], texts[x:y])) is not None:
                    yield made
            late, texts = rows[edge[-1] :], texts[edge[-1] :]
        if len(late) and (made := pair_up(late, texts)) is not None:
            yield made

    return blocks.mapInArrow(lean(run), "u long, v long")


def marks(ids: DataFrame) -> np.ndarray:
    """2 ** MARK_BITS bits, set where an id (one column) falls by its hash; put together block by block in tasks, these reach the driver."""
    low = 1 << _MARK_BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for block in np.unique(at >> _MARK_BLOCK).tolist():
                made.setdefault(block, np.zeros(low, bool))[at[at >> _MARK_BLOCK == block] & (low - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array([np.packbits(x).tobytes() for x in made.values()], pa.binary())], names=["block", "bits"])

    at = ids.select(_mark(ids[ids.columns[0]]).alias("at"))
    out = np.zeros(1 << MARK_BITS - 3, np.uint8)
    for row in at.repartition(F.shiftright("at", _MARK_BLOCK)).mapInArrow(lean(run), "block long, bits binary").collect():  # a bit a mark
        out[row["block"] * low // 8 : (row["block"] + 1) * low // 8] |= np.frombuffer(row["bits"], np.uint8)
    return out


def _mark(c: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(c), 64 - MARK_BITS)


def _packed(docs: DataFrame, needed: np.ndarray) -> DataFrame:
    """doc_id and the compressed text of rows whose doc_id is marked in needed; a few others may be among them."""
    shared = docs.sparkSession.sparkContext.broadcast(needed)  # a bit a mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1 > 0))
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "packed"])

    return docs.filter("doc_id is not null").select("doc_id", "text", _mark(F.col("doc_id")).alias("at")).mapInArrow(lean(run), "doc_id long, packed binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """u, v: the rep of both sides of the pairs (a, b, s) whose whole texts reach the threshold. texts: node, rep, packed; s spreads the pairs of a hub b."""
    hubs = pairs.groupBy("b").agg(F.max("s").alias("top")).join(texts.select(F.col("node").alias("b"), F.col("rep").alias("v"), F.col("packed").alias("pv")), "b")
    hubs = hubs.select("b", F.explode(F.sequence(F.lit(0), F.col("top"))).alias("s"), "v", "pv")
    left = pairs.join(texts.select(F.col("node").alias("a"), F.col("rep").alias("u"), F.col("packed").alias("pu")), "a")
    both = left.join(hubs, ["b", "s"]).select("u", "v", "pu", "pv")

    def judge(u: list, v: list, sides: list[list[bytes]]) -> pa.RecordBatch:
        (h1, r1, n1), (h2, r2, n2) = (shingle_sets(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])) for raw in sides)
        h, r = np.concatenate([h1, h2]), np.concatenate([r1, r2])
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        both_have = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        inter = np.bincount(r[1:][both_have], minlength=len(u))
        linked = pa.array(THRESHOLD[1] * inter >= THRESHOLD[0] * (n1 + n2 - inter))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()).filter(linked) for x in (u, v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            u, v, sides, held = [], [], ([], []), 0
            for i in range(batch.num_rows):
                u.append(batch.column(0)[i].as_py())
                v.append(batch.column(1)[i].as_py())
                for side, column in zip(sides, (2, 3)):
                    side.append(unpack(batch.column(column)[i].as_py()))
                    held += len(side[-1])
                if held > PIECE:
                    yield judge(u, v, sides)
                    u, v, sides, held = [], [], ([], []), 0
            if u:
                yield judge(u, v, sides)

    return both.mapInArrow(lean(run), "u long, v long")


def hub_pairs(members: DataFrame, turn: int) -> DataFrame:
    """a, b, s: each node of the lists with the hub that most of its lists name. members: key, node, n, component.

    A list's hub is the first of its nodes of about a size, in an order that all lists share and every turn
    changes; nodes of the hub's component need none. Half of the turns shift the bounds of the sizes.
    """
    step = F.floor(F.log(F.shiftright("n", 32).cast("double")) / float(np.log(THRESHOLD[1] / THRESHOLD[0])) + 0.5 * (turn % 2))
    rows = members.select("key", "node", "n", "component", step.alias("step"), F.pmod(F.xxhash64("node"), F.lit(8)).alias("part"))
    first = F.min_by(F.struct(F.col("node").alias("hub"), F.col("n").alias("m"), F.col("component").alias("of")), F.xxhash64("node", F.lit(turn)))
    hubs = rows.groupBy("key", "step").agg(first.alias("h"), F.count("*").alias("size")).filter("size > 1")
    hubs = hubs.select("key", "step", "h.*", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("part"))
    met = rows.join(hubs, ["key", "step", "part"]).filter((F.col("component") != F.col("of")) & _fitting(F.col("n"), F.col("m")))
    votes = met.groupBy("node", "hub").agg(F.count("*").alias("votes"), F.max("size").alias("size"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "hub", "size")).alias("x"))
    return best.select(F.col("node").alias("a"), F.col("x.hub").alias("b"), F.pmod(F.xxhash64("node"), F.floor(F.col("x.size") / HOT) + 1).cast("int").alias("s"))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """key, node, n, rep, component, and the lowest and highest component, size and sum of sizes of the list, of the lists whose nodes are in several components."""
    named = members.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "node", "n", "rep", F.coalesce("component", "rep").alias("component"))
    keys_ = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.sum(F.shiftright("n", 32)).alias("weight")).filter("lo < hi")
    return named.join(keys_, "key")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    spark, docs = docs.sparkSession, _columns(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described = materialize(describe(docs), "jaccard-sets")
    sets = described.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("c").alias("name"), "n")
    classes = materialize(sets.filter("n > 0").groupBy("node", "name").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.count("*").alias("members")), "jaccard-classes")
    common = described.filter("kind = 1")
    weight = common.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("w")).first()["w"]
    sums = classes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sets")).first()
    most = LIGHT_MOST * THRESHOLD[1] // THRESHOLD[0] + 1
    sizes = {r["n"]: r["sets"] for r in classes.filter(F.col("n") <= most).groupBy("n").agg(F.count("*").alias("sets")).collect()}  # at most `most` rows
    boundary = choose_boundary(sizes, 1 + float(weight) / max(1, sums["n"]))

    listed = postings(docs, sketch(common), boundary).repartition(parts, "key", "salt").sortWithinPartitions("key", "salt", "node", F.desc("n"))
    found = materialize(candidates(listed), "jaccard-candidates")
    ids = classes.filter("rep is not null").select("node", "rep")
    short = found.filter("kind = 0 and a <> b").select("a", "b", F.lit(0).alias("s")).distinct()
    members = materialize(found.filter("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("node"), "n").join(ids, "node").distinct(), "jaccard-lists")
    pairs = materialize(short.unionByName(hub_pairs(members.withColumn("component", F.col("rep")), 0)).filter("a <> b").dropDuplicates(["a", "b"]), "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(members.select("node")).distinct()
    needed = materialize(needed.join(ids, "node"), "jaccard-needed")
    # Texts that nobody needs are left out before the shuffle; rows that repeat are where the join has put them, so they need no other.
    texts = materialize(_packed(docs, marks(needed.select("rep"))).join(needed, F.col("doc_id") == F.col("rep")).dropDuplicates(["doc_id", "node"]).select("node", "rep", "packed"), "jaccard-texts")

    verified = lambda more: materialize(verify(more, texts), "jaccard-links")
    comp, tried, turn, open_, used = _components(verified(pairs)), pairs.select("a", "b"), 0, members, [found, members, pairs, needed, texts]
    while True:
        open_ = materialize(_open(open_.select("key", "node", "n", "rep"), comp), "jaccard-open")
        used.append(open_)
        work = open_.agg(F.sum("size").alias("pairs")).first()["pairs"]  # twice the pairs that all open lists hold
        if not work:
            break
        turn += 1
        if turn >= ROUNDS or work <= sums["sets"]:
            comp = _components(materialize(across(_blocks(open_, texts, parts)), "jaccard-across"), comp)
            break
        more = materialize(hub_pairs(open_, turn).join(_both_ways(tried), ["a", "b"], "left_anti"), "jaccard-pairs")
        used.append(more)
        comp, tried = _components(verified(more), comp), tried.unionByName(more.select("a", "b"))
    out = _placed(sets, classes, comp)
    discard(*used)
    return out


def _components(edges: DataFrame, so_far: DataFrame | None = None) -> DataFrame:
    """node, component of edges (u, v) and of the components so far."""
    if so_far is not None:
        edges = edges.unionByName(so_far.filter("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")))
    return connected_components(spanning(edges))


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _blocks(open_: DataFrame, texts: DataFrame, parts: int) -> DataFrame:
    """What across() reads: each block of an open list with every other, and with itself."""
    # Of lists of the same nodes one is enough, if what is left from its key on refuses nothing.
    by = open_.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor"))
    once = open_.join(by.groupBy("size", "sum", "xor").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    size = F.shiftright("n", 32)
    once = once.withColumn("n", F.shiftleft(size, 32).bitwiseOR(size))
    many = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / WEIGHT))
    rows = once.join(texts.select("node", "packed"), "node").select("key", "n", "node", "component", "rep", "packed", "lo", "hi", many.alias("many"), F.pmod(F.xxhash64("node"), many).alias("block"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("other"))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "node", "component", "rep", "packed", "lo", "hi")
    # Lists of the same components mostly give the same links: they meet in one task, or in SPREAD if there are very many of them.
    dealt = rows.repartition(parts, "lo", "hi", F.pmod(F.xxhash64("key", "i", "j"), F.lit(SPREAD)))
    return dealt.select("key", "i", "j", "block", "n", "node", "component", "rep", "packed").sortWithinPartitions("key", "i", "j")


def _placed(sets: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    """Every document with its class's component; classes of very many copies are broadcast if they are few, so no task gets all copies of one."""
    of = classes.join(comp.select(F.col("node").alias("rep"), "component"), "rep", "left").select("node", "name", F.coalesce("component", "rep").alias("component"), "members")
    of = materialize(of, "jaccard-placed")
    hot = of.filter(F.col("members") > HOT).select(F.col("node").alias("hot_node"), F.col("name").alias("hot_name"), F.col("component").alias("hot"))
    few = hot.count() <= BROADCAST_ROWS
    rest = (of.filter(F.col("members") <= HOT) if few else of).select(F.col("node").alias("at_node"), F.col("name").alias("at_name"), F.col("component").alias("cold"))
    rows = sets.filter("n > 0")
    if few:
        rows = rows.join(F.broadcast(hot), (F.col("node") == F.col("hot_node")) & (F.col("name") == F.col("hot_name")), "left")
        rows = rows.withColumn("node", F.when(F.col("hot_node").isNull(), F.col("node")).otherwise(F.xxhash64("doc_id", "node")))
    else:
        rows = rows.withColumn("hot", F.lit(None).cast("long"))
    placed = rows.join(rest, (F.col("node") == F.col("at_node")) & (F.col("name") == F.col("at_name")), "left").select("doc_id", "n", F.coalesce("hot", "cold").alias("component"))
    out = placed.unionByName(sets.filter("n = 0").select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, with all columns; rows without doc_id stay."""
    dropped = join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("near")).distinct()
    return docs.join(dropped, docs["doc_id"].cast("long") == dropped["near"], "left_anti")
