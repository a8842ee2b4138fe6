"""Substring deduplication over a log-structured index of window fingerprints.

A window is WINDOW consecutive words of one document. Its 64-bit hash goes to a bucket by the
window's minimizer, so that neighbouring windows travel together as one row and equal windows always
meet. Per bucket, sorted immutable runs hold the hashes of earlier documents with their first
places. A new batch is read in order of (doc_id, start); its sorted hashes are merge-joined with every run,
block by block, and with what the batch itself added so far; what is new forms the next run. As soon as
more than FANOUT runs of one level stand at the end, they are merged to a run of the next level, so runs
grow in number with the logarithm of the batches. Matches become claims (a span of windows and the earlier
place it equals); claims are merged to longest spans and verified: both spans' words must have the same
128-bit digest. Verified spans decide which words go.

The folder of an index holds a manifest (a number of buckets and the runs with their levels) and a folder
per run with a file per bucket. It can be opened again, in a later session too, and takes further documents
as new batches; what it holds counts as earlier than they. A manifest is written once all files of a run are
there, files are written aside and renamed, and their content depends on the input alone, so tasks may be
repeated and jobs may fail.

A whole table is taken in batches by doc_id of about BATCH_BYTES, in LEAST_BATCHES at least, each probing the
runs of all before it, as later calls with new documents do; any bounds give the same result.

Repeats within a map chunk are settled there (only the first of equal spans of windows is sent), so
a passage that a third of all documents share is sent once per chunk.

Edge cases: null text has no words; texts of fewer than WINDOW words lose nothing; repeated rows of
one doc_id and text stand for one document and each give the same result (rows of one doc_id with different
texts are outside the contract: their windows count as the document's, and each row loses what the claims of
the id cover in it, if all of them are verified); a row without doc_id keeps
all its words and makes none go; other columns are not looked at, whatever their names; an empty table gives
no rows. If two different windows had equal 64-bit hashes, verification rejects the span, and its words stay.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, discard, hash_words, id_array, lean, materialize, mix, remove, scan_words, scratch_path, text_buffers, window_hashes

WINDOW = 20
GRAM = 5
BATCH_BYTES = 1 << 40
LEAST_BATCHES = 4
FANOUT = 2
#: Text bytes of a batch for each bucket; a task works through many buckets, one at a time.
BUCKET_BYTES = 4 << 20
#: Windows of a bucket that are probed at once, and entries of a run that are read at once.
PROBE = 1 << 20
RUN_BLOCK = 1 << 16
#: Text bytes among which repeats are settled before the shuffle.
PIECE = 2 << 20
#: Tasks over which the claims on one place are spread.
SPREAD = 8
#: Windows of one row at most.
SPAN = 64


def _minima(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def window_spans(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray] | None:
    """Spans of consecutive windows with one minimizer: id, start, n, place of the first hash; the hashes; the minimizers."""
    starts, ends, rows = scan_words(data, offsets)
    if len(starts) < WINDOW:
        return None
    words = hash_words(data, starts, ends)
    h = window_hashes(words, WINDOW)
    low = _minima(window_hashes(words, GRAM, salt=7), WINDOW - GRAM + 1)
    inside = rows[: len(h)] == rows[WINDOW - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return None
    h, low, row = h[at], low[at], rows[at]
    start = at - np.searchsorted(rows, row)
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    if size.max() > SPAN:  # one minimizer over a long stretch
        pieces = -(-size // SPAN)
        first = np.repeat(first, pieces) + SPAN * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        size = np.diff(np.append(first, len(at)))
    return {"id": ids[row[first]], "start": start[first], "n": size, "first": first, "h": h, "low": low[first]}


_SPANS = "bucket int, id long, start int, n int, hashes binary, oid long, ostart int"


def _emit(s: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch:
    """Rows of spans; a span equal to an earlier one of the chunk carries that place instead of hashes."""
    order = np.lexsort((s["start"], s["id"]))
    first, n, ids, start, low = (s[k][order] for k in ("first", "n", "id", "start", "low"))
    # Equal spans have the same minimizer, number of windows and windows; their sum of hashes names them.
    name = mix(mix(low) + np.add.reduceat(s["h"], s["first"])[order]) + mix(s["h"][first]) + n.astype(np.uint64)
    _, lead, which = np.unique(name, return_index=True, return_inverse=True)
    owner = lead[which]
    own = (owner == np.arange(len(owner))) | ((ids[owner] == ids) & (start[owner] == start))
    raw = s["h"].astype("<u8").tobytes()
    hashes = [raw[8 * a : 8 * (a + k)] if o else None for a, k, o in zip(first.tolist(), n.tolist(), own.tolist())]
    bucket = (mix(low) % np.uint64(buckets)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(hashes, pa.binary()), pa.array(ids[owner], mask=own), pa.array(start[owner].astype(np.int32), mask=own)], names=["bucket", "id", "start", "n", "hashes", "oid", "ostart"])


def merge_join(queries: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `queries` and in `h`, both sorted and each without repeats, of the values that are in both, by one merge."""
    both = np.concatenate([h, queries])
    order = np.argsort(both, kind="stable")  # a merge: the sort finds the two sorted parts
    met = np.flatnonzero(both[order[1:]] == both[order[:-1]])
    return order[met + 1] - len(h), order[met]


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run; of equal hashes the place of the earliest run in the list stays."""
    h, i, s = (np.concatenate([r[k] for r in runs]) for k in range(3))
    order = np.argsort(h, kind="stable")
    h = h[order]
    once = np.ones(len(h), bool)
    once[1:] = h[1:] != h[:-1]
    return h[once], i[order][once], s[order][once]


def pack_run(h: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> bytes:
    """Differences of sorted hashes and the places, byte by byte of each number, compressed."""
    planes = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T).tobytes()
    steps = np.diff(h, prepend=np.uint64(0))
    return len(h).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes(steps) + planes(ids.astype("<u8")) + planes(starts.astype("<u8")))


def unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:8], "little")
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), np.uint8)
    h, ids, starts = (np.ascontiguousarray(flat[k * 8 * n : (k + 1) * 8 * n].reshape(8, n).T).view("<u8").ravel() for k in range(3))
    return np.cumsum(h, dtype=np.uint64), ids.astype(np.int64), starts.astype(np.int64)


_CLAIMS = ["id", "start", "n", "oid", "ostart"]
_CLAIMS_SQL = "id long, start int, n int, oid long, ostart int"
_Run = tuple[np.ndarray, np.ndarray, np.ndarray]


class FingerprintIndex:
    """Runs per bucket in a shared folder; a folder that has a manifest is opened with all its runs."""

    def __init__(self, spark, buckets: int = 1, folder: str | None = None):
        self.spark, self.buckets = spark, max(1, buckets)
        self.folder = folder or scratch_path(spark, "fingerprints")
        #: name and level of each run, oldest first
        self.runs: list[tuple[str, int]] = []
        self.number, self.compactions = 0, 0
        store, base = fs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.startswith("manifest-") and f.extension == "json")
        if found:
            with store.open_input_stream(found[-1]) as f:
                told = json.loads(f.read())
            self.number, self.buckets, self.runs = told["number"], told["buckets"], [tuple(r) for r in told["runs"]]

    def _commit(self, runs: list[tuple[str, int]]) -> None:
        """Makes these the index's runs: the next manifest, then the files that no run needs any more go."""
        store, base = fs.FileSystem.from_uri(self.folder)
        gone = {name for name, _ in self.runs} - {name for name, _ in runs}
        self.number, self.runs = self.number + 1, runs
        path = f"{base}/manifest-{self.number:08d}.json"
        with store.open_output_stream(path + ".part") as f:
            f.write(json.dumps({"number": self.number, "buckets": self.buckets, "runs": runs}).encode())
        store.move(path + ".part", path)
        for name in gone:
            store.delete_dir(f"{base}/{name}")

    def ingest(self, docs: DataFrame, keep: bool = True) -> DataFrame:
        """Claims of docs (id, text) against the runs and earlier places of docs itself; keep adds a run of what is new."""
        buckets = self.buckets

        def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = id_array(batch.column(0))
                data, offsets = text_buffers(batch.column(1))
                for i, j, d, o in chunks(data, offsets, PIECE):
                    s = window_spans(d, o, ids[i:j])
                    if s is not None:
                        whole = _emit(s, buckets)
                        for k in range(0, whole.num_rows, 20_000):
                            yield whole.slice(k, 20_000)

        rows = docs.filter("id is not null").select("id", "text").mapInArrow(lean(spans), _SPANS)
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "id", "start")
        made = f"run-{uuid.uuid4().hex}" if keep else None
        out = materialize(ordered.mapInArrow(lean(_resolver(self.folder, [name for name, _ in self.runs], made)), _CLAIMS_SQL), "claims")
        if made:
            self._commit([*self.runs, (made, 0)])
            while len(self.runs) > FANOUT and len({level for _, level in self.runs[-FANOUT - 1 :]}) == 1:
                self.compact(FANOUT + 1)
        return out

    def compact(self, last: int | None = None) -> None:
        """Merges the last runs (all, if not told how many) to one of the next level, bucket by bucket."""
        old, folder, made = self.runs[-(last or len(self.runs)) :], self.folder, f"run-{uuid.uuid4().hex}"
        if not old:
            return
        names = [name for name, _ in old]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = fs.FileSystem.from_uri(folder)
            for batch in batches:
                for b in batch.column(0).to_pylist():
                    _store(store, base, made, b, merge_runs([_load(store, base, name, b) for name in names]))
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64())], names=["bucket"])

        tasks = min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.spark.range(0, self.buckets, 1, tasks).mapInArrow(lean(run), "bucket long").count()
        self._commit([*self.runs[: -len(old)], (made, 1 + max(level for _, level in old))])
        self.compactions += 1

    def close(self) -> None:
        """Deletes the index."""
        remove(self.spark, self.folder)
        self.runs = []


def _path(base: str, name: str, bucket: int) -> str:
    return f"{base}/{name}/bucket-{bucket:08d}.run"


def _load(store, base: str, name: str, bucket: int) -> Iterator[_Run]:
    """The blocks of a bucket's part of a run, in order; none if it has no file."""
    path = _path(base, name, bucket)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return
    with store.open_input_stream(path) as f:
        while head := f.read(4):
            yield unpack_run(f.read(int.from_bytes(head, "little")))


def _store(store, base: str, name: str, bucket: int, blocks: Iterator[_Run]) -> None:
    """Writes blocks aside and renames the file; nothing is written for an empty bucket."""
    path, out = _path(base, name, bucket), None
    part = f"{path}.{uuid.uuid4().hex}"
    for h, ids, starts in blocks:
        for k in range(0, len(h), RUN_BLOCK):
            if out is None:
                store.create_dir(f"{base}/{name}", recursive=True)
                out = store.open_output_stream(part)
            raw = pack_run(*(x[k : k + RUN_BLOCK] for x in (h, ids, starts)))
            out.write(len(raw).to_bytes(4, "little") + raw)
    if out is not None:
        out.close()
        store.move(part, path)


def merge_runs(runs: list[Iterator[_Run]]) -> Iterator[_Run]:
    """One sorted sequence of blocks without repeats; of equal hashes the place in the earliest run of the list stays. A block of each run is held at a time."""
    heads: dict[int, _Run] = {}
    for k, blocks in enumerate(runs):
        if (block := next(blocks, None)) is not None:
            heads[k] = block
    while heads:
        bound = min(h[-1] for h, _, _ in heads.values())
        cut = {k: int(np.searchsorted(heads[k][0], bound, "right")) for k in sorted(heads)}
        yield merged([tuple(x[:n] for x in heads[k]) for k, n in cut.items()])
        for k, n in cut.items():
            if n == len(heads[k][0]):
                if (block := next(runs[k], None)) is None:
                    del heads[k]
                else:
                    heads[k] = block
            else:
                heads[k] = tuple(x[n:] for x in heads[k])


def _resolver(folder: str, history: list[str], made: str | None):
    """Probes spans, read in order of bucket, id and start, says which windows came before, and writes the run `made` of those that did not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        bucket, new, held, windows = None, [], [], 0

        def probe() -> Iterator[pa.RecordBatch]:
            nonlocal held, windows
            if held:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, windows = [], 0
                yield from _resolve(rows, [_load(store, base, name, bucket) for name in history], new)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal new
            yield from probe()
            if made and new:
                _store(store, base, made, bucket, iter([merged(new)]))
            new = []

        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if a == b:
                    continue
                if of[a] != bucket:
                    yield from finish()
                    bucket = int(of[a])
                held.append(batch.slice(a, b - a))
                windows += int(batch.column(3).slice(a, b - a).to_numpy().sum())
                if windows >= PROBE:
                    yield from probe()
        yield from finish()

    return run


def _resolve(batch: pa.RecordBatch, history: list[Iterator[_Run]], new: list[_Run]) -> Iterator[pa.RecordBatch]:
    ids, start, n = (batch.column(k).to_numpy() for k in (1, 2, 3))
    settled = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
    if settled.any():
        s = pa.array(settled)
        yield _claims(ids[settled], start[settled], n[settled], batch.column(5).filter(s).to_numpy(), batch.column(6).filter(s).to_numpy())
    full = np.flatnonzero(~settled)
    if not len(full):
        return
    h = np.frombuffer(b"".join(batch.column(4).take(pa.array(full)).to_pylist()), "<u8").astype(np.uint64)
    size = n[full].astype(np.int64)
    row = np.repeat(full, size)
    wid, wstart = ids[row], start[row] + np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    one, first, which = np.unique(h, return_index=True, return_inverse=True)  # rows are in order of id and start, so the first is the owner
    oid, ostart, known = wid[first], wstart[first], np.zeros(len(one), bool)
    for blocks in [*history, iter(new)]:
        for bh, bi, bs in blocks:
            a, b = np.searchsorted(one, bh[0]), np.searchsorted(one, bh[-1], "right")
            q, at = merge_join(one[a:b], bh)
            q, at = q[~known[a + q]] + a, at[~known[a + q]]  # the oldest run that has it tells the place
            known[q], oid[q], ostart[q] = True, bi[at], bs[at]
    if not known.all():
        new.append((one[~known], oid[~known], ostart[~known]))
        if len(new) > 4:
            new[:] = [merged(new)]
    oid, ostart = oid[which], ostart[which]
    hit = np.flatnonzero((oid != wid) | (ostart != wstart))
    if len(hit):
        i, s, oi, os_ = wid[hit], wstart[hit], oid[hit], ostart[hit]
        fresh = np.ones(len(hit), bool)
        fresh[1:] = (i[1:] != i[:-1]) | (s[1:] != s[:-1] + 1) | (oi[1:] != oi[:-1]) | (os_[1:] != os_[:-1] + 1)
        lead = np.flatnonzero(fresh)
        yield _claims(i[lead], s[lead], np.diff(np.append(lead, len(hit))), oi[lead], os_[lead])


def _claims(i, s, n, oi, os_) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip((i, s, n, oi, os_), (np.int64, np.int32, np.int32, np.int64, np.int32))], names=_CLAIMS)


def longest(claims: DataFrame) -> DataFrame:
    """Claims that follow each other in both documents as one; reads each document's claims in order."""
    parts = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.zeros((0, 5), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[:, k].astype(np.int64 if k in (0, 3) else np.int32)) for k in range(5)], names=["id", "start", "n", "oid", "ostart"])

        for batch in batches:
            rows = np.concatenate([late, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], 1)])
            if not len(rows):
                continue
            a, b = rows[:-1], rows[1:]
            new = np.ones(len(rows), bool)
            new[1:] = (a[:, 0] != b[:, 0]) | (a[:, 1] + a[:, 2] != b[:, 1]) | (a[:, 3] != b[:, 3]) | (b[:, 4] - a[:, 4] != a[:, 2])
            first = np.flatnonzero(new)
            ends = np.append(first[1:], len(rows)) - 1
            made = rows[first].copy()
            made[:, 2] = rows[ends, 1] + rows[ends, 2] - made[:, 1]
            late = made[-1:]
            yield out(made[:-1])
        yield out(late)

    cols = ["id", "start", "n", "oid", "ostart"]
    return claims.select(cols).repartition(parts, "id").sortWithinPartitions("id", "start").mapInArrow(lean(run), "id long, start int, n int, oid long, ostart int")


def packed_texts(docs: DataFrame) -> DataFrame:
    """id and compressed text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([pack((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], names=["id", "packed"])

    return docs.mapInArrow(lean(run), "id long, packed binary")


_SETTLED = "kind byte, id long, start int, n int, digest binary, n_words long, n_removed long, kept binary"


def settle(docs: DataFrame, claims: DataFrame, digest: bool = False) -> DataFrame:
    """id, n_words, n_removed and kept of every row of docs (id, text).

    kept is the kept words joined by one blank, compressed, or with digest its SHA-256. One pass over the
    texts takes out the claimed words and gives the digests of both spans of every claim; documents with
    a claim whose digests differ are then done again without it.
    """
    own = claims.select("id", "start", "n", F.lit(True).alias("own"))
    spans = own.unionByName(claims.select(F.col("oid").alias("id"), F.col("ostart").alias("start"), "n", F.lit(False).alias("own"))).groupBy("id", "start", "n").agg(F.max("own").alias("own"), F.min("own").alias("alone"))
    done = materialize(_cut(docs, spans, digest), "settled")
    marks = done.filter("kind = 1").groupBy("id", "start", "n").agg(F.min("digest").alias("digest"), F.max("digest").alias("also"), F.min("n_removed").alias("alone"))
    # Places that others equal may be claimed by very many: their digests meet the claims in SPREAD tasks.
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    there = marks.filter("alone = 0").select(F.col("id").alias("oid"), F.col("start").alias("ostart"), "n", F.col("digest").alias("odigest"), F.col("also").alias("oalso"), parts.alias("part"))
    told = claims.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(marks.select("id", "start", "n", "digest", "also"), ["id", "start", "n"]).join(there, ["oid", "ostart", "n", "part"])
    same = (F.col("digest") == F.col("odigest")) & (F.col("digest") == F.col("also")) & (F.col("odigest") == F.col("oalso"))
    wrong = materialize(told.filter(~same).select("id", "start", "n", "oid", "ostart"), "refused")
    out = done.filter("kind = 0").select("id", "n_words", "n_removed", "kept")
    if not wrong.take(1):
        return out
    ids = wrong.select("id").distinct()
    right = claims.join(ids, "id", "left_semi").join(wrong, ["id", "start", "n", "oid", "ostart"], "left_anti")
    again = _cut(docs.join(ids, "id", "left_semi"), right.select("id", "start", "n", F.lit(True).alias("own"), F.lit(True).alias("alone")), digest).filter("kind = 0")
    return out.join(ids, "id", "left_anti").unionByName(again.select("id", "n_words", "n_removed", "kept"))


def _cut(docs: DataFrame, spans: DataFrame, digest: bool) -> DataFrame:
    """kind 0: every document without the words of its own spans. kind 1: the digest of every span."""
    grouped = spans.groupBy("id").agg(F.collect_list(F.struct("start", "n", "own", "alone")).alias("spans")).withColumnRenamed("id", "_id")  # distinct spans of one document
    both = packed_texts(docs).join(grouped, F.col("id") == F.col("_id"), "left").select("id", "packed", "spans")
    names = ["kind", "id", "start", "n", "digest", "n_words", "n_removed", "kept"]
    types = (pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        finish = (lambda body: hashlib.sha256(body).digest()) if digest else pack
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for doc, packed, want in zip(*(c.to_pylist() for c in part.columns)):
                    words = unpack(packed).split()
                    n, line = len(words), b" ".join(words)
                    kept = line
                    if want:
                        ends, out = np.cumsum([len(w) + 1 for w in words]).tolist(), np.zeros(n + 1, np.int64)
                        for s in want:
                            a, b = s["start"], s["start"] + s["n"] + WINDOW - 1
                            body = line[(ends[a - 1] if a else 0) : ends[b - 1] - 1] if b <= n else b""
                            rows.append((1, doc, a, s["n"], hashlib.blake2b(body, digest_size=16).digest(), None, int(s["alone"]), None))
                            if s["own"]:
                                out[a] += 1
                                out[min(n, b)] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(out[:-1]) == 0).tolist()]
                        kept = b" ".join(words)
                    rows.append((0, doc, None, None, None, n, n - len(words), finish(kept)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return both.mapInArrow(lean(run), _SETTLED)


def find_repeats(docs: DataFrame, batches: int | None = None) -> DataFrame:
    """Claims (id, start, n, oid, ostart) of a whole table of (id, text), as the longest spans."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    batches = batches or max(LEAST_BATCHES, -(-size // BATCH_BYTES))
    cuts = [k / batches for k in range(1, batches)]
    bounds = sorted(set(docs.agg(F.percentile_approx("id", cuts, 1000).alias("cuts")).first()["cuts"] or [])) if cuts else []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index, claims = FingerprintIndex(spark, max(2 * parts, -(-size // (batches * BUCKET_BYTES)))), []
    for k in range(len(bounds) + 1):
        part = docs if not bounds else docs.filter(((F.col("id") > bounds[k - 1]) if k else F.lit(True)) & ((F.col("id") <= bounds[k]) if k < len(bounds) else F.lit(True)))
        claims.append(index.ingest(part, keep=k < len(bounds)))
    index.close()
    out = materialize(longest(reduce(DataFrame.unionByName, claims)), "spans")
    discard(*claims)
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept (compressed, or with digest its SHA-256) of every row of docs."""
    lean = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return settle(lean, find_repeats(lean, batches), digest).withColumnRenamed("id", "doc_id")


def unpacked(kept: DataFrame, column: str = "kept") -> DataFrame:
    """The same rows with the compressed column as text."""
    names = [c for c in kept.columns if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = pa.array([unpack(x).decode() for x in part.column(len(names)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], texts], names=[*names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*names).schema.fields)
    return kept.select(*names, column).mapInArrow(lean(run), f"{schema}, `{column}` string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs with the repeated words taken out of its texts (and chars_col, if there is one, set to the new length)."""
    lean = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    done = settle(lean, find_repeats(lean)).filter("n_removed > 0").dropDuplicates(["id"])
    changed = unpacked(done.select("id", "kept"))
    out = docs.join(changed, docs[id_col].cast("long") == changed["id"], "left")
    new = {text_col: F.coalesce(changed["kept"], docs[text_col])}
    if chars_col in docs.columns:
        new[chars_col] = F.when(changed["kept"].isNotNull(), F.length(changed["kept"]).cast(docs.schema[chars_col].dataType)).otherwise(docs[chars_col])
    return out.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
