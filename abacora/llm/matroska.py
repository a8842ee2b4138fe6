"""Media columns as Matroska: payloads stored as 8-bit samples, read back from packet tables.

mux() lays a payload into one file: EBML header, segment info, one 8-bit PCM track, clusters of
laced simple blocks and cues. parse() reads files by their variable-length elements: unknown
elements are skipped by their size; a segment or cluster of unknown size, as live recordings have, ends at the
next element of a level above its children; clusters and blocks (simple or grouped) are walked, Xiph, EBML
and fixed-size lacing are resolved, and every frame becomes a packet with track, timestamp and byte
range; frames of a lace follow each other by the track's default duration, else by what their bytes last as PCM,
else they share the block's time. Cues become (time, track, cluster position); read_from() seeks by them and
walks no cluster before. The payload is the packets' ranges in order.

Edge cases: null text counts as empty; an empty payload is padded to one frame; equal texts give
equal files, as nothing random or dated is stored; rows repeat as given; only id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

FRAME = 576
RATE = 8000
LACED = 8
CLUSTER_FRAMES = 64
PAD = b"\xff"

#: Element ids of the Matroska specification.
EBML, EBML_VERSION, EBML_READ, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC, AUDIO, SAMPLING, CHANNELS, BITS = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What ends an element of unknown size: elements that can't be its children.
_ENDS = {SEGMENT: {EBML, SEGMENT}, CLUSTER: {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}}


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _lace(sizes: list[int], kind: int) -> bytes:
    """The lacing head of a block's frames: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return b""
    out = bytes([len(sizes) - 1])
    if kind == 1:
        return out + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    if kind == 3:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1))
            out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return out


def block(track: int, relative: int, frames: list[bytes], lacing: int = 2) -> bytes:
    lacing = lacing if len(frames) > 1 else 0
    return vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1) + _lace([len(f) for f in frames], lacing) + b"".join(frames)


HEADER = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ, 2))
FRAME_MS = FRAME * 1000 // RATE
_TRACKS = element(TRACKS, element(TRACK, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(LACING, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BITS, 8))))


def padded(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of a frame."""
    return text + PAD * (-len(text) % FRAME or (FRAME if not text else 0))


def mux(payload: bytes) -> bytes:
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    parts = [element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXER, b"abacora") + element(WRITER, b"abacora")), _TRACKS]
    at, cues = sum(map(len, parts)), []
    for c in range(0, len(frames), CLUSTER_FRAMES):
        blocks = [uint(TIMESTAMP, c * FRAME_MS)]
        for n, i in enumerate(range(c, min(c + CLUSTER_FRAMES, len(frames)), LACED)):
            # The lacings take turns, so that reading back meets all three.
            blocks.append(element(SIMPLE_BLOCK, block(1, (i - c) * FRAME_MS, frames[i : min(i + LACED, c + CLUSTER_FRAMES)], (2, 3, 1)[n % 3])))
        cues.append(element(CUE_POINT, uint(CUE_TIME, c * FRAME_MS) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(blocks)))
        at += len(parts[-1])
    return HEADER + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, tuple[str, float]] = field(default_factory=dict)
    #: ns of a frame by track, and bytes of a second of PCM by track
    durations: dict[int, int] = field(default_factory=dict)
    rates: dict[int, float] = field(default_factory=dict)
    #: track, timestamp in ns, first byte, size
    packets: list[tuple[int, int, int, int]] = field(default_factory=list)
    #: time in ns, track, cluster's first byte
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """Value (its marker bit kept for ids), width; the value of all ones is -1: unknown size."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - first.bit_length()
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width, width
    n &= (1 << 7 * width) - 1
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width, width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, element's first byte, body's first byte, body's end)."""
    while at < end:
        kind, body, _ = read_vint(data, at, keep=True)
        size, body, _ = read_vint(data, body)
        stop = _open_end(data, body, end, kind) if size < 0 else body + size
        if stop > end:
            raise ValueError(f"element at byte {at} ends beyond its parent")
        yield kind, at, body, stop
        at = stop


def _open_end(data: bytes, at: int, end: int, kind: int) -> int:
    """Where an element of unknown size ends: before the first element that can't be in it, else with its parent."""
    while at < end:
        child, body, _ = read_vint(data, at, keep=True)
        if child in _ENDS.get(kind, ()):
            return at
        size, body, _ = read_vint(data, body)
        at = _open_end(data, body, end, child) if size < 0 else body + size
    return end


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    track, at, _ = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if not lacing:
        return track, relative, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    if lacing == 2:
        size = (end - at) // n
        return track, relative, [(at + i * size, size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            size, at, width = read_vint(data, at)
            if i:
                size = sizes[-1] + size - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return track, relative, out


def parse(data: bytes, clusters: bool = True) -> Media:
    """The file's tables; without clusters only what stands outside of them is read."""
    media = Media()
    for kind, _, body, stop in elements(data, 0, len(data)):
        if kind == SEGMENT:
            _segment(data, body, stop, media, clusters)
    return media


def read_from(data: bytes, time_ns: int) -> Media:
    """The tables with the packets from the last cue at or before a time on (all, if there is none)."""
    media = parse(data, clusters=False)
    places = [place for time, _, place in media.cues if time <= time_ns]
    for kind, at, body, stop in elements(data, max(places) if places else media.clusters[0], len(data)) if media.clusters else ():
        if kind == CLUSTER:
            _cluster(data, body, stop, media)
    return media


def _number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _real(raw: bytes) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[len(raw)], raw)[0] if raw else 0.0


def _track(data: bytes, start: int, end: int, media: Media) -> None:
    inner = {k: (b, s) for k, _, b, s in elements(data, start, end)}
    audio = {k: data[b:s] for k, _, b, s in elements(data, *inner[AUDIO])} if AUDIO in inner else {}
    number, codec, rate = _number(data, *inner[TRACK_NUMBER]), data[slice(*inner[CODEC])].decode() if CODEC in inner else "", _real(audio.get(SAMPLING, b""))
    media.tracks[number] = (codec, rate)
    if DEFAULT_DURATION in inner:
        media.durations[number] = _number(data, *inner[DEFAULT_DURATION])
    elif codec.startswith("A_PCM"):
        whole = lambda k, default: int.from_bytes(audio[k], "big") if k in audio else default
        media.rates[number] = rate * whole(CHANNELS, 1) * whole(BITS, 8) / 8


def _cluster(data: bytes, start: int, end: int, media: Media) -> None:
    base = 0
    for k, _, b, s in elements(data, start, end):
        if k == TIMESTAMP:
            base = _number(data, b, s)
        for b2, s2 in [(b, s)] if k == SIMPLE_BLOCK else [(x[2], x[3]) for x in elements(data, b, s) if x[0] == BLOCK] if k == BLOCK_GROUP else []:
            track, relative, frames = _frames(data, b2, s2)
            time = (base + relative) * media.scale
            for f, n in frames:
                media.packets.append((track, time, f, n))
                rate = media.rates.get(track, 0.0)
                time += media.durations.get(track, int(n * 1_000_000_000 / rate) if rate else 0)


def _segment(data: bytes, start: int, end: int, media: Media, clusters: bool) -> None:
    number = lambda b, s: _number(data, b, s)
    for kind, at, body, stop in elements(data, start, end):
        if kind == INFO:
            media.scale = next((number(b, s) for k, _, b, s in elements(data, body, stop) if k == TIMESTAMP_SCALE), media.scale)
        elif kind == TRACKS:
            for k, _, b, s in elements(data, body, stop):
                if k == TRACK:
                    _track(data, b, s, media)
        elif kind == CLUSTER:
            media.clusters.append(at)
            if clusters:
                _cluster(data, body, stop, media)
        elif kind == CUES:
            for k, _, b, s in elements(data, body, stop):
                if k == CUE_POINT:
                    time, track, place = 0, 0, 0
                    for k2, _, b2, s2 in elements(data, b, s):
                        if k2 == CUE_TIME:
                            time = number(b2, s2)
                        elif k2 == CUE_POSITIONS:
                            inner = {k3: number(b3, s3) for k3, _, b3, s3 in elements(data, b2, s2)}
                            track, place = inner.get(CUE_TRACK, 0), inner[CUE_CLUSTER]
                    media.cues.append((time * media.scale, track, start + place))


def payload(data: bytes, media: Media) -> bytes:
    return b"".join([data[f : f + n] for _, _, f, n in media.packets])


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
ROWS = 256


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (before padding) and the file as a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], schema=_MEDIA)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame) -> DataFrame:
    """The packet table of encode()'s files: doc_id, packet, track, time_ns, first_byte, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse(data).packets
                cols = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "packet", "track", "time_ns", "first_byte", "size"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, packet long, track long, time_ns long, first_byte long, size long")


def cues(media: DataFrame) -> DataFrame:
    """The cue table of encode()'s files: doc_id, cue, time_ns, track, first_byte (of the cluster)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = parse(data, clusters=False).cues
                cols = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "cue", "time_ns", "track", "first_byte"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, cue long, time_ns long, track long, first_byte long")


DECODED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType()),
    T.StructField("n_packets", T.LongType()), T.StructField("n_clusters", T.LongType()), T.StructField("duration_ms", T.LongType()),
])


def features(samples: np.ndarray) -> str:
    """Mean, root of the mean square and crossings of the middle, of unsigned samples, in exact thousandths."""
    x = samples.astype(np.int64) - 128
    n = len(x)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"mean={int(x.sum()) * 1000 // n};energy={int((x * x).sum()) * 1000 // n};crossings={crossings};peak={int(np.abs(x).max())}"


def decode(media: DataFrame) -> DataFrame:
    """Reads the stored files back and describes payload and file, a row per row of media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, n, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                m = parse(data)
                if [c[2] for c in m.cues] != m.clusters:
                    raise ValueError(f"cues of {i} do not point at its clusters")
                back = payload(data, m)
                rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(np.frombuffer(back, np.uint8)), len(m.packets), len(m.clusters), len(m.packets) * FRAME_MS))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*rows)], names=DECODED.names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)
