"""Parts of the llm operators that need no Spark."""

import gzip
import io
import random
import zipfile

import numpy as np
import pytest

from abacora.llm import bpe, jaccard_join, matroska, substring_index, toxicity, warc_zip
from abacora.llm._shared import chunks, hash_words, scan_words, window_hashes

P = pytest.importorskip("public_tokenizers")


def buffers(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def test_words_are_those_of_split():
    texts = ["", " a  b\tc\n", "x", "  ", "é ü\x0bz", "A a"]
    data, offsets = buffers(texts)
    s, e, r = scan_words(data, offsets)
    assert [(int(k), bytes(data[a:b])) for a, b, k in zip(s, e, r)] == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]
    h = hash_words(data, s, e, lower=True)
    assert h[-1] == h[-2] and len(set(h.tolist())) == len(h) - 2  # A and a; "a" of row 1 is the same word


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    from abacora.llm import _shared

    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcé", k=rng.randint(1, 40))) for _ in range(50)) for _ in range(8)] + ["x" * 900]
    data, offsets = buffers(texts)
    s, e, _ = scan_words(data, offsets)
    whole = hash_words(data, s, e)
    monkeypatch.setattr(_shared, "_BLOCK", 64)
    assert (hash_words(data, s, e) == whole).all()
    assert len(window_hashes(whole[:3], 5)) == 0
    assert sum(j - i for i, j, _, _ in chunks(data, offsets, 100)) == len(texts)


@pytest.fixture(scope="module")
def coder():
    return bpe.load(P.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(coder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    pool = [*"abc ABC 019'.,;!?\n\t\r", "'s", "'ll", " the", " ", " ", "　", "\x85", "\x1c", "é", "é", "中", "😀", "‍", "½", "<|endoftext|>", "<|", "|>"]
    texts = ["", " ", "  x", "<|endoftext|>", "a" * 2000, "ab" * 700] + ["".join(rng.choices(pool, k=rng.randint(1, 40))) for _ in range(3000)]
    for text, ref in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == ref.ids
        assert coder.decode(ids) == t.decode(ref.ids, skip_special_tokens=False) == text


def test_short_and_long_words_agree(coder):
    rng = random.Random(3)
    for _ in range(300):
        w = bytes(rng.choices(b"thequickabc\xc3\xa9 ", k=rng.randint(1, 200)))
        assert coder.short_word(w) == coder.long_word(w)


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 576 * 65, 300_001])
def test_matroska_round_trip(size):
    payload = matroska.padded(random.Random(size).randbytes(size))
    data = matroska.mux(payload)
    m = matroska.parse(data)
    assert matroska.payload(data, m) == payload and len(payload) % 576 == 0 and payload
    assert [c[2] for c in m.cues] == m.clusters and m.tracks == {1: ("A_PCM/INT/LIT", 8000.0)}
    assert [p[1] for p in m.packets] == [i * 72_000_000 for i in range(len(payload) // 576)]


@pytest.mark.parametrize("lacing", [1, 2, 3])
def test_lacing(lacing):
    sizes = [600, 600, 600] if lacing == 2 else [3, 700, 255, 0, 510]
    frames = [bytes([i]) * n for i, n in enumerate(sizes)]
    body = matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.uint(matroska.TIMESTAMP, 5) + matroska.element(matroska.BLOCK_GROUP, matroska.element(matroska.BLOCK, matroska.block(1, 7, frames, lacing)))))
    m = matroska.parse(matroska.HEADER + body)
    assert [(matroska.HEADER + body)[f : f + n] for _, _, f, n in m.packets] == frames and m.packets[0][1] == 12_000_000


def test_damaged_matroska_is_refused():
    data = matroska.mux(matroska.padded(b"abc"))
    with pytest.raises((ValueError, IndexError)):
        matroska.parse(data[:-40] + b"\0" * 40)


@pytest.mark.parametrize("force_old", [False, True])
def test_zip_reader(force_old):

    out = io.BytesIO()
    if force_old:  # another writer's archive, with a comment and a packed member
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("archive/data.warc.gz", b"0123456789")
            z.writestr("é.txt", b"x" * 99, zipfile.ZIP_DEFLATED)
            z.comment = b"PK\x05\x06 in a comment"
    else:
        w = warc_zip.ZipWriter(out)
        for name, body in (("archive/data.warc.gz", b"0123456789"), ("é.txt", b"")):
            w.begin(name)
            w.write(body)
            w.end()
        assert w.close() == len(out.getvalue())
        assert zipfile.ZipFile(io.BytesIO(out.getvalue())).read("archive/data.warc.gz") == b"0123456789"
    z = warc_zip.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    at, n = z.stored("archive/data.warc.gz")
    assert z.read(at + 2, 3) == b"234" and n == 10 and "é.txt" in z.members
    if force_old:
        with pytest.raises(ValueError, match="stored"):
            z.stored("é.txt")
    with pytest.raises(ValueError):
        warc_zip.ZipReader(io.BytesIO(b"no zip"), 6)


def test_archives_of_other_writers():
    """Several data members, a CDXJ index packed as gzip, a classic index packed by the archive, a record without an id of ours."""
    one = [gzip.compress(warc_zip.record(i, f"http://b.a/{i}", b"x" * i)) for i in range(3)]
    strange = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: text/plain\r\nContent-Length: 7\r\n\r\na\r\n\r\nbc\r\n\r\n"
    two = gzip.compress(strange)
    out = io.BytesIO()
    starts = [0, len(one[0]), len(one[0]) + len(one[1])]
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/one.warc.gz", b"".join(one))
        z.writestr("archive/two.warc.gz", b"skip" + two)
        z.writestr("datapackage.json", "{}", zipfile.ZIP_DEFLATED)
        lines = ['!meta 0 {"format": "x"}\n'] + [warc_zip.index_line(f"http://b.a/{i}", "D", False, "one.warc.gz", starts[i], len(one[i])) for i in (2, 0, 1, 0)]
        z.writestr("indexes/index.cdx.gz", gzip.compress("".join(lines[:2]).encode()) + gzip.compress("".join(lines[2:]).encode()))
        z.writestr("indexes/two.cdx", f" CDX N b a m s k r M S V g\nk 1 u text/plain 200 D - - {len(two)} 4 two.warc.gz\n", zipfile.ZIP_DEFLATED)
    archive = warc_zip.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    found = list(warc_zip.locate(archive))
    assert [r for _, r in found] == [list(zip(starts, map(len, one))), [(4, len(two))]]
    rows = [warc_zip._row(archive.read(first + a, n), True) for first, ranges in found for a, n in ranges]
    assert [(r[0], r[1], r[3], r[6]) for r in rows] == [(0, 0, "response", b""), (1, 1, "response", b"x"), (2, 2, "response", b"xx"), (None, 7, "resource", b"a\r\n\r\nbc")]
    assert warc_zip.sort_key("http://b.a/2?q") == "a,b)/2" and warc_zip.sort_key("urn:page:1") == "urn:page:1"


def test_archives_with_faults():
    for members, said in (({"archive/a.warc.gz": b""}, "no index"), ({"indexes/i.cdxj": b'k 1 {"filename": "b", "offset": 0, "length": 1}'}, "names b")):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, body in members.items():
                z.writestr(name, body)
        with pytest.raises(ValueError, match=said):
            list(warc_zip.locate(warc_zip.ZipReader(io.BytesIO(out.getvalue()), len(out.getvalue()))))


def test_warc_records():
    raw = warc_zip.record(5, "http://x/a b\r\nWARC-Type: evil", b"\r\n\r\nbody\r\n")
    warc, http, payload = warc_zip.parse_record(raw)
    assert payload == b"\r\n\r\nbody\r\n" and warc["warc-type"] == "response" and http["content-length"] == "10"
    warc, http, payload = warc_zip.parse_record(warc_zip.record(None, None, b"abc", 7, True))
    assert payload == b"" and http["content-length"] == "3" and warc["warc-refers-to"] == "<urn:page:7>"


def test_prefix_keys_meet_every_linked_pair():
    """Any two sets over the threshold share a key, whatever the order and the boundary, and what is left allows it."""
    rng = np.random.default_rng(5)
    for trial in range(400):
        n = int(rng.integers(1, 60))
        a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
        b = np.concatenate([a[rng.random(n) > rng.random() * 0.3], rng.integers(1 << 40, 1 << 41, int(rng.integers(0, 1 + n // 4))).astype(np.uint64)])
        inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if not len(b) or 100 * inter < 75 * union or (len(a) == 1 == len(b)) or set(a) == set(b):
            continue
        common = np.sort(rng.choice(a, min(n, 5), replace=False))
        levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
        levels[jaccard_join._bucket(common)] = np.arange(1, len(common) + 1)
        order = jaccard_join.Order(levels)
        for boundary in (0, 4, 12, 30):
            out = []
            for s in (a, b):
                s = np.sort(s)
                k, _, left, _ = jaccard_join.keys(s, np.zeros(len(s), np.int64), np.array([len(s)]), order, boundary)
                out.append({int(x): len(s) << 32 | int(y) for x, y in zip(k, left)})
            shared = out[0].keys() & out[1].keys()
            assert any(jaccard_join._fits(np.int64(out[0][k]), np.int64(out[1][k])) for k in shared), (trial, boundary)


def test_runs_keep_the_earliest_place():
    one = tuple(np.array(x, t) for x, t in (([3, 5], np.uint64), ([1, 1], np.int64), ([0, 9], np.int64)))
    two = tuple(np.array(x, t) for x, t in (([3, 7], np.uint64), ([2, 2], np.int64), ([4, 4], np.int64)))
    both = substring_index.merged([one, two])
    assert [x.tolist() for x in both] == [[3, 5, 7], [1, 1, 2], [0, 9, 4]]
    blocks = lambda run, k: iter([tuple(x[i : i + k] for x in run) for i in range(0, len(run[0]), k)])
    rng = np.random.default_rng(8)
    runs = [(np.unique(rng.integers(0, 300, 90)).astype(np.uint64),) for _ in range(3)]
    runs = [(h, np.full(len(h), k), np.arange(len(h))) for k, (h,) in enumerate(runs)]
    for k in (1, 7, 1000):
        parts = list(substring_index.merge_runs([blocks(r, k) for r in runs] + [iter([])]))
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*parts), substring_index.merged(runs)))
    q, at = substring_index.merge_join(runs[0][0], runs[1][0])
    assert (runs[0][0][q] == runs[1][0][at]).all() and len(q) == len(np.intersect1d(runs[0][0], runs[1][0]))
    assert [x.tolist() for x in substring_index.unpack_run(substring_index.pack_run(*both))] == [x.tolist() for x in both]


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.2
    votes = np.zeros((4000, 6), np.int8)
    for v, acc in enumerate((0.95, 0.9, 0.85, 0.8, 0.6, 0.5)):
        right = rng.random(4000) < acc
        votes[:, v] = np.where(rng.random(4000) < 0.3, 0, np.where(right == y, 1, -1))
    post, table, corr = toxicity.label_model(votes, 0.2)
    assert ((post > 0.5) == y).mean() > 0.95 and table[1, 0, 2] > table[1, 4, 2] and corr.shape == (6, 6)


def test_matroska_of_unknown_sizes_and_durations():
    """A live recording: segment and clusters of unknown size, laces without a default duration, a seek by cues."""
    m = matroska
    open_ = lambda kind, body: kind.to_bytes(4, "big") + b"\xff" + body
    audio = m.element(m.AUDIO, m.element(m.SAMPLING, b"\x45\xfa\x00\x00") + m.uint(m.CHANNELS, 2) + m.uint(m.BITS, 16))  # 8000 Hz
    tracks = m.element(m.TRACKS, m.element(m.TRACK, m.uint(m.TRACK_NUMBER, 1) + m.element(m.CODEC, b"A_PCM/INT/LIT") + audio) + m.element(m.TRACK, m.uint(m.TRACK_NUMBER, 2) + m.uint(m.DEFAULT_DURATION, 5_000_000)) + m.element(m.TRACK, m.uint(m.TRACK_NUMBER, 3)))
    cluster = lambda t, *blocks: open_(m.CLUSTER, m.uint(m.TIMESTAMP, t) + b"".join(blocks))
    simple = lambda track, frames: m.element(m.SIMPLE_BLOCK, m.block(track, 1, frames, 3))
    body = tracks + cluster(10, simple(1, [b"a" * 320, b"b" * 320])) + cluster(40, simple(2, [b"c", b"dd"]), m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(3, 1, [b"e", b"ff"], 1)))) + m.element(m.TAGS, b"") + cluster(70, simple(2, [b"g"]))
    media = m.parse(m.HEADER + open_(m.SEGMENT, body) + m.HEADER)
    assert len(media.clusters) == 3
    assert [(t, time // 1_000_000, n) for t, time, _, n in media.packets] == [(1, 11, 320), (1, 21, 320), (2, 41, 1), (2, 46, 2), (3, 41, 1), (3, 41, 2), (2, 71, 1)]
    data = m.mux(bytes(range(256)) * 576)
    whole, late = m.parse(data), m.read_from(data, 100 * 72_000_000)
    assert late.packets == whole.packets[64:] and m.read_from(data, 0).packets == whole.packets and late.cues == whole.cues
