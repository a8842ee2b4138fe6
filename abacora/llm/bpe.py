"""BPE encoding and decoding with a contiguous rank array per short word.

The vocabulary is a byte-level BPE file of the tokenizers library (vocab, merges, added tokens).
A text is cut at added tokens, then into words by the byte-level pattern. A word's part ids and
the merge ranks of neighbouring parts lie in two short lists; the smallest rank is looked for by a
scan, its boundary deleted and the two neighbouring ranks refreshed. Words of more than
SHORT_BYTES bytes would make repeated scans quadratic and take a heap over a linked list instead,
with the same order of merges. Distinct words are remembered per Python worker, up to twice CACHE_WORDS.

Edge cases: null text counts as empty and yields no ids and the empty text; rows repeat as given;
other columns of the input are not looked at; an empty table yields an empty table.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import lean

SHORT_BYTES = 256
CACHE_WORDS = 300_000
#: Fixed value: the byte-level pre-tokenizer's pattern, white space by its Unicode property.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
NONE = 1 << 40


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        size = 1 + max([*vocab.values(), *self.added.values()])
        pieces = [b""] * size
        for token, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in token)
        for token, i in self.added.items():
            pieces[i] = token.encode()
        self.byte_id = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        self.split = regex.compile(WORD_PATTERN).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.places = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.words = _Words(self)

    def short_word(self, word: bytes) -> list[int]:
        rank_of, ids = self.ranks.get, list(map(self.byte_id.__getitem__, word))
        ranks = [rank_of(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            ids[i] = new = self.made[least]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | new, NONE)
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | ids[i + 1], NONE)
        return ids

    def long_word(self, word: bytes) -> list[int]:
        rank_of, ids, n = self.ranks.get, [self.byte_id[b] for b in word], len(word)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of(ids[i] << 32 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank_of(ids[a] << 32 | ids[b], NONE)) < NONE:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(t in text for t in self.added):
            return b"".join(map(self.words.__getitem__, self.split(text)))
        out = []
        for part in self.cut(text):
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
            else:
                out.extend(map(self.words.__getitem__, self.split(part)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(np.frombuffer(ids, "<u4")).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), 1 << 17):
            part = ids[i : i + (1 << 17)]
            sizes = self.lengths[part]
            ends = np.cumsum(sizes)
            out.append(self.flat[np.repeat(self.places[part] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


class _Words(dict):
    """Two generations: what was met since the last but one time the cache was full stays."""

    def __init__(self, bpe: RankArrayBPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            raw = word.encode()
            if len(raw) > SHORT_BYTES:
                return np.array(self.bpe.long_word(raw), "<u4").tobytes()
            ids = self.bpe.short_word(raw)
            made = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = made
        return made


@lru_cache(maxsize=4)
def load(path: str) -> RankArrayBPE:
    return RankArrayBPE(path)


ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
#: Rows handed back at once; keeps Arrow batches of long documents small.
ROWS = 256


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the text decoded from those ids, a row per row of docs.

    vocabulary is a path that every executor can open; it is read once per Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                decoded = [bpe.decode(x) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], schema=_SCHEMA)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), ENCODED)
