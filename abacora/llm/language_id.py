"""Language identification by bit-sliced Bloom filters over byte n-grams.

Every slot of one table holds a bit mask with a bit per language, so the AND of a gram's few slots
returns all languages whose filter holds the gram. A text's grams are looked up at once; the set
bits are counted per language and the counts corrected for each filter's false positives. The
language with the largest share of what its own training text reaches decides.

Training reads at most about SAMPLE_ROWS labelled rows (a documented bound: rows are chosen per
language by a hash of the id, at a rate that makes the expected number at most SAMPLE_ROWS for
each language); every other count covers all rows.

As a filter the operator keeps a text whose best language's corrected share is at least EVIDENCE of
what that language's own training text reaches; a text in a language that nothing was learned of, or in
none, is rejected.

Edge cases: text null or without a letter gives 'und' and score 0. A text with letters none of
whose grams is known gets the first language and score 0. Very long texts are read block by block. Labels that are null are not learned.
Ties go to the alphabetically first language. Rows repeat as given; an
empty training set gives the empty language to texts with letters; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ._shared import chunks, lean, mix, text_buffers

GRAM = 5
SAMPLE_ROWS = 3000
GRAMS_PER_LANGUAGE = 40_000
#: A gram joins a language's filter when its rate there is at least this share of its highest rate.
SHARE = 0.4
HASHES = 3
SLOT_BITS = 20
#: A text whose best share is below this part of its language's own is in no known language.
EVIDENCE = 0.1
#: Text bytes whose grams are looked up at once.
BLOCK_BYTES = 1 << 18
#: Text bytes that are lowered at once.
TEXT_BYTES = 1 << 20
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])
PREDICTED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def _lowered(column: pa.Array) -> pa.Array:
    """Lower case with blanks around, so that the shortest text has grams."""
    text = pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))
    edge = pa.scalar(" " * (GRAM - 2), pa.large_string())
    return pc.binary_join_element_wise(edge, text, edge, pa.scalar("", pa.large_string()))


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Packed GRAM-byte grams that lie within a row, and their rows, of every block. White space, digits and ASCII signs count as one blank."""
    last = len(data) - GRAM + 1
    for a in range(0, last, BLOCK_BYTES):
        n = min(BLOCK_BYTES, last - a)
        part = _FOLD[data[a : a + n + GRAM - 1]]
        packed = np.zeros(n, np.uint64)
        for i in range(GRAM):
            packed |= part[i : i + n].astype(np.uint64) << np.uint64(8 * i)
        rows = np.searchsorted(offsets, np.arange(a, a + n + GRAM - 1), "right") - 1
        inside = rows[:n] == rows[GRAM - 1 :]
        yield packed[inside], rows[:n][inside]


def _lowered_parts(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, lowered texts) of consecutive rows of about TEXT_BYTES."""
    _, offsets = text_buffers(column)
    for i, j, _, _ in chunks(np.zeros(0, np.uint8), offsets, TEXT_BYTES):
        yield i, j, _lowered(column[i:j])


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [b if chr(b).isalpha() else 32 for b in range(128)]


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    h = mix(grams)
    step = mix(h) | np.uint64(1)
    return [((h + np.uint64(i) * step) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for i in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray
    own_rate: np.ndarray

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Grams of each row, and by row and language how many of them that language's filter holds."""
        rows_n = len(offsets) - 1
        totals, out = np.zeros(rows_n, np.int64), np.zeros((rows_n, len(self.languages)))
        for grams, rows in _grams(data, offsets):
            totals += np.bincount(rows, minlength=rows_n)
            slots = _slots(grams)
            for word in range(self.masks.shape[1]):
                mask = self.masks[slots[0], word]
                for s in slots[1:]:
                    mask &= self.masks[s, word]
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    found = (mask >> np.uint64(bit)) & np.uint64(1) != 0
                    out[:, 64 * word + bit] += np.bincount(rows[found], minlength=rows_n)
        return totals, out

    def shares(self, totals: np.ndarray, hits: np.ndarray) -> np.ndarray:
        rate = np.clip((hits / np.maximum(totals, 1)[:, None] - self.false_rate) / np.maximum(1 - self.false_rate, 1e-9), 0, None)
        return rate / np.maximum(self.own_rate, 1e-9)


def sample(labelled: DataFrame, lang_col: str, id_col: str) -> DataFrame:
    """About SAMPLE_ROWS rows of each language at most, by a hash of the id."""
    sizes = labelled.groupBy(lang_col).count().select(F.col(lang_col).alias("_lang"), (F.lit(float(SAMPLE_ROWS)) / F.col("count")).alias("_rate"))
    u = F.pmod(F.xxhash64(F.lit(17), labelled[id_col]), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return labelled.join(F.broadcast(sizes), labelled[lang_col] == F.col("_lang")).filter(u < F.col("_rate")).drop("_rate", "_lang")


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> LanguageFilters:
    """Filters learned from the rows of docs where usable holds and the label is not null."""
    rows = docs.filter(usable & docs[lang_col].isNotNull()).select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), docs[text_col].cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for i, j, lower in _lowered_parts(batch.column(1)):
                data, offsets = text_buffers(lower)
                parts = list(_grams(data, offsets))
                grams, rows = (np.concatenate([p[k] for p in parts]) for k in range(2))
                for lang in set(langs[i:j]):
                    found, n = np.unique(grams[(langs[i:j] == lang)[rows]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counts = sample(rows, "lang", "id").select("lang", "text").mapInArrow(lean(count), _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # A gram met once in a sample says nothing about the language.
    rated = counts.filter("n > 1").withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    fit = rated.withColumn("top", F.max("rate").over(Window.partitionBy("gram"))).filter(F.col("rate") >= SHARE * F.col("top"))
    best = fit.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("rate"), "gram"))).filter(F.col("place") <= GRAMS_PER_LANGUAGE)
    got = best.select("lang", "gram", "rate").toPandas()  # languages x GRAMS_PER_LANGUAGE rows at most
    return build(got["lang"].to_numpy(), got["gram"].to_numpy().astype(np.uint64), got["rate"].to_numpy())


def build(langs: np.ndarray, grams: np.ndarray, rates: np.ndarray) -> LanguageFilters:
    names = sorted(set(langs))
    masks = np.zeros((1 << SLOT_BITS, max(1, -(-len(names) // 64))), np.uint64)
    own = np.zeros(len(names))
    for k, lang in enumerate(names):
        own[k] = rates[langs == lang].sum()
        for s in _slots(grams[langs == lang]):
            masks[s, k // 64] |= np.uint64(1 << (k % 64))
    filled = np.array([((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(names))])
    return LanguageFilters(names, masks, filled**HASHES, own)


def decide(texts: pa.Array, f: LanguageFilters) -> tuple[list[str], list[float], list[float]]:
    """Language, score and evidence (the best corrected share) of each text. Without any learned language a text with letters has the empty language."""
    best: list[str] = []
    score: list[float] = []
    evidence: list[float] = []
    names = f.languages or [""]
    for i, j, lower in _lowered_parts(texts):
        shares = f.shares(*f.hits(*text_buffers(lower))) if f.languages else np.zeros((j - i, 1))
        top, total = shares.argmax(1), shares.sum(1)
        for r in range(j - i):
            letters = _LETTER.search(lower[r].as_py()) is not None
            best.append(names[top[r]] if letters else UNDETERMINED)
            score.append(float(min(1.0, shares[r, top[r]] / total[r])) if letters and total[r] > 0 else 0.0)
            evidence.append(float(shares[r, top[r]]) if letters else 0.0)
    return best, score, evidence


def predict(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (the winner's part of all languages' shares) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a slot for every 64 languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, _ = decide(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(lean(run), PREDICTED)


def identify(docs: DataFrame, usable: Column) -> DataFrame:
    """Trains on the usable labelled rows of docs and predicts every row."""
    return predict(docs, train(docs, usable))


def keep_identified(docs: DataFrame, filters: LanguageFilters, text_col: str = "text", evidence: float = EVIDENCE) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language.

    A text is rejected if it is null, has no letter, or reaches less than `evidence` of its best language's
    own share. Where nothing could be learned, only texts without a letter are rejected.
    """
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for batch in batches:
            texts = batch.column(at)
            for i, j, _, _ in chunks(np.zeros(0, np.uint8), text_buffers(texts)[1], 4 * TEXT_BYTES):
                found, _, share = decide(texts[i:j], f)
                keep = [x != UNDETERMINED and (not f.languages or e >= evidence) for x, e in zip(found, share)]
                yield batch.slice(i, j - i).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
