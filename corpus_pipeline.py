"""The corpus pipeline: language ID, near duplicates, substring dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of documents. run() writes each stage's result to the shared folder and reads
it back for the next. No single SQL statement says the same (trained filters, fixed-point
components), so ORACLE_SQL is None; tests compare with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abacora.llm import bpe, decontaminate, jaccard_join, language_id, queries, substring_index
from abacora.llm._shared import discard, materialize, scratch_scope


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in no learned language (none, no letter, or too few known n-grams) go; filters learn as op4's do."""
    return language_id.keep_identified(docs, language_id.train(docs, queries.fold("doc_id", 4) != 2))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays."""
    return jaccard_join.keep_one(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that occur earlier go; a document that loses none keeps its text as it is."""
    return substring_index.without_repeats(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and digests of every document that is left."""
    made = bpe.encode_decode(docs, queries.tokenizer_path())
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", identify_language), ("jaccard_join", join_near_duplicates), ("substring_dedup", remove_repeats), ("decontaminate", drop_leaks), ("bpe", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch_scope(spark, kept):
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
        # What a stage read and what it wrote on its way is not needed any more.
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
