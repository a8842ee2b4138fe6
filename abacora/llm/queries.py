"""The registered queries of the llm operators and their SQL where SQL can say the same."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroid_clustering, chat_perspectives, decontaminate, hidden_markov, jaccard_join, language_id, license_scan, matroska, periodic_runs, substring_index, toxicity, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, fold("doc_id", 4) != 2)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_index.deduplicate(table(spark, sf_dir, "documents"), digest=True)
    return found.select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept")).alias("kept_sha256"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return made.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels.filter(fold("doc_id", 5) != 0)))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.decode(matroska.encode(table(spark, sf_dir, "documents")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op9_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_perspectives.rotate(table(spark, sf_dir, "conversations"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = hidden_markov.train_and_score(docs, fold("doc_id", 7) != 2)
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.runs(table(spark, sf_dir, "documents"), number=F.crc32(F.col("doc_id").cast("string").cast("binary")), text_out=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {
    "op1_warc_zip": op1_warc_zip,
    "op2_decontaminate": op2_decontaminate,
    "op3_license_scan": op3_license_scan,
    "op4_language_id": op4_language_id,
    "op5_substring_index": op5_substring_index,
    "op6_bpe": op6_bpe,
    "op7_toxicity": op7_toxicity,
    "op8_matroska": op8_matroska,
    "op9_chat_perspectives": op9_chat_perspectives,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_hidden_markov": op12_hidden_markov,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_warc_zip": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        w AS (SELECT payload, max(page_id) AS winner FROM p GROUP BY payload),
        h AS (SELECT p.page_id, w.winner, octet_length(p.payload) AS n, sha1(p.payload) AS hex FROM p JOIN w USING (payload)),
        bits AS (SELECT h.*, (SELECT string_agg(lpad(bin(CAST('0x' || substr(hex, CAST(i AS INTEGER), 1) AS INTEGER)), 4, '0'), '' ORDER BY i) FROM range(1, 41) t(i)) AS b FROM h)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER) + 4 * CAST(substr(b, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(b, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER) + CAST(substr(b, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER), 1), '' ORDER BY i) FROM range(0, 32) t(i)) AS payload_digest,
               CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> winner THEN winner END AS refers_to
        FROM bits""",
    "op3_license_scan": license_scan.ORACLE,
    "op9_chat_perspectives": chat_perspectives.ORACLE,
}
