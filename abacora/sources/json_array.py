"""A JSON array read by many tasks (SRC1, SRC2), however few lines or files it has.

The file is read as pieces that end in '}', which Hadoop's reader finds from any byte range on. A piece alone does not tell
whether it begins inside a string; the number of quotes before it does (odd: inside), and so the depth after it is a sum as well.
Both sums are taken within the blocks that the tasks read and then over the blocks' totals, a row each. A record ends
where a piece closes the array's own level; its pieces are joined again and parsed by the schema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.scratch import stored

#: A sign with the backslash before it. A backslash at a piece's end belongs to the cut-off '}', which then is inside a string.
ESCAPED = r"(?s)\\."


def _outside(text: Column, inside_first: Column) -> Column:
    """What of a piece stands outside strings, if its first sign does (or is inside one)."""
    parts = F.split(F.regexp_replace(text, ESCAPED, ""), '"', -1)
    return F.array_join(F.filter(parts, lambda _, i: (i + inside_first) % 2 == 0), "")


def _count(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def _running(rows: DataFrame, value: str, alias: str) -> DataFrame:
    """The sum of value over all pieces of the file before each: within the block, and of the blocks before."""
    w = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    return rows.withColumn("_here", F.coalesce(F.sum(value).over(w), F.lit(0))).join(before, ["file", "block"]).withColumn(alias, F.col("_here") + F.col("_before")).drop("_here", "_before")


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """file, n, text: the text of every record of the array, n from 0 in the order of the file."""
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value", F.col("_metadata.file_size").alias("size"))
    pieces = stored(pieces, "json-pieces")
    # No '}' follows the last piece of a file unless the file ends in one.
    files = pieces.groupBy("file").agg(F.max(F.struct("block", "at")).alias("last"), (F.sum(F.octet_length("value") + 1) == F.max("size")).alias("ends_in_brace"))
    pieces = pieces.join(files, "file").withColumn("cut", F.col("ends_in_brace") | (F.struct("block", "at") != F.col("last"))).drop("size", "last", "ends_in_brace")
    quotes = _count(F.regexp_replace("value", ESCAPED, ""), '"')
    counted = _running(pieces.withColumn("quotes", quotes), "quotes", "quotes_before").withColumn("inside", F.col("quotes_before") % 2)
    clear = _outside(F.col("value"), F.col("inside"))
    ends_outside = F.col("cut") & ((F.col("inside") + F.col("quotes")) % 2 == 0)
    deep = counted.withColumn("clear", clear).withColumn("closes", ends_outside.cast("int"))
    deep = deep.withColumn("delta", _count(F.col("clear"), "{[") - _count(F.col("clear"), "]}") - F.col("closes"))
    deep = _running(deep, "delta", "depth_before").withColumn("ends", ((F.col("closes") == 1) & (F.col("depth_before") + F.col("delta") == 1)).cast("int"))
    numbered = _running(deep.select("file", "block", "at", "value", "ends"), "ends", "n")
    joined = numbered.groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("p"), F.max("ends").alias("whole"))  # the pieces of one record
    text = F.array_join(F.transform("p", lambda x: x["value"]), "}")
    body = F.regexp_replace(text, r"\A\s*[\[,]?\s*", "")
    records = joined.select("file", "n", F.when(F.col("whole") == 1, F.concat(body, F.lit("}"))).otherwise(body).alias("text"), "whole")
    # What stands after the last record is the array's end; anything else there is a broken record.
    return records.filter((F.col("whole") == 1) | ~F.col("text").rlike(r"\A\s*\]?\s*\z")).select("file", "n", "text")


def read_array(spark: SparkSession, path: str, schema: T.StructType, mode: str = "PERMISSIVE") -> DataFrame:
    """The records with row_idx in the order of files and of the records in them.

    Malformed records: all fields null (PERMISSIVE), left out (DROPMALFORMED) or an error (FAILFAST). The array must hold objects.
    """
    texts = stored(record_texts(spark, path), "json-records")
    broken = "_broken"
    wide = T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    rows = texts.withColumn("r", F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}))
    bad = F.col(f"r.{broken}").isNotNull() | F.col("r").isNull()
    if mode == "FAILFAST":
        rows = rows.withColumn("r", F.when(bad, F.raise_error(F.concat(F.lit("malformed record "), F.col("n").cast("string"), F.lit(" of "), F.col("file"))).cast(wide)).otherwise(F.col("r")))
    elif mode == "DROPMALFORMED":
        rows = rows.filter(~bad)
    sizes = texts.groupBy("file").agg((F.max("n") + 1).alias("size"))
    offset = sizes.select("file", F.coalesce(F.sum("size").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))  # a row a file
    field = lambda f: F.when(~bad, F.col(f"r.{f.name}")).alias(f.name) if mode == "PERMISSIVE" else F.col(f"r.{f.name}").alias(f.name)
    return rows.join(offset, "file").select(*[field(f) for f in schema.fields], (F.col("first") + F.col("n")).alias("row_idx"))
