"""Appending rows exactly once (SNK7), with filters of the keys that are there (JOIN5, SRC4).

A folder holds `data/<name>` (Parquet, one folder a batch), `filters/<name>` and `commits/<version>`. A batch is written to a folder of its own first
and counts once its commit file is there, which is put in place by a rename that fails if the version is taken. So a batch killed
before its commit leaves nothing that is read, the same batch id is never committed twice, and of two writers at once the later
one sees the other's commit and looks at its keys before trying the next version.

A batch's filter is a partitioned Bloom filter: its keys set HASHES bits each in bitmaps of 32,768 bits, a row each, with about BITS bits a key.
New keys are tested against the filters' bitmaps (joined by bucket); only keys that a batch's filter may hold are looked up, and only in
the batches whose filter they hit.

Rows without a key can't be known again: all of them are kept, in every batch. Of rows with one key within a batch the smallest (by all its
columns' text) stays.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import delete

HASHES = 3
BITS = 12
_BITMAP = 32_768


class AppendLog:
    def __init__(self, spark: SparkSession, path: str, key: str = "source_hash"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._fs_path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    # Commits

    def commits(self) -> list[dict]:
        """version, batch, name, rows, bits of every commit in order (a small file each)."""
        folder = self._fs_path(f"{self.path}/commits")
        if not self._fs.exists(folder):
            return []
        text = self.spark.read.schema("version long, batch string, name string, rows long, bits long").json(f"{self.path}/commits/*.json")
        return [r.asDict() for r in text.orderBy("version").collect()]

    def _commit(self, version: int, batch: str, name: str, rows: int, bits: int) -> bool:
        """False if the version is taken."""
        jvm = self.spark.sparkContext._jvm
        made = self._fs_path(f"{self.path}/commits/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(made, True)
        out.write(bytearray(json.dumps({"version": version, "batch": batch, "name": name, "rows": rows, "bits": bits}).encode()))
        out.close()
        at = self._fs_path(f"{self.path}/commits/{version:012d}.json")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(made, at, none)
            return True
        except Exception as e:
            self._fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    # Filters

    def _bits(self, keys: DataFrame, bits) -> DataFrame:
        """key, bucket, position of the HASHES bits of every key; bits: how many the filter has."""
        each = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(i), self.key), bits) for i in range(HASHES)]))
        return keys.withColumn("_bit", each).withColumn("_bit", F.col("_bit") + 1).withColumn("bucket", F.expr("bitmap_bucket_number(_bit)")).withColumn("position", F.expr("bitmap_bit_position(_bit)")).drop("_bit")

    def _write_filter(self, rows: DataFrame, name: str, bits: int) -> None:
        placed = self._bits(rows.select(self.key).filter(F.col(self.key).isNotNull()), F.lit(bits))
        placed.groupBy("bucket").agg(F.expr("bitmap_construct_agg(position)").alias("bitmap")).write.mode("overwrite").parquet(f"{self.path}/filters/{name}")

    def may_hold(self, keys: DataFrame, commits: list[dict]) -> DataFrame:
        """name, key: every pair of a batch and a distinct key that its filter may hold."""
        sizes = self.spark.createDataFrame([(c["name"], c["bits"]) for c in commits], "name string, bits long")
        filters = self.spark.read.schema("bucket long, bitmap binary").parquet(*[f"{self.path}/filters/{c['name']}" for c in commits]).withColumn("name", F.element_at(F.split("_metadata.file_path", "/"), -2))
        asked = self._bits(keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct().crossJoin(F.broadcast(sizes)), F.col("bits"))  # a row a commit
        byte = F.expr("cast(conv(hex(substring(bitmap, cast(position div 8 as int) + 1, 1)), 16, 10) as int)")
        set_ = F.expr("cast(pmod(position, 8) as int)")
        hit = asked.join(filters, ["name", "bucket"]).withColumn("_byte", byte).withColumn("_at", set_).filter("shiftright(_byte, _at) & 1 = 1")
        return hit.groupBy("name", self.key).agg(F.count("*").alias("_n")).filter(F.col("_n") == HASHES).select("name", self.key)

    def held(self, keys: DataFrame, commits: list[dict]) -> DataFrame:
        """The keys among the given ones that the commits' batches hold; batches without a probable key are not read."""
        nothing = keys.select(self.key).limit(0)
        if not commits:
            return nothing
        probable = self.may_hold(keys, commits)
        names = {r["name"] for r in probable.select("name").distinct().collect()}  # a row a batch
        read = [c["name"] for c in commits if c["name"] in names]
        if not read:
            return nothing
        old = self.spark.read.parquet(*[f"{self.path}/data/{n}" for n in read]).select(self.key)
        return probable.select(self.key).distinct().join(old, self.key, "left_semi")

    # Rows

    def append(self, rows: DataFrame, batch: str) -> int:
        """Adds the rows whose key is not there; returns how many. A batch id that is committed already adds nothing."""
        done = self.commits()
        if any(c["batch"] == batch for c in done):
            return 0
        name = uuid.uuid4().hex
        known = F.col(self.key).isNotNull()
        first = F.min_by(F.struct(*rows.columns), F.to_json(F.struct(*rows.columns)))
        one = rows.filter(known).groupBy(F.col(self.key).alias("_key")).agg(first.alias("r")).select("r.*")
        new = one.join(self.held(one, done), self.key, "left_anti").select(*rows.columns).unionByName(rows.filter(~known))
        written = self._write(new, name)
        while True:
            later = self.commits()[len(done) :]
            if any(c["batch"] == batch for c in later):
                self._drop(name)
                return 0
            if later:
                # Another writer was first: only its keys are looked at, and what is left is written again.
                done += later
                old, name = name, uuid.uuid4().hex
                here = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{old}")
                written = self._write(here.filter(known).join(self.held(here, later), self.key, "left_anti").select(*rows.columns).unionByName(here.filter(~known)), name)
                self._drop(old)
                continue
            if self._commit(len(done), batch, name, *written):
                return written[0]

    def _write(self, rows: DataFrame, name: str) -> tuple[int, int]:
        rows.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        here = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{name}")
        n = here.count()
        bits = max(_BITMAP, -(-n * BITS // _BITMAP) * _BITMAP)
        self._write_filter(here, name, bits)
        return n, bits

    def _drop(self, name: str) -> None:
        for kind in ("data", "filters"):
            delete(self.spark, f"{self.path}/{kind}/{name}")

    def read(self) -> DataFrame:
        """All committed rows."""
        done = self.commits()
        if not done:
            raise AnalysisException(f"nothing is committed in {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/data/{c['name']}" for c in done])

    def keys(self) -> DataFrame:
        """SRC4: the distinct keys that are there."""
        return self.read().select(self.key).filter(F.col(self.key).isNotNull()).distinct()
