"""A collection on disk: a manifest, a write log of Parquet generations and a compacted checkpoint.

A write is one directory of the log, named by its generation and renamed into place, so it is there whole or not at all.
Readers take the checkpoint and the later generations and keep each id's last operation. One driver writes at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engram.errors import MAX_BATCH, MAX_DIMENSION, MAX_ID_BYTES, EngineError, invalid
from engram.functions import vector
from engram.functions.embedding import EmbeddingSpace
from engram.functions.filters import compile_filter
from engram.operators import lifecycle

SCHEMA_VERSION = 1
FEATURES = ("exact-search", "metadata-filters", "capability-gate", "bm25", "hybrid-fusion", "decay", "coherence", "mmr", "batch-search", "branches", "snapshots", "compaction", "witness", "graph", "hyperedges", "sessions", "streaming")
RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
_LOGGED = T.StructType([T.StructField("generation", T.LongType()), T.StructField("ord", T.LongType()), T.StructField("op", T.StringType()), *RECORD.fields])


@dataclass
class Collection:
    spark: SparkSession
    path: str
    manifest: dict
    read_only: bool = False

    # files through Hadoop, so any store that Spark writes to will do

    @staticmethod
    def _fs(spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        fs, at = cls._fs(spark, path)
        return fs.exists(at(f"{path}/manifest"))

    @classmethod
    def create(cls, spark: SparkSession, path: str, dimension: int, metric: str = "cosine", space: EmbeddingSpace | None = None, capacity: int = 0, quantization: str = "none") -> Collection:
        if cls.exists(spark, path):
            raise EngineError("ALREADY_EXISTS", path)
        if not 1 <= dimension <= MAX_DIMENSION:
            raise invalid("dimension out of range", dimension=dimension)
        if metric not in vector.METRICS:
            raise invalid(f"unknown metric {metric}")
        if quantization != "none":
            raise EngineError("UNSUPPORTED", "quantization")
        if space is not None and space.dimension != dimension:
            raise EngineError("DIMENSION_MISMATCH", "the embedding space has another dimension")
        manifest = {"schemaVersion": SCHEMA_VERSION, "dimension": dimension, "metric": metric, "capacity": capacity, "space": None if space is None else vars(space), "features": list(FEATURES)}
        spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
        return cls(spark, path, manifest)

    @classmethod
    def open(cls, spark: SparkSession, path: str, read_only: bool = False) -> Collection:
        if not cls.exists(spark, path):
            raise EngineError("NOT_FOUND", path)
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest["schemaVersion"] > SCHEMA_VERSION:
            raise EngineError("VERSION", "written by a newer version")
        return cls(spark, path, manifest, read_only)

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, **options) -> Collection:
        return cls.open(spark, path) if cls.exists(spark, path) else cls.create(spark, path, **options)

    # log

    def _generations(self) -> list[int]:
        fs, at = self._fs(self.spark, self.path)
        top = at(f"{self.path}/log")
        if not fs.exists(top):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(top)]
        return sorted(int(n[2:]) for n in names if n.startswith("g="))

    @property
    def generation(self) -> int:
        return max([self._base(), *self._generations()])

    def _base(self) -> int:
        fs, at = self._fs(self.spark, self.path)
        top = at(f"{self.path}/checkpoint")
        if not fs.exists(top):
            return 0
        return max((int(s.getPath().getName()[2:]) for s in fs.listStatus(top) if s.getPath().getName().startswith("g=")), default=0)

    def _append(self, rows: DataFrame) -> int:
        if self.read_only:
            raise EngineError("READ_ONLY", self.path)
        now = self.generation + 1
        fs, at = self._fs(self.spark, self.path)
        draft, final = f"{self.path}/draft-{now}", f"{self.path}/log/g={now}"
        numbered = rows.withColumn("generation", F.lit(now).cast("long")).withColumn("ord", F.monotonically_increasing_id())
        numbered.select(*_LOGGED.names).write.mode("overwrite").parquet(draft)
        fs.mkdirs(at(f"{self.path}/log"))
        if not fs.rename(at(draft), at(final)):
            raise EngineError("LOCKED", "another writer took this generation")
        return now

    def log(self) -> DataFrame:
        """All generations behind the checkpoint; a missing one is CORRUPT."""
        base = self._base()
        later = [g for g in self._generations() if g > base]
        if later != list(range(base + 1, base + 1 + len(later))):
            raise EngineError("CORRUPT", "a generation of the log is missing", found=later)
        paths = [f"{self.path}/log/g={g}" for g in later] + ([f"{self.path}/checkpoint/g={base}"] if base else [])
        return self.spark.read.schema(_LOGGED).parquet(*paths) if paths else self.spark.createDataFrame([], _LOGGED)

    def frame(self) -> DataFrame:
        """Live records: id, vector, metadata, generation and ord (their place in order of writing)."""
        last = self.log().groupBy("id").agg(F.max_by(F.struct("op", "vector", "metadata", "generation", "ord"), F.struct("generation", "ord")).alias("l"))
        return last.select("id", "l.*").where("op <> 'delete'").drop("op")

    # writes

    def _checked(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<float>").alias("vector"), F.col("metadata").cast("map<string,string>").alias("metadata"))
        bad = rows.agg(
            F.count("*").alias("n"), F.countDistinct("id").alias("ids"),
            F.sum((F.size("vector") != self.manifest["dimension"]).cast("int")).alias("dims"),
            F.sum((F.exists("vector", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))).cast("int")).alias("values"),
            F.sum((F.col("id").isNull() | (F.octet_length("id") > MAX_ID_BYTES) | (F.col("id") == "")).cast("int")).alias("names"),
        ).first()
        if bad["n"] > MAX_BATCH:
            raise EngineError("LIMIT_EXCEEDED", "too many records in a batch; use bulk_load")
        if bad["dims"]:
            raise EngineError("DIMENSION_MISMATCH", f"vectors must have {self.manifest['dimension']} dimensions")
        if bad["values"] or bad["names"] or bad["ids"] != bad["n"]:
            raise invalid("ids must be distinct and vectors finite")
        return rows.withColumn("vector", vector.normalize(F.col("vector"))) if self.manifest["metric"] == "cosine" else rows

    def space_check(self, space: EmbeddingSpace | None) -> None:
        if space is None or self.manifest["space"] != vars(space):
            raise EngineError("EMBEDDING_SPACE_MISMATCH", "vectors come from another embedding space")

    def insert(self, rows: DataFrame) -> int:
        new = self._checked(rows)
        if not new.join(self.frame().select("id"), "id", "left_semi").isEmpty():
            raise EngineError("ALREADY_EXISTS", "an id is taken")
        return self._append(new.withColumn("op", F.lit("insert")))

    def upsert(self, rows: DataFrame) -> int:
        return self._append(self._checked(rows).withColumn("op", F.lit("upsert")))

    def bulk_load(self, rows: DataFrame) -> int:
        """Upsert of any size; vectors are brought to unit length, ids are taken to be distinct."""
        unit = vector.normalize(F.col("vector")) if self.manifest["metric"] == "cosine" else F.col("vector").cast("array<float>")
        return self._append(rows.select(F.col("id").cast("string").alias("id"), unit.alias("vector"), "metadata").withColumn("op", F.lit("upsert")))

    def update_metadata(self, key: str, patch: dict[str, str | None]) -> int:
        """Shallow merge; a null value removes its key."""
        row = self.get(key)
        gone = [k for k, v in patch.items() if v is None]
        kept = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin([*patch]) if patch else F.lit(True))
        new = {k: str(v) for k, v in patch.items() if k not in gone}
        merged = F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv]).cast("map<string,string>")) if new else kept
        return self._append(row.select("id", "vector", merged.alias("metadata"), F.lit("upsert").alias("op")))

    def delete(self, ids: DataFrame) -> int:
        live = self.frame().join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
        return self._append(live.select("id", F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("map<string,string>").alias("metadata"), F.lit("delete").alias("op")))

    def checkpoint(self) -> int:
        """Write the live rows as one table; older generations are then not read again."""
        now = self.generation
        if now > self._base():
            self.frame().withColumn("op", F.lit("upsert")).select(*_LOGGED.names).write.mode("overwrite").parquet(f"{self.path}/checkpoint/g={now}")
        return now

    # reads

    def get(self, key: str) -> DataFrame:
        row = self.frame().where(F.col("id") == key)
        if row.isEmpty():
            raise EngineError("NOT_FOUND", key)
        return row

    def has(self, key: str) -> bool:
        return not self.frame().where(F.col("id") == key).isEmpty()

    def count(self) -> int:
        return self.frame().count()

    def with_fields(self, **fields: str) -> DataFrame:
        """Live records with metadata keys as typed columns, for filters and search."""
        return self.frame().select("*", *[F.col("metadata").getItem(k).try_cast(t).alias(k) for k, t in fields.items()])

    def list(self, where: Column | dict | None = None, limit: int = 100, offset: int = 0, fields: dict[str, str] | None = None) -> tuple[DataFrame, int]:
        if not 0 <= limit <= 10_000:
            raise invalid("limit out of range")
        rows = self.with_fields(**(fields or {}))
        if where is not None:
            rows = rows.where(compile_filter(where, rows.schema) if isinstance(where, dict) else where)
        return rows.orderBy("generation", "ord").offset(offset).limit(limit).drop("vector"), rows.count()

    def modification_generation(self) -> DataFrame:
        return self.log().groupBy("id").agg(F.max("generation").alias("generation"))

    def stats(self) -> dict:
        return {"live": self.count(), "generation": self.generation, "checkpoint": self._base(), "features": self.manifest["features"]}

    # snapshots

    def snapshot(self, path: str) -> int:
        rows = self.frame().select("id", "vector", F.to_json("metadata").alias("metadata"))
        rows.write.parquet(f"{path}/rows")
        value = lifecycle.checksum(self.spark.read.parquet(f"{path}/rows")).first()
        head = {"kind": "collection", "version": SCHEMA_VERSION, "rows": value["rows"], "checksum": value["checksum"], "manifest": self.manifest}
        self.spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")
        return value["checksum"]

    @classmethod
    def restore(cls, spark: SparkSession, snapshot: str, path: str) -> Collection:
        fs, at = cls._fs(spark, snapshot)
        if not fs.exists(at(f"{snapshot}/head")):
            raise EngineError("NOT_FOUND", snapshot)
        head = json.loads(spark.read.text(f"{snapshot}/head").first()[0])
        if head["kind"] != "collection":
            raise invalid("a snapshot of another kind", kind=head["kind"])
        rows = spark.read.parquet(f"{snapshot}/rows")
        found = lifecycle.checksum(rows).first()
        if (found["rows"], found["checksum"]) != (head["rows"], head["checksum"]):
            raise EngineError("CORRUPT", "the snapshot's rows don't match its checksum")
        m = head["manifest"]
        space = EmbeddingSpace(**m["space"]) if m["space"] else None
        out = cls.create(spark, path, m["dimension"], m["metric"], space, m["capacity"])
        out.bulk_load(rows.withColumn("metadata", F.from_json("metadata", "map<string,string>")))
        return out
