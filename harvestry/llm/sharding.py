"""Sharding by size-tiered compaction, in DataFrame operations only.

A store is a folder of immutable shards and a folder of manifests. Appending writes each task's
arrivals as small shards where they are, without a shuffle. Compaction puts shards of like size
(a power of FAN bytes) into tiers, lays the shards of a tier end to end and cuts at the target size;
a group of at least two shards is rewritten as one, by one task, so that no task gets more than the target and a shard. Either step ends by renaming a finished
manifest to the next version number, which fails if that version exists: readers see the old
version or the new one, never parts, and of two writers one has to try again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import documents, fresh_path, join_small, staged

#: Sizes within this factor belong to one tier.
FAN = 4
#: Rows of an arrival shard at most.
ARRIVAL_ROWS = 1024
#: Bytes of text that a merged shard is to hold.
TARGET_BYTES = 64 << 20
#: A tier is compacted once it holds so many shards below the target.
LEAST_RUNS = 4

MANIFEST = "shard string, path string, tier int, n_rows long, n_bytes long, min_id long, max_id long, version long"


class Store:
    """Shards of a table with an integer id and a text column; null ids and texts are kept as they are.

    Other columns are stored along; their names may be anything but `shard_path` and `shard_group`.
    Rows that repeat one another are all kept. A store without rows reads as an empty table.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET_BYTES):
        self.spark, self.path, self.id_col, self.text_col, self.target = spark, path, id_col, text_col, target
        self.fs = spark._jvm.org.apache.hadoop.fs

    def version(self) -> int:
        """The newest committed version; 0: none."""
        p = self.fs.Path(f"{self.path}/manifests")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return 0
        return max([0, *(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))])

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/v{v:08d}") if v else self.spark.createDataFrame([], MANIFEST)

    def commit(self, manifest: DataFrame, base: int) -> int:
        """Publish `manifest` as version base + 1, or fail if another writer was first."""
        hidden = self.fs.Path(f"{self.path}/manifests/_{uuid.uuid4().hex}")
        manifest.withColumn("version", F.lit(base + 1).cast("long")).write.parquet(hidden.toString())
        context = self.fs.FileContext.getFileContext(hidden.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(hidden, self.fs.Path(f"{self.path}/manifests/v{base + 1:08d}"), none)
        return base + 1

    def described(self, sizes: DataFrame) -> DataFrame:
        """Manifest rows of path, n_rows, n_bytes, min_id, max_id."""
        tier = F.floor(F.log(float(FAN), F.greatest("n_bytes", F.lit(1)))).cast("int")
        return sizes.select(F.substring(F.md5("path"), 1, 16).alias("shard"), "path", tier.alias("tier"), "n_rows", "n_bytes", "min_id", "max_id", F.lit(0).cast("long").alias("version"))

    def append(self, docs: DataFrame) -> int:
        """Write arrivals as small shards and commit them."""
        base = self.version()
        if not base:
            docs.limit(0).write.mode("overwrite").parquet(f"{self.path}/schema")
        where = f"{self.path}/shards/{uuid.uuid4().hex}"
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", ARRIVAL_ROWS).parquet(where)
        size = F.coalesce(F.octet_length(self.text_col), F.lit(0)).cast("long")
        rows = self.spark.read.schema(docs.schema).parquet(where).select(F.col("_metadata.file_path").alias("path"), F.col(self.id_col).cast("long").alias("id"), size.alias("bytes"))
        sizes = rows.groupBy("path").agg(F.count("*").alias("n_rows"), F.sum("bytes").alias("n_bytes"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
        return self.commit(self.manifest(base).unionByName(self.described(sizes)), base)

    def plan(self, manifest: DataFrame) -> DataFrame:
        """path, shard_group (from 0 on), for shards to be merged. Windows hold manifest rows only."""
        small = manifest.where(F.col("n_bytes") * 2 <= self.target)
        tier = Window.partitionBy("tier")
        run = tier.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        cut = F.floor(F.coalesce(F.sum("n_bytes").over(run), F.lit(0)) / self.target)
        grouped = small.withColumn("runs", F.count("*").over(tier)).where(f"runs >= {LEAST_RUNS}").withColumn("cut", cut)
        grouped = grouped.withColumn("members", F.count("*").over(Window.partitionBy("tier", "cut"))).where("members > 1")
        return grouped.select("path", (F.dense_rank().over(Window.orderBy("tier", "cut")) - 1).cast("int").alias("shard_group"))

    def compact(self) -> bool:
        """One round: merge the groups of every tier, each in a task of its own, and commit. False if there is nothing to merge."""
        base = self.version()
        old = self.manifest(base)
        plan = staged(old.join(self.plan(old), "path"), "shard-plan")
        groups = plan.agg(F.max("shard_group")).first()[0]
        if groups is None:
            return False
        where = f"{self.path}/shards/{uuid.uuid4().hex}"
        rows = self.read(plan, "shard_group").repartitionById(groups + 1, F.col("shard_group"))
        rows.drop("shard_path", "shard_group").write.option("compression", "zstd").parquet(where)
        # A task writes one file, whose name has the task's number: the group.
        files = self.spark.read.parquet(where).select(F.col("_metadata.file_path").alias("path")).distinct().withColumn("shard_group", F.regexp_extract("path", r"/part-(\d+)-[^/]*$", 1).cast("int"))
        sums = plan.groupBy("shard_group").agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_bytes")], F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))
        self.commit(old.join(plan, "path", "left_anti").unionByName(self.described(files.join(sums, "shard_group"))), base)
        return True

    def read(self, manifest: DataFrame, *carry: str) -> DataFrame:
        """The rows of a manifest's shards, and of no others, with `shard_path` and what `carry` names of the manifest.

        The driver gets the paths: one for each shard, not for each row.
        """
        schema = self.spark.read.parquet(f"{self.path}/schema").schema
        paths = [r[0] for r in manifest.select("path").collect()]
        if not paths:
            kinds = [manifest.schema[c] for c in carry]
            return self.spark.createDataFrame([], StructType([*schema.fields, StructField("shard_path", StringType()), *kinds]))
        rows = self.spark.read.schema(schema).parquet(*paths).withColumn("shard_path", F.col("_metadata.file_path"))
        return join_small(rows, manifest.select(F.col("path").alias("shard_path"), *carry), "shard_path") if carry else rows


def op10_tiered_shards(spark, sf_dir: str) -> DataFrame:
    """All documents appended and compacted until no tier has anything left to merge; one row per document as the shards give it back: doc_id, shard, tier, version, shard_rows, n_bytes, text_sha256."""
    store = Store(spark, fresh_path(spark, "shards"))
    store.append(documents(spark, sf_dir).select("doc_id", "text", "lang", "source", "n_chars"))
    while store.compact():
        pass
    found = staged(store.manifest(), "shard-manifest")
    rows = store.read(found, "shard", "tier", "version", "n_rows")
    text = F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "shard", "tier", "version", F.col("n_rows").alias("shard_rows"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
