"""Helpers shared by the training-data operators: shared storage, Arrow texts, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that lower-case A-Z and leave every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs in one process (tests, local runs) is a folder of our own made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = known or f"file://{tempfile.mkdtemp(prefix='quantloom-')}"
        if not known:
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Tables written so far, by application.
_written: dict[str, list[str]] = {}


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, in either case: the given ones, with underscores where they are taken."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def release(spark: SparkSession) -> int:
    """Deletes the paths of shared_path() in this application, once their results have been used; returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> Iterator[bytes]:
    """The UTF-8 bytes of a string column; null gives empty bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    for v in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()):
        yield v.as_py() or b""


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id, as text, leaves 2 on division by 4. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected long edges, as (node, component): the smallest node reachable.

    Rounds of min-neighbour hooking, pointer jumping and contraction. Every step is a join or a
    min/distinct aggregate with map-side combining, so a hub of any degree is never gathered in one task.
    An empty edge table gives an empty result; null and self edges are ignored.
    """
    e = materialize(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    labels = e.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    first = True
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).union(e.select("b", "a"))
        p = materialize(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("p")), "parents")
        while True:
            up = p.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            q = materialize(p.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") < F.col("p")).alias("moved")), "jumped")
            p, moved = q.select("v", "p"), not q.where("moved").isEmpty()
            if not moved:
                break
        if first:
            labels, first = p.select(F.col("v").alias("node"), F.col("p").alias("component")), False
        else:
            up = p.select(F.col("v").alias("component"), F.col("p").alias("pp"))
            labels = materialize(labels.join(up, "component", "left").select("node", F.coalesce("pp", "component").alias("component")), "labels")
        pa_, pb_ = p.select(F.col("v").alias("a"), F.col("p").alias("pa")), p.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        e = e.join(pa_, "a").join(pb_, "b").where("pa <> pb")
        e = materialize(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
    return labels
