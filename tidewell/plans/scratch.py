"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs a re-read and never a recomputation of the
whole job.  Shuffle files of the writing query are dropped as it ends, and a table
that no later step reads is dropped with ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What holds while a scratch table is written: shuffle files go with the query, and a
#: Python worker gets few texts at once.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_DIR = "spark.checkpoint.dir"
#: Encoded bytes up to which a table may be broadcast; it is some times larger in memory.
BROADCAST_BYTES = 16 << 20
#: Folders made for local sessions, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session, as ``spark.checkpoint.dir`` names it.

    Where it is unset a local session makes a folder of its own (tests, a laptop); on a
    cluster that is an error, as executors and driver would see different folders.
    """
    found = spark.conf.get(_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_DIR} to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or tempfile.mkdtemp(prefix="tidewell-")
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of the copy."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more; other frames are left alone."""
    for table in tables:
        path = getattr(table, "scratch_path", None)
        if path:
            delete(table.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Spark's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def bytes_of(df: DataFrame) -> Column:
    """Encoded bytes of a row: string and binary columns by length, others eight bytes each."""
    sizes = [F.lit(8)]
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sizes.append(F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)))
        elif kind in ("array", "map", "struct"):
            sizes.append(F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{f.name}`")))), F.lit(0)))
        else:
            sizes.append(F.lit(8))
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return total.cast("long")


def row_bytes(df: DataFrame) -> int:
    """Encoded bytes of all rows."""
    return df.agg(F.sum(bytes_of(df))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast when its measured bytes prove that it is small.

    Beyond ``max_bytes`` it is returned as it is, and the join shuffles (with
    AQE splitting skewed partitions).  ``df`` should be cheap to compute.
    """
    return F.broadcast(df) if row_bytes(df) <= max_bytes else df
