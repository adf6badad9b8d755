"""Session settings and the shared scratch area used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings the plans are written for. Nothing below is needed for right results;
# the skew and coalesce rules let one oversized mesh be split at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_written: list[str] = []  # paths of the scratch tables of this process
_named: dict[str, str] = {}  # by path: the catalog's names of those that are dealt into buckets


def session(app: str = "footfall", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "_footfall_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="footfall-"), "footfall.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._footfall_shipped = True


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="footfall-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str = "stage", dealt_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    Lost executors only ever cost a re-read, later steps scan pruned columns, and
    Catalyst sees the true size of the table. ``dealt_by``: a column whose values' buckets, one for
    each shuffle partition, are files of their own; groups and joins by it then don't shuffle the table.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/footfall-{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if dealt_by is not None:
        _named[path] = name = f"footfall_{uuid.uuid4().hex}"
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer.format("parquet").option("path", path).bucketBy(parts, dealt_by).saveAsTable(name)
        _written.append(path)
        return spark.table(name)
    writer.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_tables() -> list[str]:
    """Paths of the scratch tables of this process; what one piece of work has added is its own."""
    return list(_written)


def release_scratch(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the scratch tables ``paths`` (all written so far by this process, if not given); call it once results are stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    released = 0
    for name in list(_written) if paths is None else paths:
        if name in _written:
            _written.remove(name)
            if name in _named:
                spark.sql(f"DROP TABLE IF EXISTS {_named.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(name)
            released += bool(path.getFileSystem(conf).delete(path, True))
    return released
