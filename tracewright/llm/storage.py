"""Shared folder access for operators that write files of their own format.

Driver and executors share only the folder in ``spark.checkpoint.dir``, the warehouse and the
inputs, so every side file of an operator lives below that folder.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder; a folder of our own only on one machine where none is set, as in tests."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        context.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new, empty place below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/tracewright/{name}-{uuid.uuid4().hex}"


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file; a repeated attempt replaces it in one step."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
        return
    import pyarrow.fs as pafs

    system, place = pafs.FileSystem.from_uri(uri)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, place)


def open_input(uri: str):
    """A readable, seekable binary file."""
    path = _local(uri)
    if path is not None:
        return open(path, "rb")
    import pyarrow.fs as pafs

    system, place = pafs.FileSystem.from_uri(uri)
    return system.open_input_file(place)


def read_file(uri: str) -> bytes:
    with open_input(uri) as source:
        return source.read()


def list_files(uri: str, suffix: str = "") -> list[tuple[str, int]]:
    """(uri, bytes) of the files below a folder, or of the one file, in name order."""
    path = _local(uri)
    if path is not None:
        if os.path.isfile(path):
            return [(uri, os.path.getsize(path))]
        found = []
        for folder, _, names in os.walk(path):
            found += [(f"{folder}/{n}", os.path.getsize(f"{folder}/{n}")) for n in names if n.endswith(suffix) and not n.endswith(".part")]
        return sorted(found)
    import pyarrow.fs as pafs

    system, place = pafs.FileSystem.from_uri(uri)
    scheme = uri.split("://")[0]
    infos = system.get_file_info(pafs.FileSelector(place, recursive=True, allow_not_found=True))
    return sorted((f"{scheme}://{i.path.lstrip('/') if scheme != 'hdfs' else i.path}", i.size) for i in infos if i.is_file and i.path.endswith(suffix))


def remove(uri: str) -> None:
    path = _local(uri)
    if path is not None:
        shutil.rmtree(path, ignore_errors=True)
        return
    import pyarrow.fs as pafs

    system, place = pafs.FileSystem.from_uri(uri)
    system.delete_dir(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts the lineage, and is there after a lost executor."""
    spark = df.sparkSession
    place = scratch(spark, name)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)


#: Settings that decide how files are cut into partitions.
_SPLITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


def as_scan(df: DataFrame, name: str, *columns: Column, batch_rows: int | None = None) -> DataFrame:
    """The columns of a frame, with the same partitions in every pass, whatever happens to executors or settings.

    It is a scan of files in a session of its own, which keeps the settings that decide how files are
    cut, the least number of partitions among them, so that neither a lost executor nor a later change of
    settings moves a row. Anything but a plain table of parquet files is written to the shared folder first.
    batch_rows: rows that go to a Python worker at once, at most; both sides hold whole batches.
    """
    spark = df.sparkSession
    files, plan = df.inputFiles(), df._jdf.queryExecution().analyzed().toString().strip()
    plain = files and plan.startswith("Relation [") and plan.endswith("parquet") and "\n" not in plan and not any(x in f for f in files for x in "=%")
    if not plain:
        df = written(df.select(*columns), name)
        files, columns = df.inputFiles(), [F.col(c) for c in df.columns]
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key in _SPLITS:
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    if batch_rows:
        most = int(own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(most, batch_rows) if most > 0 else batch_rows))
    return (own.read.schema(df.schema).parquet(*files) if files else own.createDataFrame([], df.schema)).select(*columns)


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, by Spark's statistics."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
