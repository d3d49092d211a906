"""Parquet inventories, stores and reports on files."""

from __future__ import annotations

import re
from urllib.parse import urlparse

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Domains, other spellings, and kinds of files.
DOMAINS = ["arm", "mips", "mipsel", "x86"]
DOMAIN_ALIASES = {"arms": "arm"}
MODALITIES = ["strace", "pcap", "sar"]

FOOTER = "path string, length long, rows long, columns int, row_groups int, group_rows array<long>, null_columns array<string>"


def list_parquet(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every .parquet file below a place; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(root)
    return files.select("path", "length")


def footers(files: DataFrame) -> DataFrame:
    """FOOTER facts of listed files, read on the executors, some files to a task.

    A column is listed as null where a row group says so or has no statistics.
    """

    def read(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for batch in batches:
            rows = []
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with system.open_input_file(place) as handle:
                    meta = pq.ParquetFile(handle).metadata
                names = [meta.schema.column(j).path.split(".")[0] for j in range(meta.num_columns)]
                nulls = set()
                for i in range(meta.num_row_groups):
                    for j in range(meta.num_columns):
                        stats = meta.row_group(i).column(j).statistics
                        if stats is None or stats.null_count is None or stats.null_count:
                            nulls.add(names[j])
                found = [n for n in dict.fromkeys(names) if n in nulls]
                rows.append((path, length, meta.num_rows, len(dict.fromkeys(names)), meta.num_row_groups, [meta.row_group(i).num_rows for i in range(meta.num_row_groups)], found))
            types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=[x.split(" ")[0] for x in FOOTER.split(", ")])

    return files.select("path", "length").repartition("path").mapInArrow(read, FOOTER)


def domain_of(path: Column) -> Column:
    """The first path segment that is a known domain or another spelling of one, else null."""
    parts = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    for other, name in DOMAIN_ALIASES.items():
        parts = _renamed(parts, other, name)
    return F.get(F.filter(parts, lambda p: p.isin(DOMAINS)), 0)


def _renamed(parts: Column, other: str, name: str) -> Column:
    return F.transform(parts, lambda p: F.when(p == other, name).otherwise(p))


def modality_of(path: Column) -> Column:
    """The file's stem where it is a known kind, else null."""
    stem = F.lower(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", ""))
    return F.when(stem.isin(MODALITIES), stem)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """Files below a place with footer facts, domain and modality, by path."""
    facts = footers(list_parquet(spark, root))
    return facts.select("path", F.col("length").alias("size_bytes"), "rows", "columns", "row_groups", domain_of(F.col("path")).alias("arch"), modality_of(F.col("path")).alias("modality")).orderBy("path")


def paper_totals(counts: DataFrame) -> DataFrame:
    """Published counts, summed per domain (lower case) and modality."""
    return counts.groupBy(F.lower("Architecture").alias("arch"), F.col("DataType").alias("modality")).agg(F.sum("count").alias("rows_in_paper"))


def compare_counts(files: DataFrame, totals: DataFrame) -> DataFrame:
    """Rows in files against published rows; a side that lacks a pair is null."""
    known = files.where("arch is not null and modality is not null").select("arch", "modality", F.col("rows").alias("rows_in_file"))
    out = known.join(totals, ["arch", "modality"], "full_outer")
    return out.withColumn("unknown_rows", F.col("rows_in_file") - F.col("rows_in_paper")).orderBy("arch", "modality")


def spread(total: int, k: int) -> list[int]:
    """Numbers of k row groups, as evenly over all of them as whole numbers go; all where there are no more."""
    return np.unique(np.rint(np.linspace(0, total - 1, min(k, total)))).astype(int).tolist()


def sampled_rows(df: DataFrame, group_rows: list[int], k: int) -> DataFrame:
    """The rows of k spread row groups of one file, by row index."""
    starts = [sum(group_rows[:i]) for i in range(len(group_rows) + 1)]
    index = F.col("_metadata.row_index")
    keep = F.lit(False)
    for i in spread(len(group_rows), k):
        keep = keep | index.between(starts[i], starts[i + 1] - 1)
    return df.where(keep)


def group_spans(df: DataFrame, key: str, group_rows: list[int]) -> int:
    """Row-group boundaries of one file with the same key on both sides."""
    edges = [sum(group_rows[:i]) for i in range(1, len(group_rows))]
    if not edges:
        return 0
    index = F.col("_metadata.row_index")
    ends = df.where(index.isin([*edges, *(e - 1 for e in edges)])).select(index.alias("at"), F.col(key).alias("k"))
    after, before = ends.where(F.col("at").isin(edges)), ends.select((F.col("at") + 1).alias("at"), F.col("k").alias("b"))
    return after.join(before, "at").where(F.equal_null("k", "b")).count()


def store_paths(folder: str, stem: str = "strace") -> list[str]:
    """Exact names only, so a longer stem never matches a shorter one."""
    return [f"{folder.rstrip('/')}/{d}_{stem}.parquet" for d in DOMAINS]


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def load_store(spark: SparkSession, folder: str, stem: str = "strace") -> DataFrame:
    """The stores of the domains that are there; raises if none is."""
    found = [p for p in store_paths(folder, stem) if _is_there(spark, p)]
    if not found:
        raise FileNotFoundError(f"{folder} has the {stem} store of no domain")
    return spark.read.parquet(*found)


def load_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Assignment files of all domains; keys stay strings."""
    return spark.read.schema("hash string, family string, arch string, group string, inert boolean, split string").csv(folder, header=True, recursiveFileLookup=True, pathGlobFilter="*.csv")


def save_assignment(assignment: DataFrame, folder: str, domain: str = "arch") -> None:
    """CSV, a folder for each domain."""
    assignment.withColumn("_domain", F.col(domain)).repartition("_domain").sortWithinPartitions(domain, "family", "split", "hash").write.mode("overwrite").partitionBy("_domain").csv(folder, header=True)


def load_paper_counts(spark: SparkSession, path: str) -> DataFrame:
    """Published counts: Architecture, DataType, count."""
    return _load_csv(spark, path, ["Architecture", "DataType", "count"]).withColumn("count", F.col("count").cast("long"))


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """column, canonical, rule of each raw name, as ``names.resolution`` gives them; a dropped name's canonical is null."""
    return _load_csv(spark, path, ["column", "canonical", "rule"])


def load_inventory(spark: SparkSession, path: str) -> DataFrame:
    """column, and a 0/1 column for each domain, as ``names.inventory`` gives them."""
    found = spark.read.csv(path, header=True)
    return found.select("column", *(F.col(c).cast("int").alias(c) for c in found.columns if c != "column"))


def _load_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    found = spark.read.csv(path, header=True)
    lacking = [c for c in columns if c not in found.columns]
    if lacking:
        raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
    return found.select(*columns)


def save_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def save_results(results: DataFrame, folder: str, domain: str = "held_out") -> None:
    """Results as CSV, a folder for each domain."""
    results.withColumn("_domain", F.col(domain)).repartition("_domain").write.mode("overwrite").partitionBy("_domain").csv(folder, header=True)


def save_store(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def save_json(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def prefix_stem(calls: int, base: str = "strace") -> str:
    return f"first{calls}_{base}"


def default_features_uri(url: str) -> str | None:
    """Where derived tables of an object store's bucket go; None for local inputs."""
    parts = urlparse(url)
    return f"{parts.scheme}://{parts.netloc}/features" if parts.scheme and parts.netloc else None
