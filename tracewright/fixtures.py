"""Traces and stores derived from the driver's tables, the inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.positions import with_position

COUNTS = ["fa", "fn", "fr", "q1", "q2", "q3", "q4"]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events: an entity per user, a call per event type, positions in time order."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id")
    arch = F.element_at(F.array(*map(F.lit, ("arm", "mips", "mipsel", "x86"))), (user % 4 + 1).cast("int"))
    family = F.when(user % 10 == 9, "Unknown").when(user % 3 == 0, "Benign").when(user % 3 == 1, "Mirai").otherwise("Gafgyt")
    rows = e.select(user.cast("string").alias("hash"), arch.alias("arch"), family.alias("family"), F.col("event_type").alias("call"), "ts", "event_id")
    return with_position(rows, "hash", ["ts", "event_id"]).drop("ts")


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order with counts over its lines."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    count = lambda cond: F.count_if(cond).cast("long")
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    counts = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("windows"),
        count(flag == "A").alias("fa"),
        count(flag == "N").alias("fn"),
        count(flag == "R").alias("fr"),
        count(q <= 12).alias("q1"),
        count((q > 12) & (q <= 25)).alias("q2"),
        count((q > 25) & (q <= 37)).alias("q3"),
        count(q > 37).alias("q4"),
    )
    keyed = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderstatus").alias("arch"), F.col("o_orderpriority").alias("family"))
    return keyed.join(counts, "l_orderkey").select("hash", "arch", "family", "windows", *COUNTS)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a made-up score."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    m = F.col("doc_id") % 10
    out = d.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id")
    return out.select(
        "doc_id",
        F.col("lang").alias("arch"),
        F.concat("lang", F.lit(":"), "source").alias("grp"),
        F.col("quality").cast("long").alias("y"),
        F.when(m < 7, "train").when(m == 7, "val").otherwise("test").alias("split"),
        (((F.col("doc_id") * 37 + F.col("n_chars")) % 101).cast("double") / F.lit(101.0)).alias("score"),
    )


# The same, for DuckDB.
TRACE = """trace AS (SELECT CAST(user_id AS VARCHAR) AS hash,
  CASE user_id % 4 WHEN 0 THEN 'arm' WHEN 1 THEN 'mips' WHEN 2 THEN 'mipsel' ELSE 'x86' END AS arch,
  CASE WHEN user_id % 10 = 9 THEN 'Unknown' WHEN user_id % 3 = 0 THEN 'Benign' WHEN user_id % 3 = 1 THEN 'Mirai' ELSE 'Gafgyt' END AS family,
  event_type AS call, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS position FROM events)"""
STORE = """store AS (SELECT CAST(o_orderkey AS VARCHAR) AS hash, o_orderstatus AS arch, o_orderpriority AS family, CAST(count(*) AS BIGINT) AS windows,
  CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS fa, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS fn, CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS fr,
  CAST(count(*) FILTER (l_quantity <= 12) AS BIGINT) AS q1, CAST(count(*) FILTER (l_quantity > 12 AND l_quantity <= 25) AS BIGINT) AS q2,
  CAST(count(*) FILTER (l_quantity > 25 AND l_quantity <= 37) AS BIGINT) AS q3, CAST(count(*) FILTER (l_quantity > 37) AS BIGINT) AS q4
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus, o_orderpriority)"""
_PERCENT = ", ".join(f"CAST((200 * {c} + w) // (2 * w) AS VARCHAR)" for c in COUNTS)
SIGNED = STORE + f""", signed AS (SELECT hash, arch, family, windows, {', '.join(COUNTS)},
  md5(concat_ws(',', {', '.join(f'CAST({c} AS VARCHAR)' for c in COUNTS)})) AS exact, md5(concat_ws(',', {_PERCENT})) AS profile,
  md5(concat_ws('', {', '.join(f"CASE WHEN {c} > 0 THEN '1' ELSE '0' END" for c in COUNTS)})) AS presence
  FROM (SELECT *, greatest({' + '.join(COUNTS)}, 1) AS w FROM store))"""
SCORED = """scored AS (SELECT d.doc_id, d.lang AS arch, concat(d.lang, ':', d.source) AS grp, CAST(l.quality AS BIGINT) AS y,
  CASE WHEN d.doc_id % 10 < 7 THEN 'train' WHEN d.doc_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
  CAST((d.doc_id * 37 + d.n_chars) % 101 AS DOUBLE) / CAST(101 AS DOUBLE) AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""
