"""The training-data pipeline over documents: each stage reads what the one before kept.

Quality rules drop documents they reject; of near duplicates one document of each group stays (the
smallest id; rows without an id stay); benchmark passages are cut out, and documents that are mostly
benchmark go; personal data is replaced by the name of its kind; what is left is packed into
sequences of tokens. All stages but the last return the columns of documents, n_chars being the
length of the text as it then is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.decontaminate import find_overlaps
from tracewright.llm.jaccard import linked_components
from tracewright.llm.packing import pack
from tracewright.llm.pii import find_pii, redacted
from tracewright.llm.quality import quality
from tracewright.llm.storage import written

#: Documents with more of their words in benchmark passages than this go; of others the passages are cut out.
MAX_COVERAGE = 0.8


def _wrapped(docs: DataFrame) -> DataFrame:
    """The text, and the other columns in one struct, where no name of theirs can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    return docs.select(F.struct(*others, F.lit(None).cast("int").alias("none")).alias("row"), "text")


def _unwrapped(docs: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The given columns, with the text and its length from a column."""
    new = docs.select("row", text.alias("text"))
    taken = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return new.select(*(taken[c] if c in taken else F.col("row").getField(c).alias(c) for c in columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality(docs).where("_kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = linked_components(docs, n=5, percent=75)
    others = groups.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_overlaps(_wrapped(docs), benchmark, window=10, max_coverage=MAX_COVERAGE, clean=True)
    return _unwrapped(found.where("clean_text is not null"), docs.columns, F.col("clean_text"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = find_pii(_wrapped(docs), keep_text=True)
    return _unwrapped(found, docs.columns, redacted(F.coalesce("text", F.lit("")), F.col("_pii")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, "word_bpe_49k.json", max_tokens=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: No SQL expresses the outlier estimates and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
