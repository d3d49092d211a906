"""Queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", max_tokens=2048, end_id=0)


def op2_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_warc, write_warc

    path = storage.scratch(spark, "warc")
    write_warc(_table(spark, sf_dir, "pages"), path, min_bytes=0)
    read = read_warc(spark, path, payload="false", verify="true").where(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.regexp_extract(c, "^urn:x-page:(-?[0-9]+)$", 1).try_cast("long")
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import read_tokens, write_tokens

    path = storage.scratch(spark, "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", end_id=2)
    return read_tokens(spark, path)


def op4_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_overlaps, items_digest

    found = find_overlaps(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_hashed_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import in_four_fifths, score_texts

    return score_texts(_table(spark, sf_dir, "documents"), in_four_fifths)


def op6_rare_token_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import linked_components

    return linked_components(_table(spark, sf_dir, "documents"), n=5, percent=75)


def op8_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import base_failed, judged, measured
    from .storage import written

    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    stats = written(measured(docs, "text", "_q").drop("text"), "measured")
    q = F.col("_q")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged(stats).select("doc_id", *(q[c].alias(c) for c in counts), base_failed(q).alias("base_failed"), F.col("_kept").alias("kept"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import BASE, find_pii, listed

    found = find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("_pii", lambda s: s.kind < len(BASE))
    count = lambda k: F.size(F.filter("_pii", lambda s: s.kind == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_pii")).alias("spans"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"), window=50)


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_warc_archives": op2_warc_archives,
    "op3_rans_tokens": op3_rans_tokens,
    "op4_suffix_automaton_decontamination": op4_suffix_automaton_decontamination,
    "op5_hashed_maxent_scores": op5_hashed_maxent_scores,
    "op6_rare_token_licences": op6_rare_token_licences,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_robust_outliers": op8_robust_outliers,
    "op9_weak_supervision_pii": op9_weak_supervision_pii,
    "op10_repeated_passages": op10_repeated_passages,
}
