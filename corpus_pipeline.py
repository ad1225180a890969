"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination, packing, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last return the columns of
``documents``. Rows are told apart by doc_id and text; equal rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, outliers, packing
from tidemark.llm.common import table
from tidemark.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the base rules nor are outliers of their language and source."""
    rejected = outliers.quality_verdicts(docs).where("NOT kept").select("doc_id", "text_id").distinct().alias("r")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_id"))
    return docs.alias("d").join(rejected, same, "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; a text may become empty, its document stays."""
    marked = line_dedup.deduplicated(docs)
    text = F.when(F.col("keep").isNull(), F.col("row.text")).otherwise(line_dedup.kept_text(F.col("row.text"), F.col("keep")))
    fresh = marked.withColumn("text", text)
    out = {c: F.col("row")[c] for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("keep").isNull(), F.col("row.n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return fresh.select(*[v.alias(c) for c, v in out.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 of 5-word shingles."""
    parts = jaccard_join.similar_components(docs, 5, (80, 100)).where("component_id <> doc_id").select("doc_id")
    return docs.join(parts.distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item."""
    leaks = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of the documents that are left."""
    return packing.packed_batches(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Robust estimates and optimal boundaries are loops that SQL does not express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
