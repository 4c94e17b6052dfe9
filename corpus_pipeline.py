"""From raw documents to token ids in five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of docs.
Null or empty texts, repeated rows and extra columns pass through as the operators'
docstrings say; a row whose id is null is never a near duplicate and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bloom, bpe, decontaminate, linedup, ngramjoin, quality
from larkspur.llm.shared import keep


def _apart(docs: DataFrame) -> DataFrame:
    """docs with its columns beside id and text under names that no operator uses."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_own_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def _again(kept: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again, in their order."""
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col(f"_own_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    apart = _apart(docs)
    forest = quality.learn(apart, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _again(quality.score(apart, forest, carry=tuple(apart.columns)).where("score >= 0.5"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the aligned blocks that an earlier one holds; one that had nothing else goes."""
    apart = _apart(docs)
    done = linedup.dedup_lines(apart, carry=tuple(apart.columns))
    left = done.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    if "n_chars" not in docs.columns:
        return _again(left, docs)
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    place = f"_own_{docs.columns.index('n_chars')}"
    return _again(left.withColumn(place, F.when(F.col("n_removed") == 0, F.col(place)).otherwise(chars)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each group of near duplicates."""
    groups = keep(ngramjoin.near_duplicates(docs.select("doc_id", "text")), "groups")
    return bloom.without(docs, "doc_id", groups, F.col("component_id") != F.col("doc_id"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    apart = _apart(docs)
    found = decontaminate.decontaminate(apart, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(apart.columns))
    return _again(found.where("n_hit = 0"), docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    import public_tokenizers

    carry = tuple(c for c in ("lang", "source") if c in docs.columns)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=carry, with_ids=True)


STAGES = [
    ("quality_classifier", quality_filter),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", encoding),
]

#: SQL can't express boosted trees, patience alignment, connected components or BPE; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of a data directory."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
