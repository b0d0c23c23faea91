"""From raw documents to tokens: quality, line dedup, near-dedup, decontamination, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlake.llm import bpe, decontaminate, lines, neardup, quality
from kinlake.llm.queries import table, tokenizer_path
from kinlake.llm.work import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without further occurrences of near-equal lines; n_chars is that of the new text."""
    aside = {c: f"__kept_{c}" for c in docs.columns if c in ("n_lines", "n_removed", "removed")}  # names that the operator gives to its own columns
    cut = lines.deduplicate(docs.withColumnsRenamed(aside))
    changed = F.col("n_removed") > 0
    cut = cut.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(*aside)
    return cut.withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-duplicates (five words, a similarity of 0.8); rows without a doc_id have no group and stay."""
    goes = neardup.near_duplicates(docs, k=5, percent=80).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, and digests of them and of what they decode to."""
    codec = spark.sparkContext.broadcast(bpe.Codec(bpe.load(tokenizer_path())))
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), codec, digests=True, keep_text=False)
    return coded.select("doc_id", "lang", "source", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", good_quality),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("bpe", tokens),
]

#: Models, fuzzy matching and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; each stage's result is a table in the shared folder."""
    scratch, before = Scratch(spark), []
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        scratch.release(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
