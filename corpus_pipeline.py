"""A training corpus from raw documents: language, copies, near copies, mix and tokens, in that order.

Every stage decides by row: rows that repeat an id, or whose id is null, are rows like others. A null or empty text has no
letter, so the first stage drops it; ties go to the smallest id (null last), then to the first row; an empty table gives an
empty result; other columns, whatever their names, go along until the last stage. docs must be a stored table, whose
rows keep their numbers when it is read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sieveline.llm.bpe import bpe_encode
from sieveline.llm.common import numbered, save, scratch
from sieveline.llm.exact import exact_dedup
from sieveline.llm.jaccard import ngram_jaccard
from sieveline.llm.language_id import learn, with_language
from sieveline.llm.mixing import mixed
from sieveline.llm.queries import tokenizer_path


def _rank(row: str) -> Column:
    """What orders rows by id: null last, and rows of one id by number."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col(row).alias("row"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with that language as lang; text that is null or has no letter goes. Without any
    labelled row there is nothing to learn from, and all others stay as they are."""
    return with_language(docs, learn(docs))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space: the longest, then that of the smallest id."""
    rows, row = numbered(docs)
    gone = exact_dedup(rows.select(_rank(row).alias("rank"), "text"), id_col="rank").where("not kept").select(F.col("doc_id.row").alias(row))
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by similar sets of five-word shingles."""
    rows, row = numbered(docs)
    found = ngram_jaccard(rows.select(row, "text"), n_words=5, percent=80, id_col=row)
    linked = found.where("component_id != doc_id").select(F.col("doc_id").alias(row), "component_id")
    groups = linked.unionByName(linked.select(F.col("component_id").alias(row), "component_id").distinct())
    ranks = groups.join(rows.select(row, _rank(row).alias("rank")), row)
    gone = ranks.join(ranks.groupBy("component_id").agg(F.min("rank").alias("least")), "component_id").where("rank != least").select(row)
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is a source like others."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's token ids, and a digest of the text they decode to."""
    d = bpe_encode(docs, tokenizer_path())
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("exact_dedup", copies), ("ngram_jaccard", near_copies), ("mix_sources", mix), ("bpe", tokens)]
#: The first stage is a trained classifier, which SQL can't express; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; what a stage no longer needs is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = save(stage(spark, docs, sf_dir), name)
            made.remove(docs)
            if before is not None:
                made.append(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
