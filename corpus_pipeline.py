"""A training corpus in five stages: language ID, near duplicates, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of documents. SQL expresses none of naive Bayes, the tokenizer or the suffix
automaton, so tests/llm holds the stages against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import decontaminate, jaccard, langid, mixing, tokens
from tracelake.llm.common import apart, staged

#: A document is rejected if its language is this unsure.
MIN_LANG_SCORE = 0.5
#: Near duplicates: words of a shingle, and the least similarity of the sets in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Column of a row's own key within a stage; the stages give other columns names of their own.
ROW = "_row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a missing lang is filled in. Text without letters, and unsure text, goes."""
    docs, given = apart(docs, ("doc_id", "text", "lang"))
    found = langid.identify(docs, langid.fit(docs), keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANG_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*given)


def numbered(docs: DataFrame, tag: str) -> DataFrame:
    """docs with a key of each row in ROW, written so that it stays the same: doc_id may be null or repeat. The whole texts stay on disk, so they are packed well."""
    return staged(docs.withColumn(ROW, F.monotonically_increasing_id()), tag, codec="zstd")


def chosen(rows: DataFrame, keep: DataFrame) -> DataFrame:
    """The numbered rows that keep names, once each. Runs of 64 numbers are one row of bits, small enough that whole texts need no exchange to meet them."""
    bits = keep.groupBy(F.shiftright(ROW, 6).alias("_run")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({ROW} & 63 AS INT)))").alias("_bits"))
    met = rows.withColumn("_run", F.shiftright(ROW, 6)).join(staged(bits, "near-bits"), "_run")
    return met.where(F.expr(f"getbit(_bits, CAST({ROW} & 63 AS INT)) = 1")).select(*rows.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: the one with the smallest doc_id, without doc_id only if none has one. Rows without words all stay."""
    docs, given = apart(docs, ("doc_id", "text"))
    rows = numbered(docs, "near-rows")
    found = jaccard.jaccard_join(rows.select(F.col(ROW).alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    keep = rows.select(ROW, "doc_id").join(found, ROW).groupBy("component_id").agg(first.alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    return chosen(rows, keep).select(*given)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such passages go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the blocks of the mixture of sources hold them, every one at least once; null and repeated doc_ids stay."""
    docs, given = apart(docs, ("doc_id", "text", "source", "n_chars"))
    rows = numbered(docs, "mix-rows")
    copies = mixing.blocks(mixing.mix(rows, keep=(ROW,))).select(ROW)
    return rows.join(copies, ROW).select(*given)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file of docs, described by what is read back from it; rows without doc_id come first, repeated ones each count."""
    return tokens.token_output(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("mixed", mixed), ("token_ids", token_ids)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
