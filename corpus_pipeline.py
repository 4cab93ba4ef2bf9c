"""From raw documents to packed sequences, in five stages.

1. quality rules: documents whose base test or posterior quality fails go. Rows without an id get a negative one from a
   hash of their text, so that all later decisions can name them.
2. n-gram Jaccard join: of each group of near copies (five words, 0.8) the smallest id stays.
3. substring dedup: words of 20-word windows that occur earlier go; documents of which nothing is left go.
4. mixing: each document is taken as often as the target weights of its source ask, repeats as repeated rows.
5. best-fit packing: pieces of at most 1024 tokens with their sequence and place.

Each stage works on all that its predecessor kept and reads it from a written table, so a lost executor costs one stage
at most. Stages 1 to 4 return the columns of their input; extra columns pass through. Names with ``_q_``, ``_k``,
``_n``, ``_first``, ``_removed``, ``_kept``, ``_id``, ``_source``, ``_size``, ``_copies`` and ``_copy`` are used inside.
An empty table gives no rows; null texts fail the base test of stage 1; repeated rows are copies, of which stage 2
leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tendersift.llm import jaccard, mixing, packing, rules, substrings
from tendersift.llm.common import prepare, staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = -1 - F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(1 << 62))
    return rules.keep_good(docs.withColumn("doc_id", F.coalesce(F.col("doc_id"), own)))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, size=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.rewrite(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.materialise(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Expectation-maximisation, tokenising and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
