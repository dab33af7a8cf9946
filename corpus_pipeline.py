"""The corpus pipeline: filter, deduplicate, decontaminate, mix, tokenise.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. Rows rejected by a stage are gone
for the next; the mix repeats rows as often as it takes them.

Defined cases: null, empty and wordless texts fail the quality rules and go first; rows
without an id are no copies of anything and stay until the mix; repeated rows of an id
count once after the near-duplicate stage; ties go as each operator says; very long texts
pass every stage whole; more columns, whatever their names and types, are carried along
to the last stage; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxolens.llm import decontaminate, mixing, parity_join, quality, wavelet
from taxolens.llm.common import keep, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the classifier keep."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of linked documents."""
    return parity_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; mostly covered ones are gone."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, up to three times."""
    return mixing.mix(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet shards, read back: doc_id, start, n_tokens, ids_crc32."""
    return wavelet.tokenised(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_shards),
]

#: SQL can express neither the classifier nor the mix; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
