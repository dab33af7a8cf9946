"""Families of records, leak-proof partitions and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.functions.text import fold_case, hash_bucket, short_id, title_key
from taxolens.operators.components import connected_components, store
from taxolens.operators.ordering import lowest, median

# Upper ends of the buckets.
TRAIN_BELOW, CALIBRATION_BELOW = 0.6, 0.8
MOST_TOPICS = 3


def family_keys(records: DataFrame) -> DataFrame:
    """(id, kind, key): what makes records one family. ``records``: id, source_id, doi,
    title; empty and null keys make none."""
    keys = F.array(
        F.struct(F.lit("source").alias("kind"), F.col("source_id").alias("key")),
        F.struct(F.lit("doi").alias("kind"), fold_case("doi").alias("key")),
        F.struct(F.lit("title").alias("kind"), title_key("title").alias("key")),
    )
    return records.select("id", F.explode(keys).alias("k")).select("id", "k.kind", "k.key").where("key is not null and key <> ''")


def families(records: DataFrame) -> DataFrame:
    """(id, family): the least id of all records linked through shared keys.

    Each key links its records to its least id: a star, not all pairs. Keys, which may be
    whole texts, meet as 128-bit hashes, which are made once."""
    keys = store(family_keys(records).select("id", "kind", F.md5("key").alias("key")), "keys")
    least = keys.groupBy("kind", "key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = keys.join(least, ["kind", "key"]).select(F.col("id").alias("u"), F.col("least").alias("v"))
    parts = connected_components(edges).withColumnRenamed("id", "__id")
    return records.select("id").distinct().join(parts, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("component", "id").alias("family"))


def split_group(family: Column, seed: int = 42) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), family), 256)


def partition_of(family: Column, seed: int = 42) -> Column:
    """train, calibration or test (60/20/20) by a hash of the family."""
    bucket = hash_bucket(F.concat(F.lit(f"{seed}:"), family))
    return F.when(bucket < TRAIN_BELOW, "train").when(bucket < CALIBRATION_BELOW, "calibration").otherwise("test")


def assign_partitions(records: DataFrame, seed: int = 42) -> DataFrame:
    """``records`` with split_group and partition; a family is never divided."""
    found = families(records)
    return records.join(found, "id").withColumns({"split_group": split_group(F.col("family"), seed), "partition": partition_of(F.col("family"), seed)})


def leaks(records: DataFrame) -> DataFrame:
    """(kind, key, partitions) of keys found in more than one partition: must be empty.
    ``records`` also has partition and split_group."""
    rows = family_keys(records).unionByName(records.select("id", F.lit("group").alias("kind"), F.col("split_group").alias("key")).where("key is not null and key <> ''"))
    return rows.join(records.select("id", "partition"), "id").groupBy("kind", "key").agg(F.count_distinct("partition").alias("partitions")).where("partitions > 1")


def seeded_sample(rows: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` rows by a hash of seed and key; the same rows for the same seed."""
    if not 1 <= size <= 10_000:
        raise ValueError("sample size must be 1-10000")
    return rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(size)


def sample_by(rows: DataFrame, by: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """A seeded sample of each group: its ``size`` lowest rows by a hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return lowest(rows, [by], digest, [F.col(key)], size)


def oversized(topics: DataFrame, multiple: float = 20.0) -> DataFrame:
    """Topics with more than ``multiple`` times the median number of works."""
    middle = median(topics, "works_count")
    return topics.withColumn("median_topic_works", F.lit(middle).cast("double")).where(F.col("works_count") > multiple * F.col("median_topic_works"))


def truth_topics(primary: Column, topics: Column) -> Column:
    """At most three short topic ids; the primary first where the others lack it."""
    ids = F.transform(F.filter(F.slice(F.coalesce(topics, F.array().cast("array<string>")), 1, MOST_TOPICS), lambda t: t.isNotNull()), short_id)
    own = short_id(primary)
    return F.when(primary.isNotNull() & ~F.array_contains(ids, own), F.slice(F.concat(F.array(own), ids), 1, MOST_TOPICS)).otherwise(ids)


def normalise_works(works: DataFrame, known: DataFrame) -> DataFrame:
    """API works as records: id, doi, source_id, metadata, truth and ``unknown`` (topics
    absent from ``known``, whose rows have topic_id)."""
    rows = works.select(
        "id", "doi", F.col("primary_location.source.id").alias("source_id"),
        F.struct(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("primary_location.source.display_name", F.lit("")).alias("source"), F.coalesce("type", F.lit("")).alias("type"), F.array().cast("array<string>").alias("keywords")).alias("metadata"),
        F.struct(short_id("primary_topic.id").alias("primary_topic_id"), truth_topics(F.col("primary_topic.id"), F.col("topics.id")).alias("topic_ids")).alias("truth"),
    )
    named = rows.select("id", F.explode("truth.topic_ids").alias("topic_id")).join(known.select("topic_id"), "topic_id", "left_anti").groupBy("id").agg(F.array_sort(F.collect_set("topic_id")).alias("unknown"))
    return rows.join(named, "id", "left")
