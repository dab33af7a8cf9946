"""Coverage of a taxonomy: counts of works without a topic, of partitions and judgments,
and the flat table of topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.functions.text import short_id

LEVELS = ("subfield", "field", "domain")


def by_year(unassigned: DataFrame, total: DataFrame) -> DataFrame:
    """(publication_year, unassigned_works, total_works), the latest year first; both given
    as (publication_year, works). A year without a total has null."""
    left = unassigned.select("publication_year", F.col("works").alias("unassigned_works"))
    right = total.select("publication_year", F.col("works").alias("total_works"))
    return left.join(right, "publication_year", "left").select("publication_year", "unassigned_works", "total_works").orderBy(F.col("publication_year").desc())


def by_source(counts: DataFrame, least: int) -> DataFrame:
    """Sources of ``counts`` (type, source_id, unassigned_works and more) with at least so
    many works, the most first, then by type and source."""
    return counts.where(F.col("unassigned_works") >= least).orderBy(F.col("unassigned_works").desc(), "type", "source_id")


def counted(rows: DataFrame, *by: str, into: str = "works") -> DataFrame:
    """How many rows there are of each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias(into))


def partitions(works: DataFrame, label: str) -> DataFrame:
    """(partition, works, labels): works and distinct labels of each partition."""
    return works.groupBy("partition").agg(F.count(F.lit(1)).alias("works"), F.count_distinct(label).alias("labels"))


def topic_table(topics: DataFrame, *more: str) -> DataFrame:
    """Topics as a flat table with short ids, the most works first: the columns of ``more``
    stand between the number of works and that of keywords as listed."""
    short = lambda c: short_id(c).alias(c)
    parents = [c for v in LEVELS for c in (short(f"{v}_id"), F.col(f"{v}_name").alias(v))]
    return topics.select(short("topic_id"), "topic", *parents, "works_count", *more, F.size("keywords").cast("long").alias("keyword_count")).orderBy(F.col("works_count").desc(), "topic_id")
