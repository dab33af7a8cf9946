"""Readers: topic snapshots, labelled datasets, sink samples, prediction records, reviews.

Schemas are explicit and reading fails on malformed rows; fields that a schema doesn't
name never reach an operator. Each reader returns DataFrames with the SHA-256 of the
file's bytes, after its constraints (``validate``) have come back empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxolens.functions.text import is_blank, short_id
from taxolens.operators import partition, validate
from taxolens.operators.audit import LEVELS
from taxolens.operators.validate import InputError, demand

_PARENT = "struct<id:string,display_name:string>"
_METADATA = "struct<title:string,source:string,type:string,keywords:array<string>>"
_TRUTH = "struct<primary_topic_id:string,topic_ids:array<string>>"
_RECORD = f"id:string,doi:string,source_id:string,metadata:{_METADATA},truth:{_TRUTH}"
_SAMPLING = "struct<urls:array<string>,requested:bigint,returned:bigint,api_count:bigint>"
SNAPSHOT = (
    "schema_version bigint, source string, retrieved_at string, topic_count bigint, topics array<struct<id:string,display_name:string,description:string,keywords:array<string>,"
    + ",".join(f"{v}:{_PARENT}" for v in LEVELS)
    + ",works_count:bigint,cited_by_count:bigint,created_date:string,updated_date:string,sibling_count:bigint>>"
)
PLACE = f"schema_version bigint, kind string, taxonomy_sha256 string, seed bigint, records array<struct<{_RECORD},partition:string,split_group:string>>"
SINKS = f"schema_version bigint, kind string, taxonomy_sha256 string, seed bigint, threshold_multiple bigint, median_topic_works double, sinks array<struct<topic_id:string,topic:string,works_count:bigint,sampling:{_SAMPLING},records:array<struct<{_RECORD}>>>>"
JSONL = f"id string, metadata {_METADATA}"


@dataclass
class Document:
    """A header (one row as a dict), its rows, and the digest of the file."""

    header: dict
    rows: DataFrame
    sha256: str


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, read by Spark."""
    try:
        return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    except (PySparkException, Py4JJavaError, TypeError) as e:
        raise InputError(f"cannot read {path}: {str(e).splitlines()[0]}") from e


def _document(spark: SparkSession, path: str, schema: str, rows: str) -> tuple[dict, DataFrame, str]:
    sha = digest(spark, path)
    try:
        # FAILFAST turns a wrong type (a float count, a string list) into an error
        whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("prefersDecimal", False).json(path)
        found = whole.select(*[c for c in whole.columns if c != rows], F.size(rows).alias("__n")).collect()
    except (PySparkException, Py4JJavaError) as e:
        raise InputError(f"invalid JSON in {path}: {str(e).splitlines()[0]}") from e
    if len(found) != 1:
        raise InputError(f"expected one JSON document in {path}")
    header = found[0].asDict()
    if header.pop("__n") < 1:
        raise InputError(f"{path} has no {rows}")
    if header["schema_version"] != 1:
        raise InputError(f"{path} needs schema_version 1")
    return header, whole.select(F.explode(rows).alias("r")).select("r.*"), sha


def read_snapshot(spark: SparkSession, path: str) -> Document:
    """Topics of a snapshot: topic_id, topic, keywords, counts, dates and parents."""
    header, rows, sha = _document(spark, path, SNAPSHOT, "topics")
    topics = rows.select(
        F.col("id").alias("topic_id"), F.col("display_name").alias("topic"), "description", "keywords", "works_count", "cited_by_count", "sibling_count", "created_date", "updated_date",
        *[F.col(f"{v}.{f}").alias(f"{v}_{g}") for v in LEVELS for f, g in (("id", "id"), ("display_name", "name"))],
    )
    if header["topic_count"] != topics.count():
        raise InputError("topic_count does not match the topics")
    demand(validate.repeated(topics, "topic_id"), "duplicate topic")
    demand(validate.broken_topics(topics), "malformed topic")
    demand(validate.hierarchy_breaks(topics), "inconsistent hierarchy")
    return Document(header, topics, sha)


def taxonomy(topics: DataFrame) -> DataFrame:
    """Topics by short ids: topic_id, and per level an id and a name."""
    return topics.select(short_id("topic_id").alias("topic_id"), *[c for v in LEVELS for c in (short_id(f"{v}_id").alias(v), F.col(f"{v}_name").alias(f"{v}_name"))])


def labels(tax: DataFrame, level: str) -> DataFrame:
    """Options of a level: option_id, option_name; the last name in order wins."""
    return tax.groupBy(F.col(level).alias("option_id")).agg(F.max(f"{level}_name").alias("option_name"))


def read_place(spark: SparkSession, path: str, taxonomy_sha256: str | None = None) -> Document:
    """A labelled dataset; partitions must not share a group, source, doi or title."""
    header, rows, sha = _document(spark, path, PLACE, "records")
    _kind(header, "place_dataset", taxonomy_sha256)
    demand(validate.broken_records(rows, labelled=True), "malformed record")
    demand(validate.repeated(rows, "id"), "duplicate work id")
    demand(partition.leaks(rows.select("id", "source_id", "doi", F.col("metadata.title").alias("title"), "partition", "split_group")), "partition leakage")
    return Document(header, rows, sha)


def read_sinks(spark: SparkSession, path: str, taxonomy_sha256: str | None = None) -> Document:
    """Sampled works, one row per (sink, work): topic_id, topic, works_count, record."""
    header, rows, sha = _document(spark, path, SINKS, "sinks")
    _kind(header, "sink_samples", taxonomy_sha256)
    demand(rows.where("topic_id is null or topic is null or works_count is null or works_count < 0 or records is null"), "invalid sink")
    demand(validate.repeated(rows, "topic_id"), "duplicate sink topic")
    works = rows.select("topic_id", "topic", "works_count", F.explode("records").alias("r")).select(F.col("topic_id").alias("sink_id"), "topic", "works_count", "r.*")
    demand(validate.broken_records(works), "malformed record")
    demand(validate.repeated(works, "sink_id", "id"), "duplicate sampled work")
    demand(validate.foreign_samples(works.select("sink_id", F.col("id").alias("work_id"), F.col("truth.topic_ids").alias("topic_ids"))), "sampled sink is absent from its topics")
    return Document(header, works, sha)


def read_records(spark: SparkSession, path: str) -> Document:
    """Prediction records, one JSON object a line; blank lines are skipped."""
    sha = digest(spark, path)
    try:
        rows = spark.read.schema(JSONL).option("mode", "FAILFAST").json(path)
        if rows.isEmpty():
            raise InputError("input JSONL is empty")
        demand(validate.broken_records(rows), "malformed record")
        demand(validate.repeated(rows, "id"), "duplicate work id")
    except (PySparkException, Py4JJavaError) as e:
        raise InputError(f"expected input JSONL: {str(e).splitlines()[0]}") from e
    return Document({}, rows, sha)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """Review notes: topic_id, judgment, reason, input_sha256 from a tab-separated file."""
    return spark.read.schema("topic_id string, judgment string, reason string, input_sha256 string").option("sep", "\t").option("header", True).option("nullValue", "\u0000").csv(path).fillna("")


def _kind(header: dict, kind: str, sha: str | None) -> None:
    if header["kind"] != kind:
        raise InputError(f"expected a {kind} document")
    if sha and header["taxonomy_sha256"] != sha:
        raise InputError("its taxonomy differs from that of the topics")


def feature_columns(rows: DataFrame) -> DataFrame:
    """work_id, title, source, type, keywords of records."""
    return rows.select(F.col("id").alias("work_id"), "metadata.title", "metadata.source", "metadata.type", F.coalesce("metadata.keywords", F.array().cast("array<string>")).alias("keywords"))


def blank(rows: DataFrame) -> DataFrame:
    """Rows whose title is blank."""
    return rows.where(is_blank("title"))
