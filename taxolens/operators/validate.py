"""Constraints as queries: each returns the rows that break it, and must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.functions.text import is_blank, phrase_ascii
from taxolens.operators.audit import LEVELS

#: Prefix of topic and parent ids.
PREFIX = "https://openalex.org/"
PARTITIONS = ("train", "calibration", "test")
JUDGMENTS = ("placement_candidate", "plausible_placement", "unresolved")


class InputError(ValueError):
    """Input that breaks a constraint."""


def broken_topics(topics: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """(topic_id, reason) of rows with a bad id, name, keyword, count or parent."""
    bad = lambda test, reason: F.when(F.coalesce(test, F.lit(True)), F.lit(reason))
    escaped = prefix.replace(".", r"\.")
    checks = [
        bad(~F.col("topic_id").rlike(f"^{escaped}T[0-9]+$"), "topic id"),
        bad(is_blank("topic"), "display name"),
        bad(F.col("keywords").isNull() | F.exists("keywords", lambda k: k.isNull() | (F.length(phrase_ascii(k)) == 0)), "keywords"),
        bad(F.col("works_count") < 0, "works count"),
        *[bad(~F.col(f"{v}_id").rlike(f"^{escaped}{v}s/[0-9]+$"), f"{v} id") for v in LEVELS],
        *[bad(is_blank(f"{v}_name"), f"{v} name") for v in LEVELS],
    ]
    return topics.select("topic_id", F.explode(F.filter(F.array(*checks), lambda r: r.isNotNull())).alias("reason"))


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return rows.groupBy(*keys).count().where("count > 1")


def hierarchy(topics: DataFrame) -> DataFrame:
    """(level, id, name, parent_id): the distinct parents of all levels."""
    rows = [
        topics.select(F.lit(v).alias("level"), F.col(f"{v}_id").alias("id"), F.col(f"{v}_name").alias("name"), (F.col(f"{LEVELS[i + 1]}_id") if i + 1 < len(LEVELS) else F.lit(None).cast("string")).alias("parent_id"))
        for i, v in enumerate(LEVELS)
    ]
    return reduce(DataFrame.unionByName, rows).distinct()


def hierarchy_breaks(topics: DataFrame) -> DataFrame:
    """(level, id, versions) of parents with more than one name or ancestry."""
    rows = []
    for i, v in enumerate(LEVELS):
        above = [F.coalesce(F.col(f"{u}_id"), F.lit("")) for u in LEVELS[i + 1 :]]
        rows.append(topics.select(F.lit(v).alias("level"), F.col(f"{v}_id").alias("id"), F.struct(F.col(f"{v}_name").alias("name"), F.concat_ws("|", *above, F.lit("")).alias("above")).alias("identity")))
    return reduce(DataFrame.unionByName, rows).groupBy("level", "id").agg(F.count_distinct("identity").alias("versions")).where("versions > 1")


def broken_records(records: DataFrame, labelled: bool = False) -> DataFrame:
    """(id, reason) of records with a bad shape; with ``labelled``, bad truth too."""
    bad = lambda test, reason: F.when(F.coalesce(test, F.lit(True)), F.lit(reason))
    checks = [bad(is_blank("id"), "id"), *[bad(F.col(f"metadata.{c}").isNull(), c) for c in ("title", "source", "type")], bad(F.exists(F.coalesce("metadata.keywords", F.array().cast("array<string>")), lambda k: k.isNull()), "keywords")]
    if labelled:
        checks += [
            bad(~F.array_contains("truth.topic_ids", F.col("truth.primary_topic_id")), "primary topic"),
            bad(~F.size("truth.topic_ids").between(1, 3), "number of topics"),
            bad(~F.col("partition").isin(*PARTITIONS), "partition"),
            bad(F.col("split_group").isNull(), "split group"),
        ]
    return records.select("id", F.explode(F.filter(F.array(*checks), lambda r: r.isNotNull())).alias("reason"))


def unknown_topics(truth: DataFrame, topics: DataFrame) -> DataFrame:
    """(work_id, topic_id) of truth that the taxonomy lacks."""
    return truth.select("work_id", F.explode("topic_ids").alias("topic_id")).join(topics.select("topic_id"), "topic_id", "left_anti").select("work_id", "topic_id")


def foreign_samples(samples: DataFrame) -> DataFrame:
    """(sink_id, work_id) of sampled works that aren't filed under their sink."""
    return samples.where(~F.coalesce(F.array_contains("topic_ids", F.col("sink_id")), F.lit(False))).select("sink_id", "work_id")


def review_gaps(top: DataFrame, notes: DataFrame, digest: str | None = None) -> DataFrame:
    """(topic_id, reason): top rows without one note, notes without a top row, unknown
    judgments, empty reasons, and notes on another snapshot."""
    counted = notes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    both = top.select("topic_id", F.lit(True).alias("there")).join(counted, "topic_id", "full_outer")
    cover = both.select("topic_id", F.when(F.col("n").isNull(), "not reviewed").when(F.col("there").isNull(), "not in the top").when(F.col("n") > 1, "reviewed twice").alias("reason")).where("reason is not null")
    wrong = notes.select("topic_id", F.when(~F.col("judgment").isin(*JUDGMENTS), "unknown judgment").when(F.length("reason") == 0, "no reason").when(F.lit(digest is not None) & (F.col("input_sha256") != F.lit(digest)), "another snapshot").alias("why")).where("why is not null")
    return cover.unionByName(wrong.select("topic_id", F.col("why").alias("reason")))


def demand(rows: DataFrame, what: str) -> None:
    """Raise InputError with some examples unless ``rows`` is empty."""
    found = rows.limit(3).collect()
    if found:
        raise InputError(f"{what}: {'; '.join(str(r.asDict()) for r in found)}")
