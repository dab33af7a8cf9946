"""Placement: scoring records against labels, routes, truth, calibration and export.

A scorer turns (record, options) into a distribution. Here it is a DataFrame of scores
``work_id, option_id, logit`` for the options a record is asked about; any model that
yields such rows fits (``Scorer``). Flat placement asks about all labels of a level;
hierarchical placement asks, level by level, about the children of what was chosen, and
doesn't ask where there is one child.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.stats import accumulated, best_cut, dot, unit, vector_sums, wilson
from taxolens.operators import scoring
from taxolens.operators.components import store

ROUTE = ("domain", "field", "subfield")
PARENT = {"field": "domain", "subfield": "field"}
#: Labels that one record is asked about at once, where a scorer takes rows only.
MOST_LABELS = 10_000
#: Decimals at which probabilities are compared, so that ties go by id.
COMPARE = 9
SHARPNESS = 10.0
# The statuses of predictions and of evaluations.
PREDICTED, ACCEPTED, ABSTAIN, UNCALIBRATED, NO_METADATA = "predicted", "accepted", "abstain", "review_uncalibrated", "insufficient_metadata"


class Scorer(Protocol):
    """``identity`` names model and version; ``logits`` scores (work_id, option_id) rows
    of one level, of which there may be very many, without collecting them. A scorer that
    also has ``best(records, options, level, most)`` gives each record's best of all
    ``options`` (option_id, option_name) without a row for each; then their number has no
    limit."""

    identity: dict

    def logits(self, asked: DataFrame, level: str) -> DataFrame: ...


class CentroidScorer:
    """Cosine to the mean vector of each label's training records."""

    def __init__(self, vectors: DataFrame, train: DataFrame, sharpness: float = SHARPNESS):
        """``vectors``: work_id, vector. ``train``: work_id and a label id per level."""
        self.identity = {"scorer": "centroid", "sharpness": sharpness}
        self.vectors, self.sharpness = vectors, sharpness
        self.centroids = {
            level: store(vector_sums(vectors.join(train.select("work_id", F.col(level).alias("option_id")), "work_id"), ["option_id"], "vector").select("option_id", unit(F.col("s")).alias("centroid")), "centroids")
            for level in ROUTE
        }

    def logits(self, asked: DataFrame, level: str) -> DataFrame:
        scored = asked.join(self.vectors, "work_id").join(self.centroids[level], "option_id", "left")
        return scored.select("work_id", "option_id", F.coalesce(dot(F.col("vector"), F.col("centroid")), F.lit(-1.0)).alias("cosine")).select("work_id", "option_id", (F.col("cosine") * self.sharpness).alias("logit"))

    def best(self, records: DataFrame, options: DataFrame, level: str, most: int = 3) -> DataFrame:
        """Products of vectors with the matrix of centroids, in blocks."""
        labels = options.join(self.centroids[level].withColumnRenamed("centroid", "vector"), "option_id", "left")
        return scoring.by_vectors(records.select("work_id").join(self.vectors, "work_id"), labels, self.sharpness, most)


class MapScorer:
    """A user's function on Arrow batches of (work_id, text, option_id, option_name), which
    returns batches of (work_id, option_id, logit); it may load a model once a worker."""

    def __init__(self, identity: dict, texts: DataFrame, names: dict[str, DataFrame], function):
        self.identity, self.texts, self.names, self.function = identity, texts, names, function

    def logits(self, asked: DataFrame, level: str) -> DataFrame:
        rows = asked.join(self.texts, "work_id").join(self.names[level], "option_id").select("work_id", "text", "option_id", "option_name")
        return rows.mapInArrow(self.function, "work_id string, option_id string, logit double")

    def best(self, records: DataFrame, options: DataFrame, level: str, most: int = 3) -> DataFrame:
        return scoring.by_function(records.select("work_id").join(self.texts, "work_id"), options, self.function, most)


def probabilities(logits: DataFrame) -> DataFrame:
    """work_id, option_id, p: softmax over each record's options."""
    own = Window.partitionBy("work_id")
    shifted = logits.withColumn("w", F.exp(F.col("logit") - F.max("logit").over(own)))
    return shifted.select("work_id", "option_id", (F.col("w") / F.sum("w").over(own)).alias("p"))


def _ranked(p: DataFrame) -> DataFrame:
    order = Window.partitionBy("work_id").orderBy(F.round("p", COMPARE).desc(), "option_id")
    return p.withColumn("place", F.row_number().over(order))


def candidates(p: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """work_id and its best options as an array of (id, name, probability)."""
    top = _ranked(p).where(F.col("place") <= most).join(names, "option_id")
    return top.groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("place", F.col("option_id").alias("id"), F.col("option_name").alias("name"), F.col("p").alias("probability")))).alias("c")).select(
        "work_id", F.transform("c", lambda x: F.struct(x.id.alias("id"), x["name"].alias("name"), x.probability.alias("probability"))).alias("candidates")
    )


def _every(records: DataFrame, options: DataFrame) -> DataFrame:
    """Each record with each option: what flat placement asks. A level's labels are few by
    nature (``MOST_LABELS``), so they travel to the records; more of them are an error."""
    n = options.limit(MOST_LABELS + 1).count()
    if n > MOST_LABELS:
        raise ValueError(f"a record is asked about at most {MOST_LABELS} labels")
    one = options.agg(F.collect_list(F.struct(*options.columns)).alias("__all"))
    return records.crossJoin(F.broadcast(one)).select(*records.columns, F.inline("__all"))


def flat(records: DataFrame, options: DataFrame, scorer: Scorer, level: str = "subfield") -> DataFrame:
    """work_id, prediction, confidence, candidates: each record against every label of
    the level (``options``: option_id, option_name, as many as the taxonomy has)."""
    if getattr(scorer, "best", None):
        return scorer.best(records.select("work_id"), options.select("option_id", "option_name"), level)
    asked = _every(records.select("work_id"), options.select("option_id"))
    p = probabilities(scorer.logits(asked, level))
    best = _ranked(p).where("place = 1").select("work_id", F.col("option_id").alias("prediction"), F.col("p").alias("confidence"))
    return best.join(candidates(p, options), "work_id")


def hierarchical(records: DataFrame, taxonomy: DataFrame, scorer: Scorer, level: str = "subfield") -> DataFrame:
    """work_id, prediction, confidence, candidates, route. ``taxonomy`` has a row per
    subfield: domain, field, subfield ids and ``*_name``s. Confidence is the product of
    the route's probabilities; candidates are those of the last level, times the path."""
    state = records.select("work_id", F.lit(None).cast("string").alias("chosen"), F.lit(1.0).alias("path"), F.array().cast("array<struct<level:string,id:string,probability:double>>").alias("route"))
    last = names = None
    for current in ROUTE[: ROUTE.index(level) + 1]:
        above = PARENT.get(current)
        options = taxonomy.select(F.col(current).alias("option_id"), F.col(f"{current}_name").alias("option_name"), *([F.col(above).alias("chosen")] if above else [])).distinct()
        asked = state.select("work_id", "chosen").join(options, "chosen") if above else _every(state.select("work_id"), options)
        asked = asked.select("work_id", "option_id")
        single = asked.groupBy("work_id").agg(F.count(F.lit(1)).alias("n"), F.first("option_id").alias("option_id")).where("n = 1")
        alone = single.select("work_id", "option_id", F.lit(1.0).alias("p"))
        scored = probabilities(scorer.logits(asked.join(single.select("work_id"), "work_id", "left_anti"), current))
        p = store(scored.unionByName(alone), "scores")  # used by route and candidates
        best = _ranked(p).where("place = 1").select("work_id", "option_id", "p")
        last = p.join(state.select("work_id", "path"), "work_id").select("work_id", "option_id", (F.col("p") * F.col("path")).alias("p"))
        names = options.select("option_id", "option_name").distinct()
        step = F.struct(F.lit(current).alias("level"), F.col("option_id").alias("id"), F.col("p").alias("probability"))
        state = store(state.join(best, "work_id").select("work_id", F.col("option_id").alias("chosen"), (F.col("path") * F.col("p")).alias("path"), F.array_append("route", step).alias("route")), "route")
    return state.select("work_id", F.col("chosen").alias("prediction"), F.col("path").alias("confidence"), "route").join(candidates(last, names), "work_id")


def with_status(records: DataFrame, predictions: DataFrame, insufficient: Column) -> DataFrame:
    """``records`` with predictions; those without metadata have none, whatever a scorer
    says, with confidence 0."""
    joined = records.withColumn("__blank", insufficient).join(predictions, "work_id", "left")
    for c in set(predictions.columns) - {"work_id"}:
        joined = joined.withColumn(c, F.when(~F.col("__blank"), F.col(c)))
    return joined.withColumns({"status": F.when(F.col("__blank"), NO_METADATA).otherwise(PREDICTED), "confidence": F.coalesce("confidence", F.lit(0.0))}).drop("__blank")


def labelled(rows: DataFrame, truth: DataFrame, topics: DataFrame, level: str = "subfield") -> DataFrame:
    """Adds true_primary, true_any_topic and three booleans. ``truth``: work_id,
    primary_topic_id, topic_ids; ``topics``: topic_id and a column per level."""
    parent = topics.select("topic_id", F.col(level).alias("parent"))
    primary = truth.join(parent, truth.primary_topic_id == parent.topic_id).select("work_id", F.col("parent").alias("true_primary"))
    every = truth.select("work_id", F.explode("topic_ids").alias("topic_id")).join(parent, "topic_id").groupBy("work_id").agg(F.array_sort(F.collect_set("parent")).alias("true_any_topic"))
    return rows.join(primary, "work_id").join(every, "work_id").withColumns(
        {
            "correct_primary": F.coalesce(F.col("prediction") == F.col("true_primary"), F.lit(False)),
            "correct_any_topic": F.coalesce(F.array_contains("true_any_topic", F.col("prediction")), F.lit(False)),
            "primary_in_top3_predictions": F.coalesce(F.array_contains(F.transform("candidates", lambda c: c.id), F.col("true_primary")), F.lit(False)),
        }
    )


def apply_threshold(rows: DataFrame, cutoff: float | None) -> DataFrame:
    """Predicted rows become accepted at or above the cutoff, else abstain; a null
    cutoff abstains on all. Other rows stay."""
    if cutoff is not None and not (isinstance(cutoff, (int, float)) and not isinstance(cutoff, bool) and 0 <= cutoff <= 1):
        raise ValueError("calibration threshold is invalid")
    passed = F.lit(False) if cutoff is None else F.col("confidence") >= float(cutoff)
    return rows.withColumn("status", F.when(F.col("status") != PREDICTED, F.col("status")).when(passed, ACCEPTED).otherwise(ABSTAIN))


def uncalibrated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("status", F.when(F.col("status") == PREDICTED, UNCALIBRATED).otherwise(F.col("status")))


REFERENCES = ("primary", "any_topic")


def _steps(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of calibration and test counted by reference, partition, confidence and ``by``:
    n, and ``right`` ones. All of an evaluation comes from these counts."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"correct_{v}").alias("hit")) for v in REFERENCES]))
    said = rows.where(F.col("partition").isin("calibration", "test")).select("partition", (F.col("status") == PREDICTED).alias("said"), "confidence", *by, each.alias("r"))
    counts = said.groupBy(F.col("r.name").alias("reference"), "partition", "said", "confidence", *by)
    return store(counts.agg(F.count(F.lit(1)).alias("n"), F.count_if("r.hit").alias("right")), "steps")


def evaluate(rows: DataFrame, target: float = 0.9, minimum: int = 20, by: list[str] | None = None, overall: bool = False) -> DataFrame:
    """One row per reference (and group): the threshold fitted on calibration rows,
    measured on test rows, with a status. ``rows`` are labelled and have ``partition``;
    they are read once. ``overall`` adds the rows of all groups together, with nulls for
    ``by``, in the same pass (grouping sets), and a column ``whole`` that tells them."""
    by = by or []
    steps = _steps(rows, by)
    tuned = steps.where("partition = 'calibration'")
    names = rows.sparkSession.createDataFrame([(v,) for v in REFERENCES], "reference string")
    curve = accumulated(tuned.where("said").groupBy("reference", F.col("confidence").alias("threshold")).agg(F.sum("n").alias("rows"), F.sum("right").alias("right")), ["reference"])
    cut = names.join(tuned.groupBy("reference").agg(F.sum("n").alias("all")), "reference", "left").join(best_cut(curve, target, minimum, ["reference"]), "reference", "left")
    zero = F.lit(0).cast("long")
    fitted = store(cut.select(
        "reference", "threshold", F.coalesce("accepted", zero).alias("calibration_accepted"), F.coalesce("correct", zero).alias("calibration_correct"),
        F.col("precision").alias("calibration_precision"), F.coalesce(F.col("accepted") / F.col("all"), F.lit(0.0)).alias("calibration_coverage"),
    ), "fitted")
    taken = F.coalesce(F.col("said") & (F.col("confidence") >= F.col("threshold")), F.lit(False))
    test = steps.where("partition = 'test'").join(F.broadcast(fitted.select("reference", "threshold")), "reference").withColumn("taken", taken)  # a row a reference
    sums = [F.sum("n").alias("total"), F.sum(F.when(F.col("taken"), F.col("n")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("taken"), F.col("right")).otherwise(0)).alias("correct"), F.sum("right").alias("right")]
    if overall and by:
        own = [F.col("reference"), *map(F.col, by)]
        found = test.groupingSets([own, own[:1]], *own).agg(*sums, (F.grouping(by[0]) == 1).alias("whole"))
    else:
        found = test.groupBy("reference", *by).agg(*sums)
    low, high = wilson(F.col("correct"), F.col("accepted"))
    status = F.when(F.col("threshold").isNull(), "abstain_all").when(F.col("accepted") == 0, "no_test_acceptances").when(F.col("precision") >= target, "target_met_on_test").otherwise("target_not_met_on_test")
    measured = found.join(F.broadcast(fitted), "reference").withColumns({
        "coverage": F.col("accepted") / F.col("total"), "precision": F.when(F.col("accepted") > 0, F.col("correct") / F.col("accepted")),
        "precision_low": low, "precision_high": high, "unthresholded_accuracy": F.col("right") / F.col("total"),
    })
    return measured.withColumn("status", status).drop("right")


def width_probe(records: DataFrame, truth: DataFrame, topics: DataFrame, labels: dict[str, DataFrame], scorer: Scorer, limit: int = 12) -> DataFrame:
    """Accuracies of flat placement per level, over the first calibration records."""
    first = records.where("partition = 'calibration'").orderBy("work_id").limit(limit)
    out = None
    for level in ROUTE:
        rows = labelled(first.join(flat(first, labels[level], scorer, level), "work_id"), truth, topics, level)
        one = rows.agg(F.count(F.lit(1)).alias("evaluated"), F.avg(F.col("correct_primary").cast("double")).alias("primary_accuracy"), F.avg(F.col("correct_any_topic").cast("double")).alias("any_topic_accuracy")).withColumn("level", F.lit(level)).withColumn("option_count", F.lit(labels[level].count()).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def training_rows(records: DataFrame, truth: DataFrame, topics: DataFrame, taxonomy: DataFrame, text: Column, limit: int = 128, strategy: str = "hierarchical") -> DataFrame:
    """place, id, state and, per level, the options a record is asked about on its true
    path, with its label; the first ``limit`` training rows by SHA-256 of their id."""
    chosen = records.where("partition = 'train'").withColumns({"__digest": F.sha2("work_id", 256), "state": text})
    if limit:
        chosen = chosen.orderBy("__digest", "work_id").limit(limit)
    rows = chosen.join(truth.select("work_id", "primary_topic_id"), "work_id").join(topics, F.col("primary_topic_id") == F.col("topic_id"))
    for level in ROUTE if strategy == "hierarchical" else ("subfield",):
        above = PARENT.get(level) if strategy == "hierarchical" else None
        option = F.struct(F.col(level).alias("key"), F.col(f"{level}_name").alias("value"))
        of = taxonomy.groupBy(*([F.col(above).alias("__up")] if above else [])).agg(F.map_from_entries(F.array_sort(F.collect_set(option))).alias("criteria"))
        rows = rows.join(of, F.col(above) == F.col("__up")).drop("__up") if above else rows.crossJoin(F.broadcast(of))  # one row
        rows = rows.withColumn(f"q_{level}", F.struct("criteria", F.col(level).alias("label"))).drop("criteria")
    return rows.select(F.col("work_id").alias("id"), "state", *[c for c in rows.columns if c.startswith("q_")], "__digest").withColumnRenamed("__digest", "digest")
