"""The catalogue of queries: name -> function of (spark, folder of tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions import exact, stats, text
from taxolens.functions.stats import unit
from taxolens.operators import audit, cache, coverage, kmeans, partition, place, split, validate
from taxolens.operators.components import store
from taxolens.plans.fixtures import Fixture
from taxolens.plans.oracle import ORACLE
from taxolens.session import run_dir

QUERIES: dict = {}
TARGET, MINIMUM = 0.3, 10


def query(f):
    """Register a function of a Fixture under its own name."""

    def run(spark, folder: str) -> DataFrame:
        return f(Fixture(spark, folder))

    QUERIES[f.__name__] = run
    return f


def r(c, digits: int = 6):
    return F.round(c, digits).alias(c) if isinstance(c, str) else F.round(c, digits)


# ---- coverage ------------------------------------------------------------------------


@query
def coverage_by_year(x: Fixture) -> DataFrame:
    orders = x.t.orders.select(F.year("o_orderdate").cast("long").alias("publication_year"), "o_orderstatus")
    works = lambda where: coverage.counted(orders.where(where), "publication_year")
    return coverage.by_year(works("o_orderstatus = 'P'"), works("o_orderstatus <> 'O'"))


@query
def coverage_by_source(x: Fixture) -> DataFrame:
    events = x.t.events.select(F.col("event_type").alias("type"), F.col("user_id").alias("source_id"))
    return coverage.by_source(coverage.counted(events, "type", "source_id", into="unassigned_works"), 5)


# ---- taxonomy and validation -----------------------------------------------------------


@query
def topic_dims(x: Fixture) -> DataFrame:
    return validate.hierarchy(x.bare_topics()).withColumn("id", text.short_id("id")).withColumn("parent_id", text.short_id("parent_id"))


@query
def hierarchy_fd_violations(x: Fixture) -> DataFrame:
    # the market segment filed as a field: several segments to a nation
    mixed = x.bare_topics().join(x.t.customer.select(F.col("c_name").alias("topic"), "c_mktsegment"), "topic").withColumn("field_name", F.col("c_mktsegment")).withColumn("field_id", F.concat(F.lit("f/"), "c_mktsegment"))
    return validate.hierarchy_breaks(mixed)


@query
def topic_violations(x: Fixture) -> DataFrame:
    # every seventh topic without a name, every eleventh with a bad id
    n = text.short_id("topic_id").substr(2, 20).cast("long")
    bad = x.topics().withColumns({"topic": F.when(n % 7 == 0, " ").otherwise(F.col("topic")), "topic_id": F.when(n % 11 == 0, F.concat(F.lit("x"), "topic_id")).otherwise(F.col("topic_id"))})
    return validate.broken_topics(bad).groupBy("reason").agg(F.count(F.lit(1)).alias("topics"))


@query
def duplicate_topics(x: Fixture) -> DataFrame:
    return validate.repeated(x.bare_topics().unionByName(x.bare_topics().where("works_count > 15")).select("topic_id"), "topic_id").withColumnRenamed("count", "rows")


@query
def topic_csv_projection(x: Fixture) -> DataFrame:
    return coverage.topic_table(x.topics())


# ---- the audit -------------------------------------------------------------------------


@query
def keyword_memberships(x: Fixture) -> DataFrame:
    return audit.memberships(x.topics())


@query
def keyword_overlap(x: Fixture) -> DataFrame:
    return audit.overlaps(x.keyword_sets(), salted=False)


@query
def keyword_overlap_salted(x: Fixture) -> DataFrame:
    return audit.overlaps(x.keyword_sets())


@query
def keyword_overlap_counts(x: Fixture) -> DataFrame:
    """All lines of the orders: the large posting-list join."""
    return audit.overlap_counts(x.bare_topics(), x.keyword_sets())


@query
def jaccard_topk(x: Fixture) -> DataFrame:
    sets = x.keyword_sets()
    near = store(audit.neighbours(x.bare_topics(), sets=sets), "near")
    near = audit.shared_keywords(near, x.bare_topics(), sets)
    return near.select("src", "dst", "shared", F.col("all").alias("all_keywords"), r("similarity", 9), F.col("place").cast("long").alias("place"), F.array_join("shared_keywords", "; ").alias("shared_keywords"))


def _near(x: Fixture) -> tuple[DataFrame, DataFrame]:
    """Topics and their neighbours, stored."""
    topics = store(x.bare_topics(), "topics")
    return topics, store(audit.neighbours(topics, sets=x.keyword_sets()), "near")


@query
def parent_shares(x: Fixture) -> DataFrame:
    topics, near = _near(x)
    return audit.parent_shares(near, topics).select("level", "topic_id", "parent_id", r("share", 9), "count", "own", F.col("place").cast("long").alias("place"))


@query
def plurality_parent(x: Fixture) -> DataFrame:
    topics, near = _near(x)
    best = audit.plurality(audit.parent_shares(near, topics, "subfield"))
    return best.select("topic_id", "plurality_id", r("plurality_share", 9), "plurality_count", r("stated_share", 9))


def _assessed(x: Fixture, level: str) -> DataFrame:
    topics, near = _near(x)
    return audit.assess(topics, level=level, near=near)


def _audit(x: Fixture, level: str) -> DataFrame:
    # ranges are found by reading the rows once more, so they are stored
    return audit.rank(store(_assessed(x, level), "assessed")).withColumn("topic_id", text.short_id("topic_id")).withColumn("rank", F.col("rank").cast("long"))


@query
def audit_subfield(x: Fixture) -> DataFrame:
    return _audit(x, "subfield")


@query
def audit_field(x: Fixture) -> DataFrame:
    return _audit(x, "field")


@query
def audit_domain(x: Fixture) -> DataFrame:
    return _audit(x, "domain")


@query
def audit_summary(x: Fixture) -> DataFrame:
    return audit.summary(_assessed(x, "subfield"))


@query
def audit_top50(x: Fixture) -> DataFrame:
    return _audit(x, "subfield").where("rank <= 50").select("rank", "topic_id", "status", "score", "stated_id", "plurality_id")


# ---- samples, texts, families --------------------------------------------------------------


@query
def oversized_topics(x: Fixture) -> DataFrame:
    return partition.oversized(x.bare_topics(), 1.6).select("topic_id", "works_count", F.col("median_topic_works").cast("double").alias("median_topic_works"))


@query
def seeded_sample(x: Fixture) -> DataFrame:
    return partition.seeded_sample(x.t.orders.select(F.concat(F.lit("O"), "o_orderkey").alias("id"), "o_totalprice"), "id", 100)


@query
def sink_samples(x: Fixture) -> DataFrame:
    works = x.works.select("work_id", F.col("primary_topic_id").alias("sink_id"))
    return partition.sample_by(works, "sink_id", "work_id", 20)


@query
def feature_text(x: Fixture) -> DataFrame:
    return x.metadata.select("work_id", text.feature_text(F.col("title"), F.col("source"), F.col("type"), F.col("keywords")).alias("text"))


@query
def split_text(x: Fixture) -> DataFrame:
    return x.metadata.select("work_id", text.split_text(F.col("title"), F.col("keywords")).alias("text"))


@query
def insufficient_metadata(x: Fixture) -> DataFrame:
    return x.metadata.where(text.insufficient_metadata(F.col("title"), F.col("source"), F.col("keywords"))).select("work_id")


@query
def label_texts(x: Fixture) -> DataFrame:
    name = F.concat(F.lit("("), "p_brand", F.lit(") ["), "p_type", F.lit("], "), "p_name")
    return x.t.part.select("p_partkey", text.label_text(F.concat_ws(": ", F.col("p_partkey").cast("string"), name)).alias("label"))


@query
def title_key(x: Fixture) -> DataFrame:
    return x.t.part.select("p_partkey", text.title_key(F.concat_ws(" / ", "p_name", "p_type")).alias("title_key"))


@query
def family_components(x: Fixture) -> DataFrame:
    return partition.families(x.family_records)


@query
def hash_partition(x: Fixture) -> DataFrame:
    found = partition.assign_partitions(x.family_records)
    return found.select("id", "partition", "split_group")


@query
def partition_counts(x: Fixture) -> DataFrame:
    return coverage.partitions(x.works, "primary_topic_id")


@query
def partition_leakage(x: Fixture) -> DataFrame:
    # partitions by record instead of family: families leak
    own = x.family_records.withColumns({"partition": partition.partition_of(F.col("id")), "split_group": partition.split_group(F.col("id"))})
    return partition.leaks(own)


@query
def referential_misses(x: Fixture) -> DataFrame:
    return validate.unknown_topics(x.truth, x.taxonomy.where("topic_id <> 'T7'"))


@query
def foreign_sink_samples(x: Fixture) -> DataFrame:
    samples = x.works.select("work_id", "topic_ids", F.lit("T3").alias("sink_id"))
    return validate.foreign_samples(samples)


@query
def record_violations(x: Fixture) -> DataFrame:
    m = x.metadata.withColumn("n", F.substring("work_id", 2, 20).cast("long"))
    rows = m.select(F.when(F.col("n") % 13 == 0, " ").otherwise(F.col("work_id")).alias("id"), F.struct(F.when(F.col("n") % 17 != 0, F.col("title")).alias("title"), "source", "type", "keywords").alias("metadata"))
    return validate.broken_records(rows).groupBy("reason").agg(F.count(F.lit(1)).alias("records"))


# ---- placement ------------------------------------------------------------------------------


@query
def class_centroids(x: Fixture) -> DataFrame:
    train = x.works.where("partition = 'train'").select("primary_topic_id", "vector")
    sums = stats.vector_sums(train, ["primary_topic_id"], "vector")
    return sums.select("primary_topic_id", "n", F.posexplode(F.transform("s", lambda v: v / F.col("n"))).alias("pos", "mean")).select("primary_topic_id", "n", F.col("pos").cast("long").alias("pos"), r("mean"))


@query
def flat_predictions(x: Fixture) -> DataFrame:
    p = place.flat(x.works.where("partition <> 'train'").select("work_id"), x.labels("subfield"), x.scorer)
    return p.select("work_id", "prediction", r("confidence"), F.array_join(F.transform("candidates", lambda c: c.id), ",").alias("candidates"))


@query
def hierarchical_predictions(x: Fixture) -> DataFrame:
    p = place.hierarchical(x.works.where("partition <> 'train'").select("work_id"), x.taxonomy, x.scorer)
    return p.select("work_id", "prediction", r("confidence"), F.array_join(F.transform("route", lambda c: c.id), ">").alias("route"), F.array_join(F.transform("candidates", lambda c: c.id), ",").alias("candidates"))


@query
def labelled_predictions(x: Fixture) -> DataFrame:
    rows = x.predicted()
    return rows.select("work_id", "partition", "prediction", "true_primary", F.array_join("true_any_topic", ",").alias("true_any_topic"), "correct_primary", "correct_any_topic", "primary_in_top3_predictions")


@query
def threshold_curve(x: Fixture) -> DataFrame:
    rows = x.predicted().where("partition = 'calibration'").withColumn("confidence", F.round("confidence", 2))
    return stats.threshold_curve(rows, "correct_primary").select("threshold", "accepted", "correct", r("precision"), r("low"), r("high"))


@query
def fitted_threshold(x: Fixture) -> DataFrame:
    rows = store(x.predicted().where("partition = 'calibration'").withColumn("confidence", F.round("confidence", 2)), "predicted")
    out = None
    for reference in ("primary", "any_topic"):
        for target in (TARGET, 0.9):
            one = stats.fitted_threshold(rows, f"correct_{reference}", target, MINIMUM).withColumns({"reference": F.lit(reference), "target": F.lit(target)})
            out = one if out is None else out.unionByName(one)
    return out.select("reference", "target", "threshold", "accepted", "correct", r("precision"), r("precision_low"), r("precision_high"), r("coverage"))


@query
def selective_metrics(x: Fixture) -> DataFrame:
    rows = store(x.predicted().withColumn("confidence", F.round("confidence", 2)), "predicted")
    return place.evaluate(rows, TARGET, MINIMUM).select("reference", "threshold", "total", "accepted", "correct", r("coverage"), r("precision"), r("precision_low"), r("precision_high"), r("unthresholded_accuracy"), "status")


@query
def metrics_by_type(x: Fixture) -> DataFrame:
    rows = store(x.predicted().withColumn("confidence", F.round("confidence", 2)), "predicted")
    return place.evaluate(rows, TARGET, MINIMUM, ["type"]).select("reference", "type", "total", "accepted", "correct", r("coverage"), r("precision"))


@query
def metrics_by_level(x: Fixture) -> DataFrame:
    """Metrics overall and by type from one pass over the counts."""
    rows = x.predicted().withColumn("confidence", F.round("confidence", 2))
    return place.evaluate(rows, TARGET, MINIMUM, ["type"], overall=True).select("reference", "type", "whole", "total", "accepted", "correct", r("coverage"), r("precision"), r("unthresholded_accuracy"), "status")


@query
def exact_sums(x: Fixture) -> DataFrame:
    """Prices in cents among amounts that cancel out: the sum of doubles that loses none."""
    lines = x.t.lineitem.select("l_suppkey", F.round(F.col("l_extendedprice") * 100).alias("cents"), (F.col("l_orderkey") * F.pow(F.lit(2.0), F.lit(100.0))).alias("large"), F.pow(F.lit(2.0), -F.col("l_linenumber").cast("double")).alias("small"))
    values = lines.select("l_suppkey", F.explode(F.array(F.col("large"), F.col("cents"), F.col("small"), -F.col("large"))).alias("v"))
    return exact.exact_sums(values, ["l_suppkey"], "v", "total").select("l_suppkey", (F.col("total") * 128).cast("decimal(38,0)").cast("string").alias("parts"))


@query
def calibrated_status(x: Fixture) -> DataFrame:
    rows = x.predicted().withColumn("confidence", F.round("confidence", 2))
    cutoff = stats.fitted_threshold(rows.where("partition = 'calibration'"), "correct_any_topic", TARGET, MINIMUM).first()["threshold"]
    return place.apply_threshold(rows.where("partition = 'test'"), cutoff).groupBy("status").agg(F.count(F.lit(1)).alias("works"))


@query
def width_probe_accuracy(x: Fixture) -> DataFrame:
    rows = place.width_probe(x.works.select("work_id", "partition"), x.truth, x.taxonomy, {v: x.labels(v) for v in place.ROUTE}, x.scorer)
    return rows.select("level", "option_count", "evaluated", r("primary_accuracy"), r("any_topic_accuracy"))


@query
def training_export(x: Fixture) -> DataFrame:
    rows = place.training_rows(x.works.select("work_id", "partition", "type"), x.truth, x.taxonomy, x.taxonomy, F.concat(F.lit("Type: "), F.col("type")))
    flat = lambda v: F.concat_ws("|", F.array_join(F.transform(F.array_sort(F.map_entries(f"q_{v}.criteria")), lambda e: F.concat_ws("=", e.key, e.value)), ","), F.col(f"q_{v}.label")).alias(v)
    return rows.select("id", "state", "digest", *[flat(v) for v in place.ROUTE])


@query
def probability_contract(x: Fixture) -> DataFrame:
    asked = x.works.where("partition = 'test'").select("work_id").crossJoin(F.broadcast(x.labels("subfield").select("option_id")))
    p = place.probabilities(x.scorer.logits(asked, "subfield")).groupBy("work_id").agg(F.map_from_entries(F.collect_list(F.struct("option_id", "p"))).alias("p"))
    options = F.array(*[F.lit(str(i)) for i in range(10)])
    checked = p.select("work_id", stats.checked_probabilities(F.col("p"), options).alias("p"))
    return checked.select("work_id", F.size("p").cast("long").alias("options"), r(F.aggregate(F.map_values("p"), F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query
def cache_misses(x: Fixture) -> DataFrame:
    """Distinct texts without a cached answer, by the key of model, text and options."""
    key = F.sha2(F.concat_ws("\n", F.lit("centroid"), F.col("p_type"), F.col("p_brand")), 256)
    asked = x.t.part.select(key.alias("key"), "p_type", "p_brand").distinct()
    known = x.t.part.where("p_size <= 25").select(key.alias("key"), F.lit(0.0).alias("logit")).distinct()
    held = cache.Cache(x.spark, f"{run_dir(x.spark)}/cache-{uuid.uuid4().hex}", "key string, logit double", 8)
    for _ in range(2):  # an append that is run again changes nothing
        held.add(known)
    return held.missing(asked)


# ---- splitting ---------------------------------------------------------------------------------


@query
def tfidf_terms(x: Fixture) -> DataFrame:
    words = store(split.words_of(x.text_sinks, "text", split.STOP_WORDS, "sink"), "texts")
    return split.vocabulary(words).select("sink", "term", "df", "cf", r("idf"))


@query
def cluster_coherence(x: Fixture) -> DataFrame:
    return split.cluster_coherence(x.vector_sinks).select("sink", "cluster", "n", r("coherence"))


@query
def sink_coherence(x: Fixture) -> DataFrame:
    whole = split.cluster_coherence(x.vector_sinks.withColumn("cluster", F.lit("baseline"))).select("sink", F.col("coherence").alias("baseline"))
    return split.weighted_coherence(split.cluster_coherence(x.vector_sinks)).join(whole, "sink").select("sink", r("coherence"), r("baseline"))


@query
def cosine_silhouette(x: Fixture) -> DataFrame:
    return split.silhouette(x.vector_sinks).select("sink", r("silhouette"))


@query
def cluster_representatives(x: Fixture) -> DataFrame:
    return split.representatives(x.vector_sinks).select("cluster", "work_id", r("cosine"), F.col("place").cast("long").alias("place"))


@query
def cluster_top_terms(x: Fixture) -> DataFrame:
    weights = split.tfidf(x.text_sinks, "text", split.STOP_WORDS)
    return split.top_terms(weights, x.text_sinks.select("sink", "work_id", "cluster"), compare=6).select("sink", "cluster", F.col("place").cast("long").alias("place"), r("mean", 5))


def _sink_rows(x: Fixture) -> DataFrame:
    none = F.array()
    rows = x.t.embeddings.select(F.concat(F.lit("T"), "label").alias("sink"), F.concat(F.lit("W"), "vec_id").alias("work_id"), unit(F.col("embedding").cast("array<double>")).alias("vector"))
    sampled = partition.sample_by(rows, "sink", "work_id", 300)
    return sampled.select("sink", "work_id", F.lit(True).alias("has_text"), none.cast("array<string>").alias("terms"), none.cast("array<double>").alias("weights"), "vector")


@query
def kmeans_sweep(x: Fixture) -> DataFrame:
    return split.split_sinks(_sink_rows(x)).select("sink", F.explode("candidates").alias("c")).select("sink", "c.k", "c.status", F.array_join(F.transform("c.sizes", lambda s: s.cast("string")), ",").alias("sizes"), F.round("c.silhouette", 6).alias("silhouette"))


@query
def lloyd_step(x: Fixture) -> DataFrame:
    """Each work's nearest centre, where centres are the means of the labels."""
    rows = x.vector_sinks.withColumn("cluster", F.substring("cluster", 2, 9).cast("int"))
    features = F.transform("vector", lambda v, i: F.struct(i.cast("string").alias("f"), v.alias("x")))
    packed = kmeans.blocks(rows.select("sink", "work_id", features.alias("features")))
    runs = kmeans.from_labels(packed, rows.select("sink", F.lit(10).alias("k"), "work_id", "cluster"))
    return kmeans.labels(packed, runs).select("work_id", "cluster")


@query
def split_assignments(x: Fixture) -> DataFrame:
    return split.assignments(split.split_sinks(_sink_rows(x))).withColumn("cosine_to_centroid", F.round("cosine_to_centroid", 6))


@query
def split_text_sinks(x: Fixture) -> DataFrame:
    rows = split.tfidf_rows(partition.sample_by(x.text_sinks, "sink", "work_id", 300), "text", split.STOP_WORDS)
    return split.split_sinks(rows).select("sink", "sampled", "usable", "status", "reason", "chosen_k", F.round("silhouette", 6).alias("silhouette"))


# ---- review ------------------------------------------------------------------------------------


@query
def review_cover_check(x: Fixture) -> DataFrame:
    order = Window.orderBy(F.col("works_count").desc(), "topic_id")
    topics = x.bare_topics().select("topic_id", "works_count").orderBy(F.col("works_count").desc(), "topic_id").limit(60).withColumn("n", F.row_number().over(order))
    judgment = F.when(F.col("n") % 20 == 0, "unsure").when(F.col("n") % 3 == 0, "unresolved").otherwise("plausible_placement")
    notes = topics.where("n > 5").select("topic_id", judgment.alias("judgment"), F.when(F.col("n") % 25 == 0, "").otherwise("read").alias("reason"), F.lit("0").alias("input_sha256"))
    return validate.review_gaps(topics.where("n <= 50"), notes)


@query
def judgment_counts(x: Fixture) -> DataFrame:
    rows = x.t.customer.select(F.element_at(F.array(*[F.lit(j) for j in validate.JUDGMENTS]), (F.col("c_custkey") % 3 + 1).cast("int")).alias("judgment"))
    return coverage.counted(rows, "judgment", into="topics")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
