"""Splitting oversized topics: TF-IDF, cluster measures, k-means sweep, assignments.

Features, coherence, silhouette, terms and representatives are DataFrame expressions
over any number of rows. A split goes through stages, each a DataFrame: which sinks can be
split, labels for every number of clusters, their sizes and silhouettes, the choice, the
numbers of clusters, and what becomes of each work. Labels come from steps of grouped sums
over all sinks and numbers of clusters at once (``kmeans``), whatever a sink's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.functions.stats import coherence, dot, unit, vector_sums
from taxolens.operators import kmeans
from taxolens.operators.components import store
from taxolens.operators.ordering import few, places
from taxolens.session import ship

# Limits of the vocabulary, of terms, representatives and starts; the names
# of statuses, reasons and actions.
MIN_DF, MAX_DF, MAX_FEATURES = 2, 0.95, 10_000
TOP_TERMS, REPRESENTATIVES = 8, 5
INSUFFICIENT, PROPOSED, UNSUPPORTED = "insufficient_evidence", "proposed_split", "no_supported_split"
FEW_TEXTS, FEW_VECTORS, NO_WORDS = "fewer_than_two_minimum_clusters", "fewer_than_two_minimum_clusters_after_vectorisation", "no_shared_vocabulary"
NO_CANDIDATE, NOT_POSITIVE = "no_candidate_meets_minimum_cluster_size", "no_positive_silhouette"
REJECTED, EVALUATED = "rejected_small_or_empty_cluster", "evaluated"
NO_TEXT, NO_PARTITION = "insufficient_text", "no_supported_partition"
SPLIT, RETAIN, UNASSIGNED = "propose_split", "retain_original", "unassigned"
#: Decimals at which silhouettes, means and cosines are compared.
COMPARE = 12


# Words without a subject, of this engine's own choice.
STOP_WORDS = (
    "about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does "
    "doing down during each either else ever every few for from further had has have having he her here hers him his how however if in into is it its "
    "itself just less like many may me might more most much must my neither no nor not now of off often on once one only or other our out over own per "
    "same shall she should since so some still such than that the their them then there these they this those though through thus to too under until up "
    "upon us very was we were what when where whether which while who whom whose why will with within without would yet you your"
).split()


def words_of(docs: DataFrame, text: str, stop: list[str], *keep: str) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``w``: words of two and more word characters, without
    stop words. A run of word characters is matched whole and looked up afterwards."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return docs.select(*keep, (F.filter(runs, lambda w: ~w.isin(stop)) if stop else runs).alias("w"))


def pairs(make) -> Column:
    """``make(a, b)`` of each two neighbours in ``w``."""
    return F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, i: make(a, F.get("w", i + 1)))


def _pair(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(" "), b)


def _each(words: DataFrame, terms: Column, *keep: str) -> DataFrame:
    """A row per term; the outer form keeps the optimizer from making ``terms`` twice, for
    a filter on their number."""
    return words.select(*keep, F.explode_outer(terms).alias("term")).where("term is not null")


def vocabulary(words: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF, most: int = MAX_FEATURES) -> DataFrame:
    """(sink, term, df, cf, idf): of stored ``words`` (sink, w; ``words_of``), words and pairs of
    them in at least ``min_df`` documents and at most a share ``max_df`` of them, the ``most``
    frequent of a sink (ties by term); smoothed idf.

    Words are counted first. Where they alone fill a sink's vocabulary, a pair must be as
    frequent as the last of them, and so must both its words: only such pairs are counted,
    and documents only of pairs that are frequent enough. Likewise only terms from the cf of
    the last one on are put in order."""
    n = store(words.groupBy("sink").agg(F.count(F.lit(1)).alias("n")), "sinks")
    lists = F.array(F.struct(F.col("w").alias("terms"), F.lit(0).alias("d")), F.struct(F.array_distinct("w").alias("terms"), F.lit(1).alias("d")))
    each = words.select("sink", F.explode(lists).alias("x")).select("sink", "x.d", F.explode_outer("x.terms").alias("term")).where("term is not null")
    single = store(each.groupBy("sink", "term").agg(F.sum(F.col("d").cast("long")).alias("df"), F.sum((1 - F.col("d")).cast("long")).alias("cf")).where(F.col("cf") >= min_df), "single")

    def known(totals: DataFrame) -> DataFrame:
        fit = (F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n"))
        return totals.join(few(n), "sink").where(fit)

    def last(terms: DataFrame) -> DataFrame:
        """(sink, least, above): the cf of the ``most``-th term, or the lowest; terms above it and with it."""
        own = Window.partitionBy("sink").orderBy(F.col("cf").desc())
        counts = terms.groupBy("sink", "cf").agg(F.count(F.lit(1)).alias("m")).withColumn("upto", F.sum("m").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        return counts.where(F.col("upto") - F.col("m") < most).groupBy("sink").agg(F.min("cf").alias("least"), F.max("upto").alias("upto"))

    full = last(known(single)).where(F.col("upto") >= most).select("sink", "least")
    bounds = few(store(n.select("sink").join(full, "sink", "left").select("sink", F.greatest(F.coalesce("least", F.lit(0)), F.lit(min_df)).alias("least")), "bounds"))
    frequent = few(store(single.join(bounds, "sink").where(F.col("cf") >= F.col("least")).select("sink", "term"), "frequent"))
    two = words.select("sink", F.explode_outer(pairs(lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("x")).select("sink", "x.a", "x.b").where("a is not null")
    for c in ("a", "b"):
        two = two.join(frequent.withColumnRenamed("term", c), ["sink", c])
    often = two.groupBy("sink", "a", "b").agg(F.count(F.lit(1)).alias("cf")).join(bounds, "sink").where(F.col("cf") >= F.col("least"))
    often = store(often.select("sink", _pair(F.col("a"), F.col("b")).alias("term"), "cf"), "often")
    found = _each(words, F.array_distinct(pairs(_pair)), "sink").join(few(often), ["sink", "term"])
    double = found.groupBy("sink", "term").agg(F.count(F.lit(1)).alias("df"), F.first("cf").alias("cf"))
    terms = store(known(single.unionByName(double)), "terms")
    cuts = store(last(terms).select("sink", "least"), "cuts")
    idf = F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1
    ordered = places(terms.join(few(cuts), "sink").where(F.col("cf") >= F.col("least")), [F.col("cf").desc(), F.col("term")], ["sink"])
    return ordered.where(F.col("place") <= most).select("sink", "term", "df", "cf", idf.alias("idf"))


def tfidf(docs: DataFrame, text: str, stop: list[str], **limits) -> DataFrame:
    """(sink, work_id, term, weight): sublinear tf times idf, rows of length 1.

    Words are dealt by work once; terms of the vocabulary are looked up where they are
    found, so a work's terms are counted and its length is taken without another shuffle."""
    words = store(words_of(docs, text, stop, "sink", "work_id"), "texts")
    known = store(vocabulary(words.select("sink", "w"), **limits).select("sink", "term", "idf"), "known")
    found = _each(words.repartition("work_id", "sink"), F.concat("w", pairs(_pair)), "sink", "work_id").join(few(known), ["sink", "term"])
    raw = found.groupBy("work_id", "sink", "term", "idf").agg(F.count(F.lit(1)).alias("tf")).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    # work before sink: a sort compares the first bytes of its first column at once
    size = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("work_id", "sink")))
    return raw.select("sink", "work_id", "term", (F.col("w") / size).alias("weight"))


def cluster_coherence(rows: DataFrame) -> DataFrame:
    """(sink, cluster, n, coherence) of unit vectors ``sink, cluster, vector``."""
    return vector_sums(rows, ["sink", "cluster"], "vector").select("sink", "cluster", "n", coherence(F.col("n"), F.col("s")).alias("coherence"))


def weighted_coherence(clusters: DataFrame) -> DataFrame:
    """(sink, coherence): the mean over clusters, by their numbers of ordered pairs."""
    pairs = (F.col("n") * (F.col("n") - 1)).cast("double")
    return clusters.groupBy("sink").agg((F.sum(F.col("coherence") * pairs) / F.nullif(F.sum(pairs), F.lit(0.0))).alias("coherence"))


def silhouette(rows: DataFrame) -> DataFrame:
    """(sink, silhouette): the cosine silhouette of unit vectors ``sink, work_id,
    cluster, vector`` from cluster sums, O(rows x clusters) instead of all pairs."""
    sums = vector_sums(rows, ["sink", "cluster"], "vector")
    to = sums.select("sink", F.col("cluster").alias("to"), "n", "s")
    far = rows.join(to, "sink").withColumn("d", dot(F.col("vector"), F.col("s")))
    own = F.col("to") == F.col("cluster")
    per = far.groupBy("sink", "work_id", "cluster").agg(
        F.max(F.when(own, F.when(F.col("n") > 1, 1 - (F.col("d") - 1) / (F.col("n") - 1)))).alias("a"), F.min(F.when(~own, 1 - F.col("d") / F.col("n"))).alias("b")
    )
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.greatest("a", "b") > 0, (F.col("b") - F.col("a")) / F.greatest("a", "b")).otherwise(0.0)
    return per.select("sink", score.alias("s")).groupBy("sink").agg(F.avg("s").alias("silhouette"))


def centroid_cosines(rows: DataFrame) -> DataFrame:
    """(sink, cluster, work_id, cosine) to the cluster's normalised mean."""
    centre = vector_sums(rows, ["sink", "cluster"], "vector").select("sink", "cluster", unit(F.col("s")).alias("centre"))
    return rows.join(centre, ["sink", "cluster"]).select("sink", "cluster", "work_id", dot(F.col("vector"), F.col("centre")).alias("cosine"))


def representatives(rows: DataFrame, most: int = REPRESENTATIVES, compare: int = 9) -> DataFrame:
    """(sink, cluster, work_id, cosine, place): the works closest to each centre."""
    order = Window.partitionBy("sink", "cluster").orderBy(F.round("cosine", compare).desc(), "work_id")
    return centroid_cosines(rows).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def top_terms(weights: DataFrame, clusters: DataFrame, most: int = TOP_TERMS, compare: int = 9) -> DataFrame:
    """(sink, cluster, term, mean, place): terms of highest mean weight in a cluster.
    ``weights``: sink, work_id, term, weight; ``clusters``: sink, work_id, cluster."""
    n = clusters.groupBy("sink", "cluster").agg(F.count(F.lit(1)).alias("n"))
    mean = weights.join(clusters, ["work_id", "sink"]).groupBy("sink", "cluster", "term").agg(F.sum("weight").alias("total")).join(n, ["sink", "cluster"]).select("sink", "cluster", "term", (F.col("total") / F.col("n")).alias("mean"))
    order = Window.partitionBy("sink", "cluster").orderBy(F.round("mean", compare).desc(), "term")
    return mean.where("mean > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


# ---- measures of long rows: sink, k, cluster, work_id, f (a feature), x (its value) ------

CLUSTER = ["sink", "k", "cluster"]


def _sums(rows: DataFrame) -> DataFrame:
    """(sink, k, cluster, f, s): sums of features."""
    return rows.groupBy(*CLUSTER, "f").agg(F.sum("x").alias("s"))


def _counts(members: DataFrame) -> DataFrame:
    return members.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("n"), F.min("work_id").alias("first"))


def _coherences(sums: DataFrame, counts: DataFrame) -> DataFrame:
    """(sink, k, cluster, n, coherence, size): ``size`` is the length of the sum."""
    length = sums.groupBy(*CLUSTER).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    mean = F.when(F.col("n") > 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("square") - F.col("n")) / (F.col("n") * (F.col("n") - 1)))))
    return counts.join(length, CLUSTER).select(*CLUSTER, "n", mean.alias("coherence"), F.sqrt("square").alias("size"))


def _silhouettes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(sink, k, silhouette) of unit vectors, from cluster sums: the distance of a work to
    a cluster's works is one less its product with their sum, over their number."""
    counts = _counts(members)
    to = _sums(rows).withColumnRenamed("cluster", "to")
    touched = rows.join(to, ["sink", "k", "f"]).groupBy("sink", "k", "work_id", "to").agg(F.sum(F.col("x") * F.col("s")).alias("d"))
    every = members.join(counts.select("sink", "k", F.col("cluster").alias("to"), "n"), ["sink", "k"]).join(touched, ["sink", "k", "work_id", "to"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
    own = F.col("to") == F.col("cluster")
    per = every.groupBy("sink", "k", "work_id").agg(
        F.max(F.when(own & (F.col("n") > 1), 1 - (F.col("d") - 1) / (F.col("n") - 1))).alias("a"), F.min(F.when(~own, 1 - F.col("d") / F.col("n"))).alias("b")
    )
    top = F.greatest("a", "b")
    value = F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (top > 0), (F.col("b") - F.col("a")) / top).otherwise(0.0)
    return per.groupBy("sink", "k").agg(F.avg(value).alias("silhouette"))


# ---- the stages of a split ---------------------------------------------------------------


def gates(works: DataFrame, least: int) -> DataFrame:
    """A row per sink: sampled, usable, open (can it be clustered), vectorised, reason."""
    counts = works.groupBy("sink").agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if("has_text").alias("texts"), F.count_if(F.col("has_text") & (F.size("features") > 0)).alias("with_features"), F.max("known").alias("known")
    )
    reason = F.when(F.col("texts") < 2 * least, FEW_TEXTS).when(~F.col("known"), NO_WORDS).when(F.col("with_features") < 2 * least, FEW_VECTORS)
    vectorised = (F.col("texts") >= 2 * least) & F.col("known")
    return counts.select("sink", "sampled", F.when(vectorised, F.col("with_features")).otherwise(0).alias("usable"), reason.isNull().alias("open"), vectorised.alias("vectorised"), reason.alias("gate"))


def sweep(works: DataFrame, open_: DataFrame, seed: int, most: int, least: int) -> DataFrame:
    """(sink, k, work_id, cluster): labels for every number of clusters that ``least``
    works each allow, all sinks at once. ``works`` are usable ones with ``features``."""
    ks = F.sequence(F.lit(2), F.least(F.lit(most), F.floor(F.col("usable") / least).cast("int")))
    asked = store(open_.select("sink", ks.alias("ks")), "asked")
    return kmeans.fit(works.join(asked.select("sink"), "sink", "left_semi").select("sink", "work_id", "features"), asked, seed)


def candidates(labels: DataFrame, features: DataFrame, least: int) -> DataFrame:
    """(sink, k, status, sizes, silhouette): silhouettes where no cluster is too small."""
    n = F.array_sort(F.collect_list(F.col("n").cast("int")))
    sizes = _counts(labels).groupBy("sink", "k").agg(n.alias("sizes")).withColumn("sizes", F.concat(F.array_repeat(F.lit(0), F.col("k") - F.size("sizes")), "sizes"))
    sizes = store(sizes.withColumn("status", F.when(F.col("sizes")[0] < least, REJECTED).otherwise(EVALUATED)), "sizes")
    good = labels.join(sizes.where(F.col("status") == EVALUATED).select("sink", "k"), ["sink", "k"])
    value = _silhouettes(good.join(features, ["sink", "work_id"]), good)
    return sizes.join(value, ["sink", "k"], "left").select("sink", "k", "status", "sizes", "silhouette")


def choose(found: DataFrame) -> DataFrame:
    """(sink, k, silhouette, good): the number of clusters of the highest silhouette, the
    least such number; ``good`` if that is above 0."""
    best = F.max(F.struct(F.round("silhouette", COMPARE).alias("v"), (-F.col("k")).alias("least"), F.col("silhouette")))
    return found.where(F.col("silhouette").isNotNull()).groupBy("sink").agg(best.alias("b")).select("sink", (-F.col("b.least")).alias("k"), "b.silhouette", (F.col("b.silhouette") > 0).alias("good"))


def describe(members: DataFrame, features: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of chosen clusters: (sink, cluster, cluster_id, size, keywords, coherence,
    representatives) and, for each work, (sink, work_id, cluster_id, cosine). Clusters are
    numbered by their keywords, then by their first work."""
    counts = _counts(members)
    sums = store(_sums(members.join(features, ["sink", "work_id"])), "sums")
    about = _coherences(sums, counts)
    by_mean = Window.partitionBy(*CLUSTER).orderBy(F.round("mean", COMPARE).desc(), "f")
    mean = _sums(members.join(words, ["sink", "work_id"])).join(counts, CLUSTER).select(*CLUSTER, "f", (F.col("s") / F.col("n")).alias("mean")).where("mean > 0")
    top = mean.withColumn("place", F.row_number().over(by_mean)).where(F.col("place") <= TOP_TERMS).groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(F.struct("place", "f"))).alias("t"))
    named = about.join(counts.select(*CLUSTER, "first"), CLUSTER).join(top.select(*CLUSTER, F.col("t.f").alias("keywords")), CLUSTER, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    number = F.row_number().over(Window.partitionBy("sink").orderBy("keywords", "first"))
    named = named.withColumn("cluster_id", F.concat("sink", F.lit(".C"), F.lpad(number.cast("string"), F.greatest(F.lit(2), F.length(number.cast("string"))), F.lit("0"))))
    product = members.join(features, ["sink", "work_id"]).join(sums, [*CLUSTER, "f"]).groupBy(*CLUSTER, "work_id").agg(F.sum(F.col("x") * F.col("s")).alias("d"))
    near = product.join(named.select(*CLUSTER, "cluster_id", "size"), CLUSTER).select(*CLUSTER, "cluster_id", "work_id", F.when(F.col("size") > 0, F.col("d") / F.col("size")).otherwise(0.0).alias("cosine"))
    near = store(near, "near")
    closest = Window.partitionBy(*CLUSTER).orderBy(F.round("cosine", COMPARE).desc(), "work_id")
    first = near.withColumn("place", F.row_number().over(closest)).where(F.col("place") <= REPRESENTATIVES).groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(F.struct("place", "work_id"))).alias("r"))
    clusters = named.join(first, CLUSTER).select("sink", "cluster_id", F.col("n").cast("int").alias("size"), "keywords", "coherence", F.col("r.work_id").alias("representatives"))
    return clusters, near.select("sink", "work_id", "cluster_id", "cosine")


def split_sinks(rows: DataFrame, seed: int = 42, max_clusters: int = 8, minimum_cluster: int = 5) -> DataFrame:
    """One row per sink: sampled, usable, status, reason, chosen_k, silhouette, coherence,
    baseline_coherence, candidates, clusters and assignments. ``rows``: sink, work_id,
    has_text boolean, terms array<string>, weights array<double>, vector array<double>
    (null for TF-IDF; where a sink has vectors, they are clustered and terms only name)."""
    if not 2 <= max_clusters <= 20 or minimum_cluster < 2:
        raise ValueError("max-clusters must be 2-20 and minimum-cluster at least 2")
    ship(rows.sparkSession)
    least = minimum_cluster
    given = F.max(F.col("has_text") & F.col("vector").isNotNull()).over(Window.partitionBy("sink"))
    any_term = F.max(F.col("has_text") & (F.size("terms") > 0)).over(Window.partitionBy("sink"))
    pair = lambda f, x: F.struct(f.cast("string").alias("f"), x.cast("double").alias("x"))
    dense = F.transform(F.coalesce("vector", F.array().cast("array<double>")), lambda x, i: pair(i, x))
    words = F.transform(F.arrays_zip("terms", "weights"), lambda z: pair(z.terms, z.weights))
    works = store(
        rows.withColumns({"given": given, "any": any_term})
        .select("sink", "work_id", "has_text", (F.col("given") | F.col("any")).alias("known"), words.alias("words"), F.filter(F.when(F.col("given"), dense).otherwise(words), lambda e: e.x != 0).alias("features")),
        "works",
    )
    sinks = store(gates(works, least), "gates")
    usable = works.where("has_text and size(features) > 0").join(sinks.where("vectorised").select("sink", "usable"), "sink")
    features = store(usable.select("sink", "work_id", F.inline("features")), "features")
    naming = store(usable.select("sink", "work_id", F.inline("words")).where("x <> 0"), "words")
    labels = store(sweep(usable, sinks.where("open"), seed, max_clusters, least), "labels")
    tried = store(candidates(labels, features, least), "candidates")
    best = store(choose(tried), "best")
    one = usable.join(best.where("not good"), "sink").select("sink", F.lit(1).alias("k"), "work_id", F.lit(0).alias("cluster"))
    members = store(labels.join(best.where("good").select("sink", "k"), ["sink", "k"]).select("sink", "k", "work_id", "cluster").unionByName(one), "members")
    clusters, near = describe(members, features, naming)
    clusters = store(clusters, "clusters")
    alone = usable.select("sink", F.lit(0).alias("k"), "work_id", F.lit(0).alias("cluster"))
    baseline = _coherences(_sums(alone.join(features, ["sink", "work_id"])), _counts(alone)).select("sink", F.col("coherence").alias("baseline_coherence"))
    weighted = weighted_coherence(clusters.select("sink", F.col("size").alias("n"), F.coalesce("coherence", F.lit(0.0)).alias("coherence")))
    placed = works.join(sinks, "sink").join(best.select("sink", "good"), "sink", "left").join(near, ["sink", "work_id"], "left")
    why = F.when(F.col("cluster_id").isNotNull(), F.lit(None)).when(~F.col("vectorised") | ~F.col("has_text"), NO_TEXT).when(F.size("features") > 0, NO_PARTITION).otherwise(NO_WORDS)
    action = F.when(F.col("cluster_id").isNull(), UNASSIGNED).when(F.col("good"), SPLIT).otherwise(RETAIN)
    each = F.struct("work_id", "cluster_id", action.alias("action"), why.alias("reason"), F.col("cosine").alias("cosine_to_centroid"))
    listed = lambda df, item, into: df.groupBy("sink").agg(F.array_sort(F.collect_list(item)).alias(into))
    out = sinks.join(best, "sink", "left").join(baseline, "sink", "left").join(weighted, "sink", "left")
    out = out.join(listed(tried, F.struct("k", "status", "sizes", "silhouette"), "candidates"), "sink", "left")
    out = out.join(listed(clusters, F.struct("cluster_id", "size", "keywords", "coherence", "representatives"), "clusters"), "sink", "left")
    out = out.join(listed(placed, each, "assignments"), "sink")
    status = F.when(F.col("good").isNull(), INSUFFICIENT).when(F.col("good"), PROPOSED).otherwise(UNSUPPORTED)
    reason = F.when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("good").isNull(), NO_CANDIDATE).when(~F.col("good"), NOT_POSITIVE)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        "sink", "sampled", "usable", status.alias("status"), reason.alias("reason"), F.when(F.col("good"), F.col("k")).when(~F.col("good"), 1).cast("int").alias("chosen_k"), "silhouette", "coherence", "baseline_coherence",
        empty("candidates", "array<struct<k:int,status:string,sizes:array<int>,silhouette:double>>"), empty("clusters", "array<struct<cluster_id:string,size:int,keywords:array<string>,coherence:double,representatives:array<string>>>"), "assignments",
    )


def tfidf_rows(docs: DataFrame, text: str, stop: list[str], **limits) -> DataFrame:
    """Input of ``split_sinks`` from texts: (sink, work_id) with a row per document."""
    weights = tfidf(docs, text, stop, **limits).groupBy("sink", "work_id").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    none = F.array()
    return docs.join(weights, ["sink", "work_id"], "left").select(
        "sink", "work_id", (F.length(F.trim(text)) > 0).alias("has_text"), F.coalesce(F.col("t.term"), none.cast("array<string>")).alias("terms"), F.coalesce(F.col("t.weight"), none.cast("array<double>")).alias("weights"), F.lit(None).cast("array<double>").alias("vector")
    )


def assignments(result: DataFrame) -> DataFrame:
    """All assignments as flat rows."""
    return result.select("sink", F.explode("assignments").alias("a")).select(F.col("a.work_id").alias("work_id"), F.col("sink").alias("original_topic_id"), "a.cluster_id", "a.action", "a.reason", "a.cosine_to_centroid")
