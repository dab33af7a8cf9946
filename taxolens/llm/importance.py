"""Target-distribution importance resampling over hashed word n-grams, in Spark SQL.

A text's features are its runs of one to ``MOST_WORDS`` consecutive words, joined by one
space; each falls into a bucket by the CRC-32 of its UTF-8 bytes. Bucket counts of the
corpus and of the target give every bucket a gain, a fixed-point log ratio; a document's
weight is the sum of its features' gains. Gumbel noise from a hash of the id makes the
highest scores a draw without replacement, in proportion to the importance.

One scan counts the buckets: features are exploded inside generated code and summed in the
task, so ``buckets`` rows a task are shuffled. A second scan joins features with the gains,
a table of at most ``buckets`` rows (a parameter, checked), which is broadcast, and sums
them by row before the shuffle. Ranks come from range partitions and their sizes.

Defined cases: null, empty and wordless texts have no features and weigh 0; a null id is
hashed as the empty text and comes last among ties; repeated rows are rows of their own
(those that are equal in all that counts stand in any order, with places of their own);
an empty target counts 0 everywhere; empty tables give empty results; words of any length
are whole; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep, quoted, unused
from taxolens.operators.ordering import places

# What separates words, and the default shape of the draw.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MOST_WORDS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: The gain table is broadcast; more buckets than this are an error.
MOST_BUCKETS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Where no other character has a lower case, that
    is what ``lower`` does, and much faster."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    return F.when(F.lower(other) == other, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _features(rows: DataFrame, keys: list[str], text: str, buckets: int) -> DataFrame:
    """keys, n_words and a ``bucket`` per feature; rows without words once, with null.

    The array of words stays beside each exploded position, in the same generated stage:
    longer runs are read from it without a window or a join."""
    words = rows.select(*keys, F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0)).alias("words"))
    at = words.select(*keys, "words", F.posexplode_outer("words").alias("at", "word"))
    runs = [F.col("word")]
    for n in range(1, MOST_WORDS):
        runs.append(F.concat(runs[-1], F.lit(" "), F.get("words", F.col("at") + n)))  # null past the end
    run = at.select(*keys, F.size("words").alias("n_words"), F.explode(F.array(*runs)).alias("run"))
    return run.select(*keys, "n_words", F.pmod(F.crc32(F.col("run").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features of all rows."""
    return _features(rows, [], text, buckets).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): 1000 times the log ratio of smoothed shares in two tables of
    ``bucket_counts``, rounded down, for each bucket of ``raw``."""
    total = lambda counts, name: counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias(name))
    both = raw.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    both = both.crossJoin(F.broadcast(total(raw, "all_s"))).crossJoin(F.broadcast(total(target, "all_t")))  # one row each
    s, t = F.col("s").cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def noise(ids: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """A row per document: ``key``, n_words, n_features, weight, score and ``row``, a
    number that tells rows apart. ``target`` has a column ``text``."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"the number of buckets must be 1-{MOST_BUCKETS}")
    table = keep(gains(keep(bucket_counts(docs, text, buckets), "raw-counts"), keep(bucket_counts(target, "text", buckets), "target-counts"), buckets), "gains")
    numbered = docs.select(F.col(quoted([key])[0]).alias("id"), F.col(quoted([text])[0]).alias("text"), F.monotonically_increasing_id().alias("row"))
    gained = _features(numbered, ["id", "row"], "text", buckets).join(F.broadcast(table), "bucket", "left")
    summed = gained.groupBy("row", "id").agg(F.max("n_words").cast("long").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    return summed.select(F.col("id").alias(key), F.greatest("n_words", F.lit(0)).alias("n_words"), "n_features", "weight", (F.col("weight") + noise(F.col("id"), seed)).alias("score"), "row")


def rank(weighed: DataFrame, key: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... by score and then by id, for the highest ``percent`` of
    documents with at least ``least_words`` words; null for all others."""
    rows = keep(weighed, "weighed")
    fit = F.col("n_words") >= least_words
    drawn = rows.agg(F.floor(F.count_if(fit) * percent / 100).cast("long").alias("n")).first()["n"]
    ids = F.col(quoted([key])[0])
    order = [fit.desc(), F.col("score").desc(), ids.isNull(), ids, F.col("row")]
    placed = places(rows.withColumn("fit", fit), [F.col("fit").desc(), *order[1:]], into="place")
    return placed.withColumn("rank", F.when(F.col("fit") & (F.col("place") <= drawn), F.col("place")).cast("long")).drop("fit", "place")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, drawn by id: rows that share an
    id with a drawn one come too."""
    ranked = rank(weigh(docs, target, key, text, seed), key, percent=percent).where("rank is not null")
    own = unused(docs.columns, "drawn")
    drawn = ranked.select(F.col(quoted([key])[0]).alias(own)).distinct()
    return docs.join(drawn, docs[quoted([key])[0]].eqNullSafe(drawn[own]), "left_semi")
