"""Quality rules: plain text measures and a calibrated n-gram classifier.

Method: logistic regression over hashed word uni- and bigrams and hashed character
4-grams (relative frequencies of code points' n-grams), trained on labelled rows by
Spark ML's distributed solver, Platt-calibrated on rows that the training left out,
scored in Arrow batches against fixed thresholds.

The classifier is fitted on a bounded sample: at most ``FIT_ROWS_PER_CLASS`` labelled
rows of each class, one text an id. Measures and scores cover all documents.

Defined cases: a null text is an empty one (no words, base_failed); repeated rows are
judged each for itself, and give the sample one text (the greatest) an id; ties at a
threshold are kept (score) or pass (repeats); a very long text is measured and scored in
pieces; without labelled rows of both classes there is no model and only the base rule
rejects; the struct takes the name given by ``into`` and replaces a column of that name,
all other columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from taxolens.llm.common import fresh_path, mix64, only, quoted, release, small_batches, unused, utf8
from taxolens.llm.hashing import SPACE, hashed_words

#: Buckets for words and for character n-grams, each.
BITS = 15
#: The classifier is fitted on at most so many labelled rows of each class.
FIT_ROWS_PER_CLASS = 3000
#: Relative frequencies times this are the features; the penalty on their weights.
SCALE, PENALTY, ROUNDS = 100.0, 1e-4, 60
#: Reject below this calibrated probability of quality 1.
REJECT_BELOW = 0.15
#: Characters of a text whose n-grams are hashed at once.
CHUNK = 1 << 20
RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality_score double, base_failed boolean, kept boolean"

_SHIFT = np.uint64(64 - BITS)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
_C = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]
#: Bytes that begin a character of a word, and bytes of ``[#*$%&|<>]``.
BEGINS = ~SPACE & ((np.arange(256) & 0xC0) != 0x80)
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def repeated(hashes: np.ndarray) -> int:
    """Words in 5-word windows that are found twice or more, by the words' hashes."""
    n = hashes.size - 4
    if n < 2:
        return 0
    with np.errstate(over="ignore"):
        window = hashes[:n] * _M[0]
        for k in range(1, 5):
            window += hashes[k : k + n] * _M[k]
    window = mix64(window)
    order = np.sort(window)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    at = np.flatnonzero(np.isin(window, order[1:][same]))
    edge = np.zeros(hashes.size + 1, np.int64)
    edge[at] += 1
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measures(texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    for text, hashes in zip(texts, hashed_words(texts, lower=False)):
        a = np.frombuffer(text, np.uint8)
        lines = [x for x in text.split(b"\n") if x.strip()]
        yield hashes.size, int(np.count_nonzero(BEGINS[a])), int(np.count_nonzero(SYMBOL[a])), len(lines) - len(set(lines)), repeated(hashes)


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of uni- and bigrams, in 0 .. 2**BITS - 1."""
    with np.errstate(over="ignore"):
        pairs = mix64(hashes[:-1] * _M[0] + hashes[1:] * _M[1])
    return np.concatenate([hashes >> _SHIFT, pairs >> _SHIFT]).astype(np.int64)


def char_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all 4-grams of code points, in pieces of bounded size."""
    said = text.decode("utf-8", "replace")
    for at in range(0, max(1, len(said) - 3), CHUNK):
        c = np.frombuffer(said[at : at + CHUNK + 3].encode("utf-32-le", "replace"), np.uint32)
        if c.size > 3:
            with np.errstate(over="ignore"):
                grams = c[:-3] * _C[0] + c[1:-2] * _C[1] + c[2:-1] * _C[2] + c[3:] * _C[3]
                grams ^= grams >> np.uint32(15)
                grams *= _C[0]
            yield (grams >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class QualityModel:
    """Weights of words, weights of character n-grams, bias and Platt's two numbers."""

    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, text: bytes, hashes: np.ndarray) -> float:
        raw = self.bias
        if hashes.size:
            raw += SCALE * float(self.words.take(word_buckets(hashes)).mean(dtype=np.float64))
        total = n = 0
        for b in char_buckets(text):
            total += float(self.grams.take(b).sum(dtype=np.float64))
            n += b.size
        raw += SCALE * total / n if n else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30))))


def _features(text: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text that aren't zero: their numbers and values."""
    words = np.bincount(word_buckets(hashes), minlength=1 << BITS) if hashes.size else np.zeros(1 << BITS)
    grams = np.zeros(1 << BITS)
    for b in char_buckets(text):
        grams += np.bincount(b, minlength=1 << BITS)
    both = np.concatenate([words / max(1, words.sum()), grams / max(1, grams.sum())])
    at = np.flatnonzero(both)
    return at.astype(np.int32), SCALE * both[at]


def class_sample(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """Labelled ids, at most ``per_class`` of each class, by a hash of the id."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    order = F.xxhash64(F.col("doc_id"), F.lit(20))
    return one.where("label = 0").orderBy(order, "doc_id").limit(per_class).unionByName(one.where("label = 1").orderBy(order, "doc_id").limit(per_class))


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text): one text, the greatest, of each id of a bounded sample."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.max("text").alias("text"))


def _extract(batches):
    only("quality")
    for batch in batches:
        texts = utf8(batch.column("text"))
        found = [_features(t, h) for t, h in zip(texts, hashed_words(texts))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float64()))],
            ["doc_id", "label", "at", "value"],
        )
    release()


def _as_vectors(rows: DataFrame) -> DataFrame:
    """(doc_id, label, features), kept: features are written as the struct that vectors are
    in Parquet and read as vectors, so no worker loads Spark ML to make them."""
    from pyspark.ml.linalg import VectorUDT

    struct = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(2 << BITS).alias("size"), F.col("at").alias("indices"), F.col("value").alias("values"))
    path = fresh_path(rows.sparkSession, "features")
    rows.select("doc_id", "label", struct.alias("features")).write.parquet(path)
    schema = StructType([StructField("doc_id", LongType()), StructField("label", IntegerType()), StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def _weighed(rows: DataFrame, share: dict[int, float]) -> DataFrame:
    """``rows`` with a weight ``w``, so that each class has its share of all weight."""
    count = dict(rows.groupBy("label").count().collect())
    n = sum(count.values())
    return rows.withColumn("w", F.when(F.col("label") == 1, share[1] * n / count.get(1, 1)).otherwise(share[0] * n / count.get(0, 1)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = FIT_ROWS_PER_CLASS, rounds: int = ROUNDS) -> QualityModel | None:
    """Fit and calibrate on a bounded sample of labelled rows; None without both
    classes. Features stay on the executors; the driver gets weights and sums."""
    from pyspark.ml.classification import LogisticRegression  # here, so that workers do without
    from pyspark.ml.functions import array_to_vector, vector_to_array

    small_batches(docs.sparkSession)
    sample = class_sample(labels, label, per_class)
    rows = _as_vectors(sampled_texts(docs, sample).mapInArrow(_extract, "doc_id long, label int, at array<int>, value array<double>"))
    left = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(5)) == 0  # for calibration
    classes = {(r.left, r.label) for r in rows.select(left.alias("left"), "label").distinct().collect()}
    if len({y for _, y in classes}) < 2:
        return None
    for_fit = ~left if {(False, 0), (False, 1)} <= classes else F.lit(True)
    for_scale = left if {(True, 0), (True, 1)} <= classes else F.lit(True)
    fit = _weighed(rows.where(for_fit), {0: 0.5, 1: 0.5})
    found = LogisticRegression(weightCol="w", maxIter=rounds, regParam=PENALTY, standardization=False).fit(fit)
    known = labels.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()
    all_ = sum(r["count"] for r in known)
    margin = vector_to_array("rawPrediction")[1]
    held = found.transform(rows.where(for_scale)).select("label", array_to_vector(F.array(margin)).alias("features"))
    platt = LogisticRegression(weightCol="w", maxIter=50, regParam=1e-3, standardization=False).fit(_weighed(held, {int(r[label]): r["count"] / all_ for r in known}))
    weights = found.coefficients.toArray()
    return QualityModel(weights[: 1 << BITS].astype(np.float32), weights[1 << BITS :].astype(np.float32), float(found.intercept), max(0.05, float(platt.coefficients[0])), float(platt.intercept))


def judge(model: QualityModel | None, reject_below: float = REJECT_BELOW):
    """An Arrow UDF from a text column to the struct of RESULT."""

    @F.arrow_udf(RESULT)
    def quality(column: pa.Array) -> pa.Array:
        only("quality")
        texts = utf8(column)
        scores = [model.probability(t, h) for t, h in zip(texts, hashed_words(texts))] if model else [1.0] * len(texts)
        out = []
        for found, score in zip(measures(texts), scores):
            failed = found[0] < 10 or 100 * found[4] > 20 * found[0]
            out.append((*found, score, failed, not failed and score >= reject_below))
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return quality


def assess(docs: DataFrame, model: QualityModel | None, text: Column | None = None, into: str = "quality") -> DataFrame:
    """``docs`` with one struct column more, of the name given by ``into``."""
    small_batches(docs.sparkSession)
    return docs.withColumn(into, judge(model)(F.col("text") if text is None else text))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules and the classifier keep; columns as given."""
    model = train(docs, labels)
    into = unused(docs.columns, "__quality")
    return assess(docs, model, into=into).where(F.col(f"{into}.kept")).select(*quoted(docs.columns))
