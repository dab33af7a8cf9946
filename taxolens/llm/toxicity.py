"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary language.

A word is read in two steps, its stem (the first ``STEM`` bytes, its end included) and then
the whole word. In a class c, each step has an interpolated, discounted probability

    P(u | v, c) = (n(c, v, u) - D(c, n)) / n(c, v) + l(c, v) S(u | v)

where v is what stands before (nothing, or the stem) and l(c, v) is the mass that the
discounts leave. The backoff S(u | v) is shared by the classes: the continuation count of u,
the number of classes that it follows v in, plus one, over all and one for words not met.
So a rare or new word has the evidence of its stem and little of its own, and a word of
one class alone counts for as much as it was met there. The discounts D(c, n) of each step
and class are estimated from counts of counts (one, two, three and more).

A toxic document is ordinary for the most part. Its likelihood is therefore that of a
mixture, ``MIXED`` parts of the toxic model and the rest of the ordinary one; against the
ordinary model alone, words of neither class say next to nothing. A document's score is a
logistic function, at the true class shares, of three log-likelihood differences over the
whole text: toxic and ordinary model by length; mixture and ordinary model by length; the
same by the root of the length. It is fitted by cross-fitting: the sample is dealt in
``PARTS``, and each part's rows are told by models that leave their part out.

Counts are made on the executors and grouped by Spark; the driver gets the finished
tables. Rows of the held-out fold (crc32 of the id as text, mod 4, is 2) are never learnt
from. Models are fitted on a bounded sample of labelled rows (``FIT_ROWS_PER_CLASS``),
one text an id.

Defined cases: null and empty texts have no words and the score of that; repeated rows
are scored each and give the sample one text an id; a very long text costs time and memory
in proportion; without labelled rows of both classes every score is the share of class 1
(0 without rows); the score takes the name given by ``into`` and replaces a column of that
name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep, release, small_batches, utf8
from taxolens.llm.hashing import TOGETHER, Lookup, word_hashes
from taxolens.llm.quality import class_sample, sampled_texts

FIT_ROWS_PER_CLASS = 2500
#: Discount where counts of counts are too few to estimate by.
DISCOUNT = 0.75
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Words are lower-cased runs of ASCII letters, digits and non-ASCII bytes.
TOKEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a stem; what stands before it.
STEM, ROOT = 5, 0
#: The share of the toxic model in a toxic text.
MIXED = 0.01
#: Parts of the sample; model 0 has all of them, model p all but part p.
PARTS = 3
FEATURES = 3


def fold(column: str = "doc_id", folds: int = FOLDS):
    """Spark column: crc32 of the id as text, mod ``folds`` (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def _stems(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The first bytes of the words at ``starts``, as numbers; short words end in a space."""
    a = np.frombuffer(data + b" " * STEM, np.uint8)
    found, inside = np.zeros(starts.size, np.int64), np.ones(starts.size, bool)
    for k in range(STEM):
        own = np.where(inside, a[starts + k], 32)
        inside &= own != 32
        found = found << 8 | own
    return found


def words_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stems and hashes of each text's words."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size == 0 or size + len(texts[to]) < TOGETHER):
            size, to = size + len(texts[to]) + 1, to + 1
        data = b" ".join(texts[at:to]).translate(TOKEN)
        hashes, starts = word_hashes(data)
        hashes, stems = hashes.view(np.int64), _stems(data, starts)
        edges = np.concatenate([[0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts[at:to]]))]).tolist()
        for a, b in zip(edges, edges[1:]):
            yield stems[a:b], hashes[a:b]
        at = to


@dataclass
class KneserNey:
    """Log-ratios, toxic over ordinary, of known words, of new words by stem, of the rest."""

    words: Lookup
    ratio: np.ndarray
    stems: Lookup
    new: np.ndarray
    rest: float

    def ratios(self, stems: np.ndarray, words: np.ndarray) -> np.ndarray:
        out = np.full(words.size, self.rest)
        place = self.words.find(words)
        known = place >= 0
        out[known] = self.ratio[place[known]]
        left = np.flatnonzero(~known)
        place = self.stems.find(stems[left])
        out[left[place >= 0]] = self.new[place[place >= 0]]
        return out


def differences(ratios: np.ndarray) -> np.ndarray:
    """The three log-likelihood differences of a text from its words' log-ratios."""
    if not ratios.size:
        return np.zeros(FEATURES)
    mixed = np.log1p(MIXED * np.expm1(np.clip(ratios, -20, 20)))
    return np.array([ratios.mean(), mixed.mean(), mixed.sum() / np.sqrt(ratios.size)])


@dataclass
class ToxicModel:
    """The language models and the weights of the differences."""

    language: KneserNey
    weights: np.ndarray
    bias: float

    def score(self, stems: np.ndarray, words: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(differences(self.language.ratios(stems, words)) @ self.weights + self.bias, -30, 30))))


def _counts(batches):
    """Occurrences of each word of a batch, by part and class: part, stem, word, n0, n1."""
    for batch in batches:
        held: dict[tuple, list] = {}
        for part, label, own in zip(batch.column("part").to_pylist(), batch.column("label").to_pylist(), words_of(utf8(batch.column("text")))):
            held.setdefault((part, label), []).append(own)
        for (part, label), own in held.items():
            words, first, n = np.unique(np.concatenate([w for _, w in own]), return_index=True, return_counts=True)
            none = np.zeros(n.size, np.int64)
            counts = (n, none) if label == 0 else (none, n)
            stems = np.concatenate([s for s, _ in own])[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n.size, part, np.int32)), pa.array(stems), pa.array(words), *map(pa.array, counts)], ["part", "stem", "word", "n0", "n1"])
    release()


def _discounts(c: int) -> list[Column]:
    """Discounts of counts of one, two, three and more of a class, from counts of counts."""
    ones, twos, threes, fours = (F.sum((F.col(f"n{c}") == k).cast("long")) for k in (1, 2, 3, 4))
    y = ones / (ones + 2 * twos)
    raw = (1 - 2 * y * twos / ones, 2 - 3 * y * threes / twos, 3 - 4 * y * fours / threes)
    enough = (ones > 0) & (twos > 0) & (threes > 0)
    return [F.when(enough, F.least(F.greatest(d, F.lit(0.1)), F.lit(k - 0.1))).otherwise(DISCOUNT).alias(f"d{c}{k}") for k, d in enumerate(raw, 1)]


def step(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One step of the models: from counts (fit, before, unit, n0, n1), the log-ratio of each
    unit (fit, before, unit, ratio) and, of new ones, that of what stands before (fit,
    before, rest)."""
    off = units.groupBy("fit").agg(*_discounts(0), *_discounts(1))  # a row a model
    cut = lambda c: F.when(F.col(f"n{c}") == 0, 0.0).when(F.col(f"n{c}") == 1, F.col(f"d{c}1")).when(F.col(f"n{c}") == 2, F.col(f"d{c}2")).otherwise(F.col(f"d{c}3"))
    each = units.join(F.broadcast(off), "fit").select("fit", "before", "unit", "n0", "n1", cut(0).alias("o0"), cut(1).alias("o1"), ((F.col("n0") > 0).cast("int") + (F.col("n1") > 0).cast("int") + 1).alias("kinds"))
    left = lambda c: F.when(F.sum(f"n{c}") > 0, F.sum(f"o{c}") / F.sum(f"n{c}")).otherwise(1.0).alias(f"l{c}")
    context = each.groupBy("fit", "before").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), left(0), left(1), (F.sum("kinds") + 1).alias("all"))
    p = lambda c: F.when(F.col(f"t{c}") > 0, (F.col(f"n{c}") - F.col(f"o{c}")) / F.col(f"t{c}")).otherwise(0.0) + F.col(f"l{c}") * F.col("kinds") / F.col("all")
    told = each.join(context, ["fit", "before"]).select("fit", "before", "unit", F.log(p(1) / p(0)).alias("ratio"))
    return told, context.select("fit", "before", F.log(F.col("l1") / F.col("l0")).alias("rest"))


def kneser_ney(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (part, label, text), log-ratios of all models: words (fit, word, ratio), new words
    by stem (fit, stem, rest) and all other words (fit, rest)."""
    counted = rows.select("part", "label", "text").mapInArrow(_counts, "part int, stem long, word long, n0 long, n1 long")
    fits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(PARTS)), lambda f: f != F.col("part")))
    sums = [F.sum("n0").alias("n0"), F.sum("n1").alias("n1")]
    words = counted.groupBy("part", "stem", "word").agg(*sums).select(fits.alias("fit"), "stem", "word", "n0", "n1").groupBy("fit", "stem", "word").agg(*sums)
    words = keep(words.withColumnsRenamed({"stem": "before", "word": "unit"}), "words")
    stems, root = step(words.groupBy("fit", "before").agg(*sums).select("fit", F.lit(ROOT).alias("before"), F.col("before").alias("unit"), "n0", "n1"))
    stems = stems.select("fit", F.col("unit").alias("before"), F.col("ratio").alias("stem_ratio"))
    told, new = step(words)
    told = told.join(stems, ["fit", "before"]).select("fit", F.col("unit").alias("word"), (F.col("ratio") + F.col("stem_ratio")).alias("ratio"))
    new = new.join(stems, ["fit", "before"]).select("fit", F.col("before").alias("stem"), (F.col("rest") + F.col("stem_ratio")).alias("rest"))
    return told, new, root.select("fit", "rest")


def language_models(rows: DataFrame) -> dict[int, KneserNey]:
    """The models as tables for workers, bounded by the sample: by number (see ``PARTS``)."""
    words, new, root = (t.toArrow() for t in kneser_ney(rows))

    def of(table: pa.Table, fit: int) -> list[np.ndarray]:
        own = table.filter(pa.compute.equal(table.column("fit"), fit))
        return [own.column(i).to_numpy() for i in (1, 2)]

    rest = dict(zip(root.column("fit").to_pylist(), root.column("rest").to_pylist()))
    found = {}
    for fit in rest:
        (w, ratio), (s, other) = of(words, fit), of(new, fit)
        found[fit] = KneserNey(Lookup(w), ratio, Lookup(s), other, rest[fit])
    return found


def _newton(x: np.ndarray, z: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a weighted logistic regression on few features."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    beta, ridge = np.zeros(FEATURES + 1), np.diag([1e-5] * FEATURES + [0.0])
    for _ in range(60):  # damped steps
        q = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        g = x1.T @ (w * (q - z)) + ridge @ beta
        h = (x1 * (w * q * (1 - q) + 1e-9)[:, None]).T @ x1 + ridge + 1e-9 * np.eye(FEATURES + 1)
        step = np.linalg.solve(h, g)
        beta -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return beta[:FEATURES], float(beta[FEATURES])


def train(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS_PER_CLASS) -> ToxicModel | float:
    """The model; only the share of class 1 where one class has no rows."""
    small_batches(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & (fold() != HELD_OUT)).select("doc_id", "toxic")
    share = dict(known.groupBy("toxic").count().collect())
    part = (F.pmod(F.xxhash64("doc_id", F.lit(22)), F.lit(PARTS)) + 1).cast("int")
    rows = keep(sampled_texts(docs, class_sample(known, "toxic", per_class)).withColumn("part", part), "sample")
    if rows.select("label").distinct().count() < 2:
        return share.get(1, 0) / max(1, sum(share.values()))
    models = language_models(rows)
    if not models:  # no text has a word
        return share[1] / sum(share.values())
    nothing = KneserNey(Lookup(np.zeros(0, np.int64)), np.zeros(0), Lookup(np.zeros(0, np.int64)), np.zeros(0), 0.0)

    @F.arrow_udf("array<double>")
    def told(parts: pa.Array, texts: pa.Array) -> pa.Array:
        found = zip(parts.to_pylist(), words_of(utf8(texts)))
        return pa.array([differences(models.get(p, nothing).ratios(*own)).tolist() for p, own in found], pa.list_(pa.float64()))

    own = sorted((r.doc_id, r.label, r.x) for r in rows.select("doc_id", "label", told("part", "text").alias("x")).collect())  # three numbers a sampled row
    x, z = np.array([f for *_, f in own]), np.array([y for _, y, _ in own], float)
    w = np.where(z > 0, share[1] / z.sum(), share[0] / (1 - z).sum())
    return ToxicModel(models[0], *_newton(x, z, w / w.sum()))


def assess(docs: DataFrame, model: ToxicModel | float, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with one double column more, from 0 to 1."""
    small_batches(docs.sparkSession)
    if not isinstance(model, ToxicModel):
        return docs.withColumn(into, F.lit(float(model)))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(*own) for own in words_of(utf8(texts))], pa.float64())

    return docs.withColumn(into, score(F.col(text)))
