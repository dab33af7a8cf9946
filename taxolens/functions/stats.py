"""Statistics as Spark columns: Wilson's interval, thresholds, selective metrics, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.operators.ordering import running

#: Two-sided 95 % quantile of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """Lower and upper end of Wilson's interval, in [0, 1]; null without trials."""
    n = F.when(total > 0, total.cast("double"))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    radius = F.lit(z) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - radius)), F.when(n.isNotNull(), F.least(F.lit(1.0), centre + radius))


def threshold_curve(rows: DataFrame, correct: str, confidence: str = "confidence", by: list[str] | None = None) -> DataFrame:
    """One row per distinct confidence (and group): accepted and correct rows at or above it.

    Ties are one step: rows are summed by confidence before anything is accumulated."""
    steps = rows.groupBy(*(by or []), F.col(confidence).alias("threshold")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(correct).cast("long")).alias("right"))
    return accumulated(steps, by)


def accumulated(steps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The curve of ``steps``: threshold, rows and right ones of each distinct confidence.
    Range partitions sum up their own steps (``running``)."""
    curve = running(steps, [F.col("threshold").desc()], {"accepted": "rows", "correct": "right"}, by).select(*(by or []), "threshold", "accepted", "correct")
    low, high = wilson(F.col("correct"), F.col("accepted"))
    return curve.withColumns({"precision": F.col("correct") / F.col("accepted"), "low": low, "high": high})


def best_cut(curve: DataFrame, target: float, minimum: int, by: list[str] | None = None) -> DataFrame:
    """``by`` and the cut of each group that accepts most among those whose lower bound
    reaches the target, even past cuts that fail."""
    fit = curve.where((F.col("accepted") >= minimum) & (F.col("low") >= target))
    own = F.struct("accepted", "threshold", "correct", "precision", F.col("low").alias("precision_low"), F.col("high").alias("precision_high"))
    return fit.groupBy(*(by or [])).agg(F.max(own).alias("b")).where("b is not null").select(*(by or []), "b.*")


def fitted_threshold(rows: DataFrame, correct: str, target: float = 0.9, minimum: int = 20) -> DataFrame:
    """One row: the best cut; nulls and zeros where there is none.

    ``rows`` has status, confidence and the ``correct`` column; coverage is of all rows."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    best = best_cut(threshold_curve(rows.where("status = 'predicted'"), correct), target, minimum)
    return total.join(best, F.lit(True), "left").select(
        "threshold", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("correct", F.lit(0)).alias("correct"), "precision",
        "precision_low", "precision_high", F.coalesce(F.col("accepted") / F.col("total"), F.lit(0.0)).alias("coverage"),
    )


def selective_metrics(rows: DataFrame, cutoff: Column, correct: str, by: list[str] | None = None) -> DataFrame:
    """total, accepted, correct, coverage, precision and its interval, per group.

    A null cutoff accepts nothing; precision is then null and coverage 0."""
    accepted = F.coalesce((F.col("status") == "predicted") & (F.col("confidence") >= cutoff), F.lit(False))
    sums = rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & F.col(correct)).alias("correct"))
    low, high = wilson(F.col("correct"), F.col("accepted"))
    return sums.withColumns(
        {
            "coverage": F.when(F.col("total") > 0, F.col("accepted") / F.col("total")).otherwise(0.0),
            "precision": F.when(F.col("accepted") > 0, F.col("correct") / F.col("accepted")),
            "precision_low": low,
            "precision_high": high,
        }
    )


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def vector_sums(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, and the element-wise sum ``s`` of a vector column, by position: partial
    sums are made before the shuffle."""
    parts = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e.x).alias("s"))


def coherence(n: Column, s: Column) -> Column:
    """Mean cosine of distinct pairs of unit vectors, from their count and sum."""
    raw = (dot(s, s) - n) / (n * (n - 1))
    return F.when(n >= 2, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def checked_probabilities(p: Column, options: Column) -> Column:
    """A map from option to probability, normalised; an error where keys differ from
    the options, a value is not finite or not in [0, 1], or the sum is not 1."""
    keys, values = F.map_keys(p), F.map_values(p)
    same = (F.size(F.array_except(keys, options)) == 0) & (F.size(F.array_except(options, keys)) == 0)
    fine = ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    close = F.abs(total - 1) <= F.greatest(F.lit(1e-4) * F.greatest(F.abs(total), F.lit(1.0)), F.lit(1e-5))
    return (
        F.when(~same, F.raise_error(F.lit("labels were omitted or invented")))
        .when(~fine, F.raise_error(F.lit("invalid probabilities")))
        .when(~close, F.raise_error(F.lit("probabilities do not sum to one")))
        .otherwise(F.transform_values(p, lambda _, v: v / total))
    )
