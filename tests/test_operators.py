"""Exact sums, running sums, ranks, lowest rows, blocked scoring, evaluation, k-means."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolens.functions import exact, stats
from taxolens.operators import kmeans, ordering, partition, place, scoring


def summed(values):
    """The double next to the exact sum."""
    if any(math.isnan(x) for x in values) or {math.inf, -math.inf} <= set(values):
        return math.nan
    if any(map(math.isinf, values)):
        return next(x for x in values if math.isinf(x))
    total = sum(map(Fraction, values))
    try:
        return float(total)
    except OverflowError:
        return math.inf if total > 0 else -math.inf


def test_sums_are_exact(spark):
    rng = random.Random(1)
    kinds = [
        lambda: rng.uniform(-1, 1), lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300), lambda: rng.choice([5e-324, -5e-324, 1e-310, 1.7e308, -1.7e308]),
        lambda: float(rng.randint(-9, 9)), lambda: 2.0 ** rng.randint(-1074, 1020), lambda: math.nextafter(2.0 ** rng.randint(-1000, 1000), 0),
    ]
    groups = {}
    for g in range(250):
        v = [rng.choice(kinds)() for _ in range(rng.randint(1, 30))]
        if g % 3 == 0:  # all cancels out but a little
            v += [-x for x in v] + [rng.choice([1e-320, 1.0, 0.0, 5e-324, 2.0**-1022])]
        groups[g] = rng.sample(v, len(v))
    groups |= {1000: [0.1, 0.2, 0.3], 1001: [1.0, 2.0**-53], 1002: [1.0, 2.0**-53, 5e-324], 1003: [-1.0, -(2.0**-53), -5e-324], 1004: [1e308, 1e308, -1e308], 1005: [0.1] * 10}
    groups |= {1010: [math.inf, 1.0], 1011: [math.inf, -math.inf], 1012: [math.nan, 1.0], 1013: [0.0, -0.0], 1014: [1.7e308, 1.7e308], 1015: [-math.inf]}
    rows = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [(2000, None)], "g int, x double")
    got = {r.g: r["sum"] for r in exact.exact_sums(rows.repartition(5), ["g"], "x").collect()}
    again = {r.g: r["sum"] for r in exact.exact_sums(rows.repartition(2, "x"), ["g"], "x").collect()}
    arrays = {r.g: r.s for r in rows.groupBy("g").agg(F.collect_list("x").alias("v")).select("g", exact.exact_array_sum(F.col("v")).alias("s")).collect()}
    for g, v in groups.items():
        for have in (got[g], again[g], arrays[g]):
            assert have == summed(v) or (math.isnan(have) and math.isnan(summed(v))), (g, v)
    assert arrays[2000] is None and got.get(2000) is None


def test_running_sums_by_range(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(g, round(c, 3), rng.randint(0, 5)) for g in ("a", None) for c in {rng.random() for _ in range(300)}], "g string, c double, n long").groupBy("g", "c").agg(F.sum("n").alias("n"))
    got = ordering.running(rows, [F.col("c").desc()], {"upto": "n"}, ["g"]).collect()
    for r in got:
        assert r.upto == sum(x.n for x in got if x.g == r.g and x.c >= r.c)
    assert len(got) == rows.count()
    plan = stats.threshold_curve(spark.createDataFrame([(0.5, True)], "confidence double, ok boolean"), "ok")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("Scan parquet")[0] or plan.count("SinglePartition") <= 1  # a row a partition


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 3, 3, 9], [None, 7, 1, None], [-(2**63), 2**63 - 1, 0, 5], list(range(10_001)), [10**15 + i * 7 for i in range(50)] + [1] * 49])
def test_medians_are_exact(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    given = sorted(v for v in values if v is not None)
    n = len(given)
    assert ordering.median(rows, "v") == (given[(n - 1) // 2] + given[n // 2]) / 2
    assert ordering.at_ranks(rows, "v", [0, n - 1]) == [given[0], given[-1]]
    with pytest.raises(ValueError):
        ordering.at_ranks(rows, "v", [n])
    assert ordering.median(rows.limit(0), "v") is None and ordering.median(rows.where("v is null"), "v") is None


def test_lowest_rows_of_a_large_group(spark, monkeypatch):
    rows = spark.range(30_000).select(F.when(F.col("id") < 29_000, "big").when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"), (F.col("id") % 25_000).cast("string").alias("k"))
    for most in (200_000, 0):
        monkeypatch.setattr(ordering, "MOST_CUTS", most)
        got = {}
        sample = partition.sample_by(rows, "g", "k", 50)
        assert sample.columns == rows.columns
        for r in sample.collect():
            got.setdefault(r.g, []).append(r.k)
        import hashlib

        for g, have in got.items():
            every = sorted((hashlib.sha256(f"42:{r.k}".encode()).hexdigest(), r.k) for r in rows.where(F.col("g").eqNullSafe(F.lit(g))).collect())
            assert sorted(have) == sorted(k for _, k in every[:50])
    assert len(got) == 9


def test_many_labels_in_blocks_and_passes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    labels, x = rng.normal(size=(12_000, 4)), rng.normal(size=(30, 4))
    names = [f"{i:05d}" for i in range(12_000)]
    labels[7] = labels[9_999] = labels[3]  # ties go by id
    x[0] = 5 * labels[3]
    rows = spark.createDataFrame([(f"W{i}", v.tolist()) for i, v in enumerate(x)], "work_id string, vector array<double>").repartition(3)
    options = spark.createDataFrame([(n, "name " + n, None if i == 5 else v.tolist()) for i, (n, v) in enumerate(zip(names, labels))], "option_id string, option_name string, vector array<double>")
    logits = 2.0 * x @ labels.T
    logits[:, 5] = -2.0
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    for size in (64 << 20, 200_000):
        monkeypatch.setattr(scoring, "PASS_BYTES", size)
        got = {r.work_id: r for r in scoring.by_vectors(rows, options, 2.0).collect()}
        assert len(got) == 30
        for i in range(30):
            want = sorted(range(12_000), key=lambda j: (-round(logits[i, j], 9), names[j]))[:3]
            own = got[f"W{i}"]
            assert [c.id for c in own.candidates] == [names[j] for j in want] and own.prediction == names[want[0]]
            assert [c.probability for c in own.candidates] == pytest.approx([p[i, j] for j in want]) and own.confidence == own.candidates[0].probability
            assert own.candidates[0].name == "name " + names[want[0]]
    plan = scoring.by_vectors(rows, options.limit(10), 2.0)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Window" not in plan
    assert scoring.by_vectors(rows, options.limit(0), 2.0).isEmpty()


def test_a_user_function_sees_every_label_of_a_record(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK", 7)
    texts = spark.createDataFrame([("W1", "aaa"), ("W2", "b")], "work_id string, text string")
    options = spark.createDataFrame([(f"{i:02d}", "a" * i) for i in range(20)], "option_id string, option_name string")

    def near(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("work_id"), b.column("option_id"), pa.array([-abs(len(r["text"]) - len(r["option_name"])) * 1.0 for r in rows])], ["work_id", "option_id", "logit"])

    scorer = place.MapScorer({"m": 1}, texts, {}, near)
    got = {r.work_id: [c.id for c in r.candidates] for r in place.flat(texts, options, scorer).collect()}
    assert got == {"W1": ["03", "02", "04"], "W2": ["01", "00", "02"]}

    def forgetful(batches):
        yield from (b.select(["work_id", "option_id"]).append_column("logit", b.column("work_id").cast("string").dictionary_encode().indices.cast("double")).slice(0, 3) for b in batches)

    with pytest.raises(Exception, match="omitted"):
        place.flat(texts, options, place.MapScorer({"m": 1}, texts, {}, forgetful)).collect()


def test_levels_in_one_pass(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([("predicted" if rng.random() < 0.9 else "insufficient_metadata", round(rng.random(), 2), rng.random() < 0.8, rng.random() < 0.9, rng.choice(["calibration", "test", "train"]), rng.choice(["a", "b", None])) for _ in range(600)], "status string, confidence double, correct_primary boolean, correct_any_topic boolean, partition string, type string")
    both = place.evaluate(rows, 0.7, 10, ["type"], overall=True).collect()
    alone = {r.reference: r for r in place.evaluate(rows, 0.7, 10).collect()}
    by_type = {(r.reference, r.type): r for r in place.evaluate(rows, 0.7, 10, ["type"]).collect()}
    assert len(both) == 8
    for r in both:
        other = alone[r.reference] if r.whole else by_type[r.reference, r.type]
        assert all(r[c] == other[c] for c in ("threshold", "total", "accepted", "correct", "precision", "precision_low", "coverage", "unthresholded_accuracy", "status", "calibration_accepted"))
    for reference, r in alone.items():
        fitted = stats.fitted_threshold(rows.where("partition = 'calibration'"), f"correct_{reference}", 0.7, 10).first()
        test = stats.selective_metrics(rows.where("partition = 'test'"), F.lit(fitted.threshold), f"correct_{reference}").first()
        assert (r.threshold, r.calibration_accepted, r.calibration_coverage) == (fitted.threshold, fitted.accepted, fitted.coverage)
        assert all(r[c] == test[c] for c in ("total", "accepted", "correct", "coverage", "precision", "precision_low", "precision_high"))


def plain_means(x, k, seed, starts=10):
    """The cost of the best of several ordinary runs from k-means++ starts."""
    best = np.inf
    for s in range(starts):
        rng = np.random.default_rng([seed, k, s])
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            far = ((x[:, None] - c) ** 2).sum(2).min(1)
            c = np.vstack([c, x[rng.choice(len(x), p=far / far.sum())]])
        for _ in range(100):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.stack([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
        best = min(best, ((x[:, None] - c) ** 2).sum(2).min(1).sum())
    return best


def points(seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(60, 6)) * 0.4 + rng.normal(size=6) for _ in range(4)])
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("block", [1024, 50])
def test_means_of_many_groups_at_once(spark, monkeypatch, block):
    monkeypatch.setattr(kmeans, "BLOCK", block)
    data = {"a": points(1), "b": points(2)[:90], "c": np.eye(6)[[0] * 5 + [3] * 5]}
    rows = [(s, f"W{i:03d}", [(str(j), float(v)) for j, v in enumerate(r) if v]) for s, x in data.items() for i, r in enumerate(x)]
    works = spark.createDataFrame([*rows, ("a", "none", [])], "sink string, work_id string, features array<struct<f:string,x:double>>").repartition(3)
    ks = spark.createDataFrame([("a", [2, 4]), ("b", [3]), ("c", [2])], "sink string, ks array<int>")
    found = kmeans.fit(works, ks, count=6)
    got = {}
    for r in found.collect():
        got.setdefault((r.sink, r.k), {})[r.work_id] = r.cluster
    assert set(got) == {("a", 2), ("a", 4), ("b", 3), ("c", 2)} and "none" not in got["a", 2]
    for (s, k), labels in got.items():
        x, own = data[s], np.array([labels[f"W{i:03d}"] for i in range(len(data[s]))])
        means = np.stack([x[own == j].mean(0) if (own == j).any() else np.full(6, 9.0) for j in range(k)])
        assert ((((x[:, None] - means) ** 2).sum(2)).argmin(1) == own).mean() > 0.999  # no work is nearer to another mean
        assert ((x - means[own]) ** 2).sum() <= plain_means(x, k, 5) * 1.02 + 1e-9
    assert len(set(got["c", 2].values())) == 2
    again = kmeans.fit(works.repartition(5), ks, count=6)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in found.collect()}
    assert kmeans.fit(works, ks.limit(0)).isEmpty()


def test_a_step_in_blocks_is_a_step(spark, monkeypatch):
    x = points(9)
    works = spark.createDataFrame([("s", f"W{i:03d}", [(str(j), float(v)) for j, v in enumerate(r)]) for i, r in enumerate(x)], "sink string, work_id string, features array<struct<f:string,x:double>>")
    members = spark.createDataFrame([("s", 4, f"W{i:03d}", i % 3) for i in range(len(x))], "sink string, k int, work_id string, cluster int")
    centres = np.stack([x[np.arange(len(x)) % 3 == j].mean(0) for j in range(3)] + [np.zeros(6)])  # the fourth has no works
    want = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    for block in (1024, 30):
        monkeypatch.setattr(kmeans, "BLOCK", block)
        packed = kmeans.blocks(works)
        runs = kmeans.from_labels(packed, members)
        got = {r.work_id: r.cluster for r in kmeans.labels(packed, runs).collect()}
        assert [got[f"W{i:03d}"] for i in range(len(x))] == want.tolist()
        step = kmeans.step(packed, runs, most=1).first()
        sums = {(e.cluster, e.f): e.v for e in step.entries}
        assert [sums.get((j, kmeans.COUNT), 0) for j in range(4)] == np.bincount(want, minlength=4).tolist()
        assert step.cost / kmeans.UNIT == pytest.approx(((x - centres[want]) ** 2).sum(), rel=1e-6) and not step.over


def test_a_value_is_one_row_of_an_exact_sum(spark):
    sums = exact.exact_sums(spark.createDataFrame([(1, 0.5)], "g int, x double"), ["g"], "x")
    assert "Generate" not in sums._jdf.queryExecution().executedPlan().toString()


def test_titles_of_families_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def title(i):
        read.add(1)
        return f"Title {i // 2}"

    records = spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("string").alias("doi"), F.udf(title, "string")("id").alias("title"))
    got = {r.id: r.family for r in partition.families(records).collect()}
    assert got == {str(i): min(str(i), str(i ^ 1)) for i in range(40)}
    assert read.value == 40
