import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolens.functions import stats, text
from taxolens.functions.text import feature_text, insufficient_metadata
from taxolens.operators import partition, place, split, validate
from taxolens.operators.components import connected_components
from taxolens.operators.validate import InputError
from taxolens.sources import readers


def predicted(spark, *groups):
    return spark.createDataFrame([("predicted", c, ok) for n, c, ok in groups for _ in range(n)], "status string, confidence double, correct_primary boolean")


def test_threshold_keeps_ties_and_the_last_eligible_cut(spark):
    fit = lambda *g: stats.fitted_threshold(predicted(spark, *g), "correct_primary").first()
    best = fit((50, 0.9, True), (50, 0.2, False))
    assert (best.threshold, best.accepted, best.coverage) == (0.9, 50, 0.5) and best.precision_low >= 0.9
    few = fit((20, 0.9, True))
    assert (few.threshold, few.accepted, few.precision, few.coverage) == (None, 0, None, 0.0)
    assert fit((50, 0.9, True), (10, 0.9, False)).threshold is None
    late = fit((5, 0.95, False), (300, 0.5, True))  # an early cut fails, a later one holds
    assert late.threshold == 0.5


def test_wilson(spark):
    low, high = stats.wilson(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(0, 0), (50, 50), (5, 10)], "s long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert tuple(rows[0]) == (None, None) and rows[1].h == 1.0 and rows[1].l == pytest.approx(0.92865, abs=1e-4)
    assert rows[2].l == pytest.approx(0.2366, abs=1e-3)


def test_nothing_accepted_has_no_precision(spark):
    row = stats.selective_metrics(predicted(spark, (1, 0.9, True)), F.lit(None).cast("double"), "correct_primary").first()
    assert (row.accepted, row.coverage, row.precision, row.precision_low) == (0, 0.0, None, None)


class Fixed:
    identity = {"scorer": "fixed"}

    def logits(self, asked, level):
        return asked.withColumn("logit", F.when(F.col("option_id") == "1", F.log(F.lit(0.99))).otherwise(F.log(F.lit(0.01))))


@pytest.fixture(scope="module")
def tax(spark):
    return spark.createDataFrame([("T1", "1", "s1", "1", "f1", "1", "d"), ("T2", "2", "s2", "2", "f2", "1", "d")], "topic_id string, subfield string, subfield_name string, field string, field_name string, domain string, domain_name string")


def test_hierarchical_confidence_is_the_product(spark, tax):
    row = place.hierarchical(spark.createDataFrame([("W1",)], "work_id string"), tax, Fixed()).first()
    assert row.prediction == "1" and row.confidence == pytest.approx(0.99)
    assert [s.level for s in row.route] == ["domain", "field", "subfield"]
    assert row.route[0].probability == 1.0  # one child: not asked
    assert len(row.candidates) == 1


def test_evaluation_fits_on_calibration_only(spark, tax):
    rows = [(f"W{i}", "calibration", "T1") for i in range(50)] + [(f"V{i}", "test", "T2") for i in range(10)]
    works = spark.createDataFrame(rows, "work_id string, partition string, primary_topic_id string").withColumn("topic_ids", F.when(F.col("partition") == "test", F.array(F.lit("T2"), F.lit("T1"))).otherwise(F.array("primary_topic_id"))).withColumn("type", F.lit("article"))
    options = tax.select(F.col("subfield").alias("option_id"), F.col("subfield_name").alias("option_name"))
    p = works.select("work_id", "partition", "type").join(place.flat(works, options, Fixed()), "work_id").withColumn("status", F.lit("predicted"))
    found = place.labelled(p, works.select("work_id", "primary_topic_id", "topic_ids"), tax)
    out = {r.reference: r for r in place.evaluate(found).collect()}
    assert out["primary"].threshold == pytest.approx(0.99) and out["primary"].precision == 0 and out["primary"].status == "target_not_met_on_test"
    assert out["any_topic"].correct == 10 and out["any_topic"].status == "target_met_on_test"
    test = found.where("partition = 'test'").first()
    assert (test.correct_primary, test.correct_any_topic, test.primary_in_top3_predictions) == (False, True, True)
    for cutoff, status in ((0.5, "accepted"), (None, "abstain")):
        assert {r.status for r in place.apply_threshold(found, cutoff).select("status").distinct().collect()} == {status}
    with pytest.raises(ValueError):
        place.apply_threshold(found, 2.0)


def test_features_and_blank_metadata(spark):
    rows = spark.createDataFrame([("a" * 3000, "s", "t", ["k" * 200] * 30), ("", " ", "article", [" "]), ("", "", "x", None)], "title string, source string, type string, keywords array<string>")
    c = [F.col(x) for x in ("title", "source", "type", "keywords")]
    got = rows.select(feature_text(*c).alias("t"), insufficient_metadata(c[0], c[1], c[3]).alias("b")).collect()
    assert got[0].t.split("\n")[0] == "Title: " + "a" * 2000 and got[0].t.count("; ") == 19
    assert got[1].t.endswith("Keywords:  ") and [r.b for r in got] == [False, True, True]


@pytest.mark.parametrize("p", [{"1": 1.0}, {"1": 0.8, "2": 0.8}, {"1": float("nan"), "2": 0.0}, {"1": -1.0, "2": 2.0}])
def test_bad_probabilities_are_refused(spark, p):
    rows = spark.createDataFrame([(p,)], "p map<string,double>")
    with pytest.raises(Exception, match="labels|probabilities"):
        rows.select(stats.checked_probabilities(F.col("p"), F.array(F.lit("1"), F.lit("2"))).alias("p")).collect()


def test_families_are_transitive(spark):
    rows = [("W1", "A", None, "shared title"), ("W2", "B", None, "Shared,  TITLE!"), ("W3", "B", None, "other"), ("W4", "C", None, "alone"), ("W5", None, "10.1/X", ""), ("W6", None, "10.1/x", "")]
    records = spark.createDataFrame(rows, "id string, source_id string, doi string, title string")
    got = {r.id: r for r in partition.assign_partitions(records).collect()}
    assert got["W1"].family == got["W2"].family == got["W3"].family == "W1" and got["W4"].family == "W4" and got["W6"].family == "W5"
    assert len({got[w].partition for w in ("W1", "W2", "W3")}) == 1
    assert partition.leaks(partition.assign_partitions(records)).isEmpty()
    forged = records.withColumns({"partition": F.when(F.col("id") == "W2", "test").otherwise("train"), "split_group": F.col("id")})
    assert {(r.kind, r.key) for r in partition.leaks(forged).collect()} == {("source", "B"), ("title", "shared title")}


def test_case_is_folded(spark):
    letters = [c for i in range(1, 0x3000) if (c := chr(i)).isalpha() and not 0x13A0 <= i < 0x1400 and not 0x1C80 <= i < 0x1C90]
    rows = spark.createDataFrame(list(enumerate([*letters, "STRAßE ﬁn ΣΑΣ"])), "i int, c string")
    got = {r.i: r.x for r in rows.select("i", text.fold_case("c").alias("x")).collect()}
    assert [c for i, c in enumerate(letters) if got[i] != c.casefold()] == [] and got[len(letters)] == "strasse fin σασ"
    records = spark.createDataFrame([("W1", None, "10.1/ß", "x"), ("W2", None, "10.1/SS", "y"), ("W3", None, None, "GROSSE"), ("W4", None, None, "große")], "id string, source_id string, doi string, title string")
    assert {r.id: r.family for r in partition.families(records).collect()} == {"W1": "W1", "W2": "W1", "W3": "W3", "W4": "W3"}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and 0 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).isEmpty()


def test_primary_topic_comes_first_only_if_it_is_missing(spark):
    works = spark.createDataFrame([("W1", None, "t", "a", None, ("x/T9",), [("x/T1",), ("x/T2",), ("x/T3",), ("x/T4",)]), ("W2", "10.1/A", None, None, (("S1", "Src"),), None, None)], "id string, doi string, title string, type string, primary_location struct<source:struct<id:string,display_name:string>>, primary_topic struct<id:string>, topics array<struct<id:string>>")
    known = spark.createDataFrame([(f"T{i}",) for i in (1, 2, 9)], "topic_id string")
    got = {r.id: r for r in partition.normalise_works(works, known).collect()}
    assert got["W1"].truth.topic_ids == ["T9", "T1", "T2"] and got["W1"].unknown is None
    assert got["W2"].truth.topic_ids == [] and got["W2"].metadata.title == "" and got["W2"].source_id == "S1"


def text_sink(spark, titles):
    rows = [("T1", f"W{i:03d}", t) for i, t in enumerate(titles)]
    return split.tfidf_rows(spark.createDataFrame(rows, "sink string, work_id string, text string"), "text", split.STOP_WORDS)


SUBJECTS = ["photon laser quantum optical resonance study %d" % i for i in range(30)] + ["soil roots fungal plant symbiosis study %d" % i for i in range(30, 60)]


def test_two_subjects_are_parted(spark):
    row = split.split_sinks(text_sink(spark, [*SUBJECTS, " "]), max_clusters=2).first()
    assert (row.status, row.chosen_k, row.sampled, row.usable) == ("proposed_split", 2, 61, 60)
    assert row.silhouette > 0.9 and row.coherence > row.baseline_coherence
    of = {a.work_id: a for a in row.assignments}
    assert of["W000"].cluster_id == of["W029"].cluster_id != of["W030"].cluster_id and of["W000"].action == "propose_split"
    assert (of["W060"].action, of["W060"].cluster_id, of["W060"].reason) == ("unassigned", None, "insufficient_text")
    assert {c.cluster_id for c in row.clusters} == {"T1.C01", "T1.C02"} and sum(c["size"] for c in row.clusters) == 60
    assert split.assignments(split.split_sinks(text_sink(spark, SUBJECTS), max_clusters=2)).count() == 60


def test_nothing_is_made_up(spark):
    same = split.split_sinks(text_sink(spark, ["identical title"] * 30)).first()
    assert same.status == "insufficient_evidence" and same.silhouette is None
    few = split.split_sinks(text_sink(spark, SUBJECTS[:3])).first()
    assert few.reason == "fewer_than_two_minimum_clusters"
    with pytest.raises(ValueError):
        split.split_sinks(text_sink(spark, SUBJECTS), max_clusters=1)


GIVEN = "sink string, work_id string, has_text boolean, terms array<string>, weights array<double>, vector array<double>"


def test_vectors_without_shared_words(spark):
    rows = [("T1", f"W{i:02d}", True, [], [], [1.0, 0.0] if i < 30 else [0.0, 1.0]) for i in range(60)]
    got = split.split_sinks(spark.createDataFrame(rows, GIVEN), max_clusters=2).first()
    assert got.chosen_k == 2 and got.silhouette > 0.99 and all(c.keywords == [] for c in got.clusters)
    assert split.split_sinks(spark.createDataFrame(rows[::-1], GIVEN).repartition(3), max_clusters=2).first() == got


def test_a_split_equals_its_definition(spark):
    """Sizes, silhouettes, coherences, cosines and numbers, from the assignments."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(3, 6))
    x = np.array([centres[i % 3] * 2 + rng.normal(size=6) for i in range(45)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    terms = [[f"t{i % 3}", f"u{i % 5}"] for i in range(45)]
    rows = [("S", f"W{i:02d}", True, terms[i], [0.8, 0.6], x[i].tolist()) for i in range(45)] + [("S", "W99", False, [], [], None)]
    got = split.split_sinks(spark.createDataFrame(rows, GIVEN), max_clusters=5).first()
    assert got.status == "proposed_split" and got.chosen_k == max((c for c in got.candidates if c.silhouette is not None), key=lambda c: (round(c.silhouette, 12), -c.k)).k
    assert [c.k for c in got.candidates] == [2, 3, 4, 5] and all(sum(c.sizes) == 45 and c.sizes == sorted(c.sizes) for c in got.candidates)
    assert all((c.status == "evaluated") == (c.sizes[0] >= 5) == (c.silhouette is not None) for c in got.candidates)
    of = {a.work_id: a for a in got.assignments}
    assert (of["W99"].action, of["W99"].reason) == ("unassigned", "insufficient_text")
    label = np.array([of[f"W{i:02d}"].cluster_id for i in range(45)])
    d = 1 - x @ x.T
    values = []
    for i in range(45):
        mean = {c: d[i][(label == c) & (np.arange(45) != i)].mean() for c in set(label)}
        near = min(v for c, v in mean.items() if c != label[i])
        values.append((near - mean[label[i]]) / max(near, mean[label[i]]))
    assert got.silhouette == pytest.approx(np.mean(values))
    pairs = lambda own: (own @ own.T)[~np.eye(len(own), dtype=bool)]
    assert got.baseline_coherence == pytest.approx(pairs(x).mean())
    assert got.coherence == pytest.approx(np.concatenate([pairs(x[label == c]) for c in set(label)]).mean())
    for c in got.clusters:
        own = label == c.cluster_id
        centre = x[own].sum(0) / np.linalg.norm(x[own].sum(0))
        cosine = {i: x[i] @ centre for i in np.flatnonzero(own)}
        assert c["size"] == own.sum() and c.coherence == pytest.approx(pairs(x[own]).mean())
        assert all(of[f"W{i:02d}"].cosine_to_centroid == pytest.approx(v) for i, v in cosine.items())
        assert c.representatives == [f"W{i:02d}" for i in sorted(cosine, key=lambda i: (-round(cosine[i], 12), i))[:5]]
        weight = {}
        for i in np.flatnonzero(own):
            for t, w in zip(terms[i], (0.8, 0.6)):
                weight[t] = weight.get(t, 0) + w / own.sum()
        assert c.keywords == sorted(weight, key=lambda t: (-round(weight[t], 12), t))[:8]
    order = [(c.keywords, min(a.work_id for a in got.assignments if a.cluster_id == c.cluster_id)) for c in got.clusters]
    assert order == sorted(order) and [c.cluster_id for c in got.clusters] == [f"S.C{i:02d}" for i in range(1, len(order) + 1)]


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = rng.integers(0, 3, 30)
    d = 1 - x @ x.T
    s = []
    for i in range(30):
        mean = {c: d[i][(label == c) & (np.arange(30) != i)].mean() for c in range(3)}
        b = min(v for c, v in mean.items() if c != label[i])
        s.append((b - mean[label[i]]) / max(b, mean[label[i]]))
    rows = spark.createDataFrame([("a", str(int(c)), str(i), [float(v) for v in x[i]]) for i, c in enumerate(label)], "sink string, cluster string, work_id string, vector array<double>")
    assert split.silhouette(rows).first().silhouette == pytest.approx(np.mean(s))


def record(i, title="research", source=None, topic="T1", part="train"):
    return {"id": f"W{i}", "doi": None, "source_id": source, "metadata": {"title": title, "source": source or "", "type": "article", "keywords": []}, "truth": {"primary_topic_id": topic, "topic_ids": [topic]}, "partition": part, "split_group": f"g{i}", "abstract": "never read"}


def test_dataset_readers(spark, tmp_path):
    path = tmp_path / "d.json"
    write = lambda **d: path.write_text(json.dumps({"schema_version": 1} | d))
    write(kind="place_dataset", records=[record(1, "a"), record(2, "b", part="test")])
    rows = readers.read_place(spark, str(path)).rows
    assert rows.count() == 2 and "abstract" not in rows.columns
    for bad in ([record(1, "a", "S"), record(2, "b", "S", part="test")], [record(1), record(1)], [record(1, part="other")], []):
        write(kind="place_dataset", records=bad)
        with pytest.raises(InputError):
            readers.read_place(spark, str(path))
    sink = {"topic_id": "T1", "topic": "t", "works_count": 5, "records": [record(1)]}
    write(kind="sink_samples", seed=42, sinks=[sink])
    assert readers.read_sinks(spark, str(path)).rows.count() == 1
    write(kind="sink_samples", seed=42, sinks=[sink | {"topic_id": "T2"}])
    with pytest.raises(InputError, match="absent"):
        readers.read_sinks(spark, str(path))
    with pytest.raises(InputError, match="taxonomy"):
        write(kind="sink_samples", seed=42, taxonomy_sha256="x", sinks=[sink])
        readers.read_sinks(spark, str(path), "y")


def test_review_gaps(spark):
    top = spark.createDataFrame([("T1",), ("T2",)], "topic_id string")
    notes = spark.createDataFrame([("T1", "unresolved", "why", "x"), ("T3", "odd", "", "y")], "topic_id string, judgment string, reason string, input_sha256 string")
    assert {tuple(r) for r in validate.review_gaps(top, notes, "x").collect()} == {("T2", "not reviewed"), ("T3", "not in the top"), ("T3", "unknown judgment")}


def test_only_pairs_that_can_be_frequent_are_counted(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i:02d}" for i in range(60)]
    texts = [(f"W{i}", s, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(80) for s in ("a", "b")] + [("W1", "a", "w00 w01 w00 w01"), ("W900", "c", "w01 w02"), ("W901", "c", None)]
    docs = spark.createDataFrame(texts, "work_id string, sink string, text string")
    sizes, store = {}, split.store
    monkeypatch.setattr(split, "store", lambda df, label: (lambda kept: (sizes.__setitem__(label, kept.count()), kept)[1])(store(df, label)))
    have = {(r.sink, r.term): (r.df, r.cf) for r in split.vocabulary(split.store(split.words_of(docs, "text", [], "sink"), "texts"), most=20).collect()}
    terms, every = {}, set()
    for _, sink, text in texts:
        w = (text or "").split()
        grams = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
        every |= {(sink, g) for g in grams if " " in g}
        for g in set(grams):
            df, cf = terms.get((sink, g), (0, 0))
            terms[sink, g] = df + 1, cf + grams.count(g)
    n = {s: sum(t[1] == s for t in texts) for s in "abc"}
    fit = {k: v for k, v in terms.items() if 2 <= v[0] <= 0.95 * n[k[0]]}
    want = {k: fit[k] for s in "abc" for k in sorted((k for k in fit if k[0] == s), key=lambda k: (-fit[k][1], k[1]))[:20]}
    assert have == want
    assert sizes["often"] < len(every) / 10
    weights = split.tfidf(docs, "text", [], most=20)
    assert weights._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    squares = weights.groupBy("sink", "work_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert squares and all(abs(r.s - 1) < 1e-9 for r in squares)
