"""The placement audit: worked examples, brute force, and what must not matter."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxolens.functions import exact
from taxolens.functions.text import fold_phrase
from taxolens.operators import audit, nearest
from taxolens.operators.validate import InputError
from taxolens.sources import readers

PREFIX = "https://openalex.org/"


def topic(number, keywords, subfield=1, field=1, domain=1, **more):
    up = lambda level, n: {"id": f"{PREFIX}{level}s/{n}", "display_name": f"{level} {n}"}
    return {"id": f"{PREFIX}T{number}", "display_name": f"about {number}", "keywords": keywords, "works_count": number, "subfield": up("subfield", subfield), "field": up("field", field), "domain": up("domain", domain)} | more


#: Boats in subfield 1, but T1 is filed with the bakers in 2; T6 stands alone.
SMALL = [
    topic(1, ["tide", "keel", "sail"], 2), topic(2, ["tide", "keel", "sail", "rope"]), topic(3, ["tide", "keel"]),
    topic(4, ["sail", "oven"]), topic(5, ["oven", "yeast"], 2), topic(6, ["quartz"]),
]


def load(spark, folder, topics, **changes):
    path = folder / "topics.json"
    path.write_text(json.dumps({"schema_version": 1, "topic_count": len(topics), "topics": topics} | changes))
    return readers.read_snapshot(spark, str(path))


def judged(doc, **options):
    return {r.topic_id.rsplit("/", 1)[-1]: r for r in audit.rank(audit.assess(doc.rows, **options)).collect()}


def test_boats_among_bakers(spark, tmp_path):
    doc = load(spark, tmp_path, SMALL)
    rows = judged(doc, k=4)
    # T1: 3/4, 2/3 and 1/4 from T2 to T4, all of subfield 1: strength (5/3)/4, margin 1
    assert (rows["T1"].rank, rows["T1"].status, rows["T1"].plurality_share, rows["T1"].stated_share) == (1, "review", 1, 0)
    assert rows["T1"].score == pytest.approx(5 / 12)
    # T4: 1/4 and 1/3 for subfield 2 against 1/5 for its own
    assert (rows["T4"].rank, rows["T4"].status) == (2, "review") and rows["T4"].score == pytest.approx(23 / 240)
    # T2: one vote of 3/4 against two of 7/10 together is a majority without support
    assert rows["T2"].status == "insufficient_evidence" and rows["T2"].margin == pytest.approx(0.05 / 1.45) and rows["T2"].score == 0
    assert {t: rows[t].neighbour_count for t in rows} == {"T1": 3, "T2": 3, "T3": 2, "T4": 3, "T5": 1, "T6": 0}
    assert {rows[t].status for t in ("T3", "T5", "T6")} == {"insufficient_evidence"}
    assert (rows["T6"].plurality_id, rows["T6"].strength, rows["T6"].stated_share) == (None, 0, 0)
    near = {(r.src[-1], r.dst[-1]): r for r in audit.shared_keywords(audit.neighbours(doc.rows, 4), doc.rows).collect()}
    assert [near["1", d].similarity for d in "234"] == pytest.approx([3 / 4, 2 / 3, 1 / 4])
    assert [near["1", d].shared_keywords for d in "24"] == [["keel", "sail", "tide"], ["sail"]]
    assert len(near) == 12 and all((b, a) in near and a != b for a, b in near)
    assert {r.status: r.topics for r in audit.summary(audit.assess(doc.rows, 4)).collect()} == {"review": 2, "consistent": 0, "insufficient_evidence": 4}


def test_a_level_changes_verdicts_only(spark, tmp_path):
    doc = load(spark, tmp_path, SMALL)
    fields = judged(doc, k=4, level="field")
    assert {t: r.status for t, r in fields.items() if r.neighbour_count >= 3} == {"T1": "consistent", "T2": "consistent", "T4": "consistent"}
    parents = {r.topic_id[-2:]: r for r in audit.evidence(doc.rows, 4).collect()}
    assert [n.topic_id for n in parents["T1"].neighbours] == ["T2", "T3", "T4"]
    assert [(d.id[-1], d["count"]) for d in parents["T1"].parents.subfield] == [("1", 3), ("2", 0)] and len(parents["T1"].parents.field) == 1


def test_neither_order_nor_titles_nor_sizes_matter(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)]
    topics = [topic(i, rng.sample(words, rng.randint(0, 6)), i % 3, i % 3 % 2) for i in range(40)]
    verdict = lambda t: {k: (r.rank, r.score, r.status, r.plurality_id) for k, r in judged(load(spark, tmp_path, t)).items()}
    first = verdict(topics)
    changed = [t | {"display_name": "w1 w2 w3", "works_count": 10**12 + i, "keywords": rng.sample(t["keywords"], len(t["keywords"])) + t["keywords"][:1]} for i, t in enumerate(topics)]
    rng.shuffle(changed)
    assert verdict(changed) == first


def test_a_misfiled_topic_is_among_the_first(spark, tmp_path):
    """300 topics of ten subjects: one filed with another subject, two where they belong."""
    rng = random.Random(3)
    pool = {s: [f"s{s}-{i}" for i in range(14)] for s in range(10)}
    common = [f"c{i}" for i in range(60)]
    made = lambda n, s, filed: topic(n, rng.sample(pool[s], 5) + rng.sample(common, 3), filed)
    topics = [made(i, s := i % 10, s if rng.random() < 0.9 else rng.randrange(10)) for i in range(300)]
    topics += [made(900, 4, 8), made(901, 4, 4), made(902, 7, 7)]
    rows = judged(load(spark, tmp_path, topics))
    assert rows["T900"].rank <= 50 and rows["T900"].plurality_id.endswith("/4")
    assert rows["T901"].rank > 50 and rows["T902"].rank > 50 and rows["T901"].status == "consistent"


def test_equal_shares(spark, tmp_path):
    """Two neighbours of each of two parents: the stated one holds; else the lesser id."""
    sides = [topic(2, ["left"], 7), topic(3, ["left"], 7), topic(4, ["right"], 5), topic(5, ["right"], 5)]
    own = judged(load(spark, tmp_path, [topic(1, ["left", "right"], 7), *sides]))["T1"]
    assert (own.plurality_id[-1], own.status, own.score, own.margin) == ("7", "consistent", 0, 0)
    other = judged(load(spark, tmp_path, [topic(1, ["left", "right"], 9), *sides]))["T1"]
    assert (other.plurality_id[-1], other.status, other.margin) == ("5", "review", 0.5)


@pytest.mark.parametrize(("limits", "posting", "k"), [((256,), 4096, 3), ((1, 2, 4), 3, 1), ((3,), 2, 3), ((2, 8, 16), 5, 3), ((3,), 5, 200)])
def test_nearest_sets_equal_all_pairs(spark, monkeypatch, limits, posting, k):
    monkeypatch.setattr(nearest, "LIMITS", limits)
    monkeypatch.setattr(nearest, "POSTING", posting)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    # skewed words, equal sets, and sets alone
    sets = {i: {words[min(int(rng.expovariate(0.12)), 39)] for _ in range(rng.randint(1, 9))} for i in range(70)}
    sets |= {100 + i: {"w0", "w1", "w2"} for i in range(6)} | {200: {"alone"}, 201: {"w0"}, 202: {"w0"}}
    rows = spark.createDataFrame([(i, len(s), w) for i, s in sets.items() for w in s], "id long, n long, keyword string")
    want = set()
    for a, x in sets.items():
        found = sorted((-len(x & y) / len(x | y), b) for b, y in sets.items() if a != b and x & y)
        want |= {(a, b, len(x & sets[b]), len(x | sets[b]), -s, place) for place, (s, b) in enumerate(found[:k], 1)}
    assert {tuple(r) for r in nearest.nearest(rows, k).collect()} == want
    pairs = {(a, b, len(x & y)) for a, x in sets.items() for b, y in sets.items() if a < b and x & y}
    assert {tuple(r) for r in nearest.overlaps(rows).collect()} == pairs


def test_nearest_of_nothing(spark):
    assert nearest.nearest(spark.createDataFrame([], "id long, n long, keyword string"), 3).isEmpty()
    alone = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id long, n long, keyword string")
    assert nearest.nearest(alone, 3).isEmpty() and nearest.overlaps(alone).isEmpty()


def test_frequent_words_are_not_expanded_where_bounds_have_met(spark, monkeypatch):
    """Pairs of equal sets are closed by their rare words; the word of all is left out."""
    monkeypatch.setattr(nearest, "LIMITS", (4,))
    asked = []
    plain = nearest.expanded
    monkeypatch.setattr(nearest, "expanded", lambda rows, *a, **b: asked.append(rows) or plain(rows, *a, **b))
    rows = spark.createDataFrame([(i, 4, w) for i in range(60) for w in (f"a{i // 2}", f"b{i // 2}", f"c{i // 2}", "all")], "id long, n long, keyword string")
    found = nearest.nearest(rows, 1).collect()
    assert {(r.src, r.dst, r.similarity) for r in found} == {(i, i ^ 1, 1.0) for i in range(60)}
    assert asked[0].where("keyword = 'all'").isEmpty() and asked[1].isEmpty()


def test_phrases_are_normalised(spark, tmp_path):
    doc = load(spark, tmp_path, [topic(1, ["Große\tStraße ", "GROSSE  STRASSE", "ﬁne ＡＲＴ"]), topic(2, ["grosse strasse", "fine art"]), topic(3, ["große", "straße"])])
    assert {(r.topic_id[-2:], r.keyword) for r in audit.memberships(doc.rows).where("topic_id like '%T1'").collect()} == {("T1", "grosse strasse"), ("T1", "fine art")}
    assert {(r.src[-1], r.dst[-1], r.similarity) for r in audit.neighbours(doc.rows).collect()} == {("1", "2", 1.0), ("2", "1", 1.0)}
    assert fold_phrase(" ΣΊΓΜΑΣ\u001d x ") == "σίγμασ x"


def test_salted_join_gives_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "HOT_POSTING", 2)
    members = audit.memberships(load(spark, tmp_path, SMALL).rows)
    assert sorted(audit.overlaps(members, True).collect()) == sorted(audit.overlaps(members, False).collect())
    counts = {r.shared: r.pairs for r in audit.overlap_counts(load(spark, tmp_path, SMALL).rows).collect()}
    assert counts == {r["shared"]: r["count"] for r in audit.overlaps(members).groupBy("shared").count().collect()}


#: Which topic, where in it, and what stands there instead.
DEFECTS = [
    (2, "id", f"{PREFIX}X3"), (3, "id", f"{PREFIX}T"), (4, "display_name", " \t"), (0, "keywords", ["tide", " "]), (1, "keywords", "tide"), (5, "works_count", -7), (5, "works_count", "many"),
    (2, "domain", {"id": f"{PREFIX}domains/1", "display_name": ""}), (3, "field", {"id": f"{PREFIX}subfields/1", "display_name": "field 1"}), (4, "subfield", None),
    (2, "subfield", {"id": f"{PREFIX}subfields/1", "display_name": "Boats"}), (1, "field", {"id": f"{PREFIX}fields/9", "display_name": "field 9"}),
]


@pytest.mark.parametrize(("at", "key", "value"), DEFECTS)
def test_defects_are_refused(spark, tmp_path, at, key, value):
    with pytest.raises(InputError):
        load(spark, tmp_path, [t | {key: value} if i == at else t for i, t in enumerate(SMALL)])


def test_documents_that_are_no_snapshot(spark, tmp_path):
    for topics, changes in ((SMALL, {"topic_count": 5}), (SMALL, {"schema_version": 3}), (SMALL + SMALL[3:4], {}), ([], {})):
        with pytest.raises(InputError):
            load(spark, tmp_path, topics, **changes)
    (tmp_path / "cut.json").write_text('{"topics": [')
    for name in ("cut.json", "absent.json"):
        with pytest.raises(InputError):
            readers.read_snapshot(spark, str(tmp_path / name))
    for k, level in ((0, "field"), (101, "field"), (True, "field"), (3, "topic")):
        with pytest.raises(ValueError):
            audit.check_parameters(k, level)


def copied(spark, sets, copies, seed):
    """Topics of ``sets``, each ``copies`` times, in any order, and their sets by id."""
    ids = [f"{PREFIX}T{n}" for n in range(len(sets) * copies)]
    random.Random(seed).shuffle(ids)
    own = dict(zip(ids, sets * copies))
    return spark.createDataFrame([(t, sorted(w)) for t, w in own.items()], "topic_id string, keywords array<string>"), {t: w for t, w in own.items() if w}


@pytest.mark.parametrize("copies,k", [(3, 4), (4, 3), (2, 1)])
def test_equal_sets_are_met_once(spark, monkeypatch, copies, k):
    draw = random.Random(copies)
    sets = [frozenset(draw.sample("abcdefghijkl", draw.randint(1, 5))) for _ in range(12)] + [frozenset(), frozenset("z")]
    topics, own = copied(spark, sets, copies, k)
    met = []
    plain = nearest.expanded
    monkeypatch.setattr(nearest, "expanded", lambda rows, *a, **b: met.append(rows.select("id").distinct().count()) or plain(rows, *a, **b))
    have = {tuple(r) for r in audit.neighbours(topics, k).collect()}
    want = set()
    for a, x in own.items():
        near = sorted((-len(x & y) / len(x | y), b, len(x & y), len(x | y)) for b, y in own.items() if a != b and x & y)
        want |= {(a, b, shared, union, -low, i + 1) for i, (low, b, shared, union) in enumerate(near[:k])}
    assert have == want
    assert max(met) <= len(set(sets)) and (max(met) == 0 or copies <= k)
    pairs = {(a, b, len(x & y)) for a, x in own.items() for b, y in own.items() if a != b and x & y}
    assert {tuple(r) for r in audit.overlaps(audit.memberships(topics)).collect()} == pairs
    counts = {n: sum(p[2] == n for p in pairs) for n in {p[2] for p in pairs}}
    assert {r.shared: r.pairs for r in audit.overlap_counts(topics).collect()} == counts


@pytest.mark.parametrize(("dense", "most"), [(1 << 24, 1 << 20), (0, 1 << 20), (1 << 24, 7), (0, 1)])
def test_a_block_meets_all_others_once(monkeypatch, dense, most):
    """Pairs counted in flat arrays, by place or by search, in slices, and set by set where
    one set has more pairs than a slice."""
    monkeypatch.setattr(nearest, "DENSE", dense)
    draw = np.random.default_rng(5)
    sets = [np.unique(draw.integers(0, 30, draw.integers(0, 9))) for _ in range(50)]
    sets[7] = np.arange(40)
    flat = lambda s: (np.array([len(x) for x in s]), np.concatenate(s).astype(np.int32))
    ids, n, size = np.arange(30) * 3, np.array([len(x) for x in sets[:30]]), np.ones(30, np.int64)
    block = nearest.Block(ids, n, size, *flat(sets[:30]))
    found = [x for part in block.met(*flat(sets), lambda: most) for x in zip(*[a.tolist() for a in part])]
    want = [(a, b, len(np.intersect1d(sets[a], sets[b]))) for a in range(30) for b in range(50)]
    assert len(set(found)) == len(found) and sorted(found) == [x for x in want if x[2]]
    best = nearest.Best(block, 3)
    for own, other, shared in block.met(*flat(sets[:30]), lambda: most):
        best.offer(own, ids[other], n[other], shared)
    near = {}
    for a, b, s in want:
        if s and a != b < 30:
            near.setdefault(3 * a, []).append((-s / (n[a] + n[b] - s), 3 * b))
    assert sorted(zip(*[best.rows()[i].tolist() for i in (0, 5, 1)])) == [(a, i, b) for a in sorted(near) for i, (_, b) in enumerate(sorted(near[a])[:3], 1)]


def test_pairs_are_not_shuffled(spark, tmp_path):
    """What a task finds it gives on: no exchange or grouping of pairs follows (keyword_overlap)."""
    for salted in (True, False):
        plan = audit.overlaps(audit.memberships(load(spark, tmp_path, SMALL).rows), salted)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Aggregate(keys=[src" not in plan and "hashpartitioning(src" not in plan.split("MapInArrow")[0]


def test_counts_take_sums_from_tasks(spark):
    """A task gives one row a number of common keywords, however many pairs it finds (keyword_overlap_counts)."""
    topics = spark.createDataFrame([(f"T{i:03}", ["all", f"w{i % 10}", f"v{i}"]) for i in range(120)], "topic_id string, keywords array<string>")
    sets = audit.classes(audit.keyword_sets(topics).sets)[1]
    found = nearest.expanded(*[sets.selectExpr("class id", "n", "size", "words")] * 2, "counts")
    assert found.count() <= 3 * found.rdd.getNumPartitions()
    assert {r.shared: r.pairs for r in audit.overlap_counts(topics).collect()} == {1: 120 * 108, 2: 120 * 11}


def test_rounds_are_for_pairs_of_frequent_words(spark, monkeypatch):
    """One word above the limit that few pairs have is no reason for a round (jaccard_topk, audit_*)."""
    monkeypatch.setattr(nearest, "LIMITS", (4,))
    asked, plain = [], nearest.expanded
    monkeypatch.setattr(nearest, "expanded", lambda rows, *a, **b: asked.append(rows) or plain(rows, *a, **b))
    rows = spark.createDataFrame([(i, 3 if i < 5 else 2, w) for i in range(60) for w in [f"a{i // 4}", f"b{i // 4}"] + ["five"] * (i < 5)], "id long, n long, keyword string")
    found = {(r.src, r.dst): (r.shared, r.place) for r in nearest.nearest(rows, 2).collect()}
    assert len(asked) == 1 and len(found) == 120 and found[4, 5] == (2, 1) and found[0, 1] == (3, 1)


def test_sums_of_shares_are_exact(spark):
    draw = random.Random(4)
    groups = [[draw.randint(1, 40) / draw.randint(40, 90) for _ in range(draw.randint(1, 100))] for _ in range(60)] + [[draw.random() * 2.0 ** -draw.randint(0, 40) for _ in range(draw.randint(1, 100))] for _ in range(60)]
    rows = spark.createDataFrame([(g, v) for g, values in enumerate(groups) for v in values], "g int, v double")
    sums = rows.groupBy("g").agg(*[F.sum(x).alias(c) for c, x in zip("abc", exact.share_limbs(F.col("v")))])
    assert {r.g: r.s for r in sums.select("g", exact.shares_sum(*map(F.col, "abc")).alias("s")).collect()} == {g: math.fsum(v) for g, v in enumerate(groups)}


def test_shares_of_levels_need_one_look(spark, tmp_path):
    """All levels at once are what each is alone; topics without a stated parent, and
    neighbours that are no topics, keep their similarity (parent_shares, plurality_parent)."""
    doc = load(spark, tmp_path, SMALL)
    near = audit.neighbours(doc.rows, 4)
    every = audit.parent_shares(near, doc.rows)
    for level in audit.LEVELS:
        assert sorted(every.where(F.col("level") == level).drop("level").collect(), key=str) == sorted(audit.parent_shares(near, doc.rows, level).collect(), key=str)
    nameless = doc.rows.where("topic_id not like '%T4'").withColumn("subfield_id", F.when(~F.col("topic_id").endswith("T2"), F.col("subfield_id")))
    found = {(r.topic_id[-2:], r.parent_id and r.parent_id[-1]): (r.share, r["count"], r.own, r.place) for r in audit.parent_shares(near, nameless, "subfield").collect()}
    # T1: 3/4 from T2 without a parent, 2/3 from T3, 1/4 from T4, which is no topic; T2 has no parent of its own
    total = math.fsum([3 / 4, 2 / 3, 1 / 4])
    assert found["T1", None] == (0.75 / total, 1, None, 1) and found["T1", "1"] == ((2 / 3) / total, 1, False, 2) and found["T1", "2"] == (0, 0, True, 3)
    assert found["T2", None] == (0, 0, True, 3) and found["T2", "2"][2] is None and ("T4", "1") not in found
