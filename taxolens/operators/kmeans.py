"""k-means over many groups, numbers of clusters and starts at once, as grouped sums.

Works lie in blocks, rows of at most some ``BLOCK`` works of a group in sparse form. A step
joins the blocks of a group with the centres of its runs (a number of clusters and a start),
finds the nearest centres of a block's works in a task, and gives the block's sums by
cluster; Spark adds the sums of all blocks. Sums are in fixed point, so they are the same
in any order and a run ends in the same clusters every time. A run is over when no work
has changed its cluster, which sums of hashes of works and clusters show; a group that is
one block takes all its steps where it lies.

Starts come from k-means||: rounds that draw works in proportion to their squared distance
from those drawn before (a race of exponential times from hashes, so a draw is the least
few of a grouped order), weighted by the works nearest to each and clustered themselves.

Centres are means; a centre without works stays where it was. Equal distances go to the
cluster of the least number. Works without features are not clustered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxolens.operators.components import store
from taxolens.session import ship

BLOCK, STARTS, MOST_STEPS = 1024, 10, 100
#: Rounds of drawing, the first at even odds, and works drawn in each for a cluster wanted.
ROUNDS, OVERSAMPLED = 3, 2
#: Runs that meet a block in one row.
RUNS = 10
#: Sums are in units of 2**-36: a cluster holds 2**26 works of unit length.
UNIT = float(1 << 36)
# Entries of a cluster beside its features: how many works it has, their squared
# distances, the hash of its works, that of the step before (in cluster 0), where it was.
COUNT, COST, NOW, BEFORE, OLD = -1, -2, -3, -4, 1 << 30
SUMS = "sink string, k int, start int, cluster int, f int, v long"
_ENTRY = "array<struct<cluster:int,f:int,v:bigint>>"


def blocks(works: DataFrame) -> DataFrame:
    """(sink, block, whole, width, works) of ``works``: sink, work_id, features (array of
    f string, x). Features are numbered within their sink; ``whole``: the only block."""
    given = works.where(F.size("features") > 0)
    long = given.select("sink", "work_id", F.inline("features"))
    names = long.select("sink", "f").distinct().withColumn("i", (F.row_number().over(Window.partitionBy("sink").orderBy("f")) - 1).cast("int"))  # a vocabulary is bounded
    each = F.array_sort(F.collect_list(F.struct("i", "x")))
    rows = long.join(names, ["sink", "f"]).groupBy("sink", "work_id").agg(each.alias("row"))
    about = names.groupBy("sink").agg(F.count(F.lit(1)).cast("int").alias("width")).join(given.groupBy("sink").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n")), "sink")
    dealt = rows.join(about, "sink").withColumn("block", F.pmod(F.xxhash64("work_id"), F.col("n")).cast("int"))
    packed = dealt.groupBy("sink", "block", "width", "n").agg(F.array_sort(F.collect_list(F.struct("work_id", "row"))).alias("works"))
    least = packed.groupBy("sink").agg(F.min("block").alias("least"))
    return store(packed.join(least, "sink").select("sink", "block", "width", (F.col("n") == 1).alias("whole"), (F.col("block") == F.col("least")).alias("first"), "works"), "blocks")


class Points:
    """The works of a block: a dense matrix where that is small, else rows of features."""

    def __init__(self, works: pa.Array, width: int):
        """``works``: structs of work_id and row, itself structs of i and x."""
        self.ids = works.field("work_id")
        rows = works.field("row")
        flat = rows.flatten()
        n = np.diff(rows.offsets.to_numpy())
        self.n, self.width = len(works), width
        self.row, self.at, self.x = np.repeat(np.arange(self.n), n), flat.field("i").to_numpy().astype(np.int64), flat.field("x").to_numpy(zero_copy_only=False)
        self.begins = np.concatenate([[0], np.cumsum(n)])[:-1].astype(np.int64)
        self.matrix = None
        if self.n * width <= 4 * max(1, self.x.size):
            self.matrix = np.zeros((self.n, width))
            self.matrix[self.row, self.at] = self.x
        self.squares = np.bincount(self.row, self.x * self.x, self.n)

    def distances(self, centres: np.ndarray) -> np.ndarray:
        """Squared distances of all works from each centre: a column a centre."""
        if self.matrix is not None:
            product = self.matrix @ centres.T
        else:
            product = np.stack([np.add.reduceat(self.x * c[self.at], self.begins) for c in centres], 1)
        return np.maximum(0, self.squares[:, None] - 2 * product + (centres * centres).sum(1))

    def sums(self, labels: np.ndarray, k: int) -> np.ndarray:
        if self.matrix is not None:
            chosen = np.zeros((k, self.n))
            chosen[labels, np.arange(self.n)] = 1
            return chosen @ self.matrix
        return np.bincount(labels[self.row] * self.width + self.at, self.x, k * self.width).reshape(k, self.width)

    def hashes(self) -> np.ndarray:
        """31 bits of a hash of each id."""
        return np.array([_hash(i.encode()) for i in self.ids.to_pylist()], np.int64)


def _hash(data: bytes) -> int:
    """31 bits of a hash."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little") >> 1


def _centres(entries: pa.Array, k: int, width: int) -> tuple[np.ndarray, int]:
    """Centres of a run from its entries, and the hash of its works."""
    cluster, f, v = (entries.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    n, sums, old = np.zeros(k), np.zeros((k, width)), np.zeros((k, width))
    n[cluster[f == COUNT]] = v[f == COUNT]
    inner, past = (f >= 0) & (f < OLD), f >= OLD
    sums[cluster[inner], f[inner]] = v[inner] / UNIT
    old[cluster[past], f[past] - OLD] = v[past] / UNIT
    return np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], old), int(v[f == NOW].sum())


def _long(sink: str, k: int, start: int, cluster: np.ndarray, f: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    n = len(f)
    columns = [pa.array([sink] * n, pa.string()), pa.array(np.full(n, k), pa.int32()), pa.array(np.full(n, start), pa.int32()), pa.array(cluster, pa.int32()), pa.array(f, pa.int32()), pa.array(v, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["sink", "k", "start", "cluster", "f", "v"])


def _step(batches: Iterator[pa.RecordBatch], most: int = MOST_STEPS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            sink, width, whole, first = (batch.column(c)[r].as_py() for c in ("sink", "width", "whole", "first"))
            points = Points(batch.column("works")[r].values, width)
            hashes = points.hashes()
            for run in batch.column("runs")[r].values:
                k, start = run["k"].as_py(), run["start"].as_py()
                centres, before = _centres(run["entries"].values, k, width)
                for _ in range(most if whole else 1):
                    d = points.distances(centres)
                    labels = d.argmin(1)
                    n, sums = np.bincount(labels, minlength=k), points.sums(labels, k)
                    now, last = int(((labels + 1) * hashes % (1 << 31)).sum()), before
                    past, before = centres, now
                    if now == last:
                        break
                    centres = np.where(n[:, None] > 0, np.round(sums * UNIT) / UNIT / np.maximum(1, n)[:, None], centres)
                fixed = np.round(sums * UNIT).astype(np.int64)
                c, f = np.nonzero(fixed)
                empty = np.flatnonzero(n == 0) if first else np.zeros(0, np.int64)
                kept = np.round(past[empty] * UNIT).astype(np.int64)
                e, g = np.nonzero(kept)
                cost = np.round(np.bincount(labels, d[np.arange(points.n), labels], k) * UNIT).astype(np.int64)
                every = np.arange(k)
                yield _long(
                    sink, k, start, np.concatenate([c, every, every, [0], [0] * first, empty[e]]), np.concatenate([f, np.full(k, COUNT), np.full(k, COST), [NOW], [BEFORE] * first, g + OLD]),
                    np.concatenate([fixed[c, f], n, cost, [now], [last] * first, kept[e, g]]).astype(np.int64),
                )


def _met(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """Blocks with the runs of their sink, some to a row. ``runs``: sink, k, start, entries."""
    own = runs.withColumn("deal", F.pmod(F.xxhash64("k", "start"), F.lit(RUNS)))
    together = own.groupBy(F.col("sink").alias("of"), "deal").agg(F.sort_array(F.collect_list(F.struct("k", "start", "entries"))).alias("runs"))
    return packed.join(together, F.col("sink") == F.col("of")).drop("of", "deal")


def _added(sums: DataFrame) -> DataFrame:
    """(sink, k, start, entries, cost, over) from the sums of all blocks."""
    summed = sums.groupBy("sink", "k", "start", "cluster", "f").agg(F.sum("v").alias("v"))
    of = lambda f: F.sum(F.when(F.col("f") == f, F.col("v")))
    return summed.groupBy("sink", "k", "start").agg(F.collect_list(F.struct("cluster", "f", "v")).cast(_ENTRY).alias("entries"), of(COST).alias("cost"), (of(NOW) == of(BEFORE)).alias("over"))


def step(packed: DataFrame, runs: DataFrame, most: int = MOST_STEPS) -> DataFrame:
    """One step of Lloyd's of all ``runs``: nearest centres, then new means."""
    return _added(_met(packed, runs.select("sink", "k", "start", "entries")).mapInArrow(lambda b: _step(b, most), SUMS))


def labels(packed: DataFrame, runs: DataFrame) -> DataFrame:
    """(sink, k, work_id, cluster) of the nearest centres of ``runs``."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                width = batch.column("width")[r].as_py()
                points = Points(batch.column("works")[r].values, width)
                for run in batch.column("runs")[r].values:
                    k = run["k"].as_py()
                    found = points.distances(_centres(run["entries"].values, k, width)[0]).argmin(1)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("sink")[r].as_py()] * points.n, pa.string()), pa.array(np.full(points.n, k), pa.int32()), points.ids, pa.array(found, pa.int32())], ["sink", "k", "work_id", "cluster"])

    return _met(packed, runs.select("sink", "k", "start", "entries")).mapInArrow(near, "sink string, k int, work_id string, cluster int")


def from_labels(packed: DataFrame, members: DataFrame) -> DataFrame:
    """Runs (start 0) whose centres are the means of ``members``: sink, k, work_id, cluster."""
    rows = packed.select("sink", F.explode("works").alias("w")).select("sink", "w.work_id", "w.row").join(members, ["sink", "work_id"])
    entry = lambda f, v: F.struct(f.cast("int").alias("f"), v.cast("long").alias("v"))
    each = F.concat(F.transform("row", lambda e: entry(e.i, F.round(e.x * UNIT))), F.array(entry(F.lit(COUNT), F.lit(1))))
    sums = rows.select("sink", "k", "cluster", F.explode(each).alias("e")).groupBy("sink", "k", "cluster", "e.f").agg(F.sum("e.v").alias("v"))
    return sums.groupBy("sink", "k").agg(F.collect_list(F.struct("cluster", "f", "v")).cast(_ENTRY).alias("entries")).withColumn("start", F.lit(0))


# ---- starts ------------------------------------------------------------------------------

DRAWN = "sink string, start int, time double, work_id string, row array<struct<i:int,x:double>>"


def _draw(batches: Iterator[pa.RecordBatch], seed: int, round_: int, starts: int, most: int) -> Iterator[pa.RecordBatch]:
    """The first few of a block's works in the race of each start."""
    for batch in batches:
        for r in range(batch.num_rows):
            sink, width = batch.column("sink")[r].as_py(), batch.column("width")[r].as_py()
            works = batch.column("works")[r].values
            points = Points(works, width)
            drawn = {x["start"].as_py(): x["rows"].values for x in batch.column("drawn")[r].values} if "drawn" in batch.schema.names else {}
            ids = [i.encode() for i in points.ids.to_pylist()]
            for start in range(starts):
                even = np.array([_hash(b"%d:%d:%d:" % (seed, start, round_) + i) for i in ids])
                time = -np.log((even + 0.5) / (1 << 31))
                if start in drawn:
                    centres = np.zeros((len(drawn[start]), width))
                    rows = drawn[start]
                    which = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
                    centres[which, rows.flatten().field("i").to_numpy()] = rows.flatten().field("x").to_numpy(zero_copy_only=False)
                    far = points.distances(centres).min(1)
                    time = np.where(far > 1e-12, time / np.maximum(far, 1e-12), np.inf)
                order = np.lexsort((np.arange(points.n), time))[:most]
                order = order[np.isfinite(time[order])]
                if order.size:
                    yield pa.RecordBatch.from_arrays([pa.array([sink] * order.size, pa.string()), pa.array(np.full(order.size, start), pa.int32()), pa.array(time[order]), points.ids.take(pa.array(order)), works.field("row").take(pa.array(order))], ["sink", "start", "time", "work_id", "row"])


def _first_centres(row: pa.RecordBatch, r: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Starts of all numbers of clusters from one start's drawn works: k-means++ and a few
    steps over the drawn works, each weighing as many works as are nearest to it."""
    sink, start, width = (row.column(c)[r].as_py() for c in ("sink", "start", "width"))
    rows, weight = row.column("rows")[r].values, row.column("weights")[r].values.to_numpy().astype(float)
    ks = row.column("ks")[r].as_py()
    points = np.zeros((len(rows), width))
    which = np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))
    points[which, rows.flatten().field("i").to_numpy()] = rows.flatten().field("x").to_numpy(zero_copy_only=False)
    weight = np.maximum(weight, 1e-9)
    for k in ks:
        rng = np.random.default_rng([seed, k, start])
        chosen = [int(rng.choice(len(points), p=weight / weight.sum()))]
        while len(chosen) < k:
            far = ((points[:, None] - points[chosen][None]) ** 2).sum(2).min(1) * weight
            chosen.append(int(rng.choice(len(points), p=far / far.sum())) if far.sum() > 0 else int(rng.integers(len(points))))
        centres = points[chosen]
        for _ in range(5):
            near = ((points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)).argmin(1)
            shares = np.where(near == np.arange(k)[:, None], weight, 0.0)
            n, sums = shares.sum(1), shares @ points
            centres = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1)[:, None], centres)
        fixed = np.round(centres * UNIT).astype(np.int64)
        c, f = np.nonzero(fixed)
        yield _long(sink, k, start, c, f + OLD, fixed[c, f])


def starts(packed: DataFrame, ks: DataFrame, seed: int, count: int = STARTS) -> DataFrame:
    """(sink, k, start, entries): first centres of ``count`` runs for each number of
    clusters in ``ks`` (sink, ks array<int>)."""
    most = F.array_max("ks")
    wanted = packed.join(ks.select(F.col("sink").alias("of")), F.col("sink") == F.col("of"), "left_semi")
    top = int(ks.agg(F.max(most)).first()[0] or 1)
    drawn = None
    take = OVERSAMPLED * top
    for round_ in range(ROUNDS):
        asked = wanted
        if drawn is not None:
            rows = drawn.groupBy("sink", "start").agg(F.sort_array(F.collect_list(F.struct("work_id", "row"))).alias("w"))
            held = rows.groupBy(F.col("sink").alias("of")).agg(F.collect_list(F.struct("start", F.col("w.row").alias("rows"))).alias("drawn"))
            asked = wanted.join(held, F.col("sink") == F.col("of")).drop("of")
        raced = asked.mapInArrow(lambda b, round_=round_: _draw(b, seed, round_, count, take), DRAWN)
        order = Window.partitionBy("sink", "start").orderBy("time", "work_id")
        new = raced.withColumn("place", F.row_number().over(order)).where(F.col("place") <= take).select("sink", "start", "work_id", "row")
        drawn = store(new if drawn is None else drawn.unionByName(new), "drawn")
    numbered = drawn.withColumn("cluster", (F.row_number().over(Window.partitionBy("sink", "start").orderBy("work_id")) - 1).cast("int"))
    k = numbered.groupBy("sink", "start").agg(F.count(F.lit(1)).cast("int").alias("k"))
    entry = numbered.select("sink", "start", "cluster", F.explode("row").alias("e")).select("sink", "start", F.struct("cluster", (F.col("e.i") + OLD).cast("int").alias("f"), F.round(F.col("e.x") * UNIT).cast("long").alias("v")).alias("e"))
    runs = entry.groupBy("sink", "start").agg(F.collect_list("e").cast(_ENTRY).alias("entries")).join(k, ["sink", "start"])
    once = step(wanted, runs, most=1)
    weights = once.select("sink", "start", F.inline("entries")).where(F.col("f") == COUNT).select("sink", "start", "cluster", F.col("v").alias("weight"))
    listed = numbered.join(weights, ["sink", "start", "cluster"]).groupBy("sink", "start").agg(F.sort_array(F.collect_list(F.struct("cluster", "row", "weight"))).alias("d"))
    about = packed.where("first").select("sink", "width").join(ks, "sink")
    asked = listed.join(about, "sink").select("sink", "start", "width", "ks", F.col("d.row").alias("rows"), F.col("d.weight").alias("weights"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                yield from _first_centres(batch, r, seed)

    first = asked.mapInArrow(run, SUMS)
    return store(first.groupBy("sink", "k", "start").agg(F.collect_list(F.struct("cluster", "f", "v")).cast(_ENTRY).alias("entries")), "starts")


def fit(works: DataFrame, ks: DataFrame, seed: int = 42, count: int = STARTS, most_steps: int = MOST_STEPS) -> DataFrame:
    """(sink, k, work_id, cluster): the labels of the best of ``count`` runs for each
    number of clusters in ``ks`` (sink, ks array<int>); ``works``: sink, work_id, features."""
    ship(works.sparkSession)
    packed = blocks(works)
    if ks.limit(1).count() == 0:
        return works.sparkSession.createDataFrame([], "sink string, k int, work_id string, cluster int")
    runs, ended = starts(packed, ks, seed, count), None
    for n in range(most_steps):
        now = store(step(packed, runs), "step")
        done = now if n == most_steps - 1 else now.where("over")
        ended = done if ended is None else ended.unionByName(done)
        runs = now.where("not over")
        if runs.isEmpty():
            break
    best = ended.groupBy("sink", "k").agg(F.min(F.struct("cost", "start", "entries")).alias("b")).select("sink", "k", F.col("b.start").alias("start"), F.col("b.entries").alias("entries"), F.col("b.cost").alias("cost"))
    return labels(packed, best)
