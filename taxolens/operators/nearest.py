"""Nearest sets by Jaccard similarity: an exact top-k join over posting lists.

Sets are rows of sorted word numbers in shared files. They are dealt over blocks; a task
turns its block round into posting lists, reads all sets past it, and gathers, sorts and
counts the numbers of both sides of its pairs in flat arrays, a bounded number at once.
So pairs are neither shuffled nor kept: a task gives the k best, the pairs themselves or
the sums its caller asks for.

Frequent keywords come last where most pairs are theirs. A round expands keywords up to a
frequency limit; what a set has found so far bounds from below the similarity of its k-th
neighbour, and the number of keywords not expanded yet bounds from above what any unseen
set can reach. A set whose bounds have met is closed: its candidates that can still be
among the k are compared whole, and its frequent keywords are never expanded. The last
round has no limit, so every set is closed at the end and the result is that of all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.operators.components import store
from taxolens.operators.ordering import places
from taxolens.session import open_shared, ship

#: A task's block holds 16 times so many sets at most, looks at 128 times so many pairs at
#: once, and at 2,048 times so many numbers of its own sets.
POSTING = 4096
#: Frequencies up to which the rounds expand keywords; then all.
LIMITS = (256, 1 << 12, 1 << 16)
#: Word numbers up to which a block finds its postings by place instead of by search.
DENSE = 1 << 24


def graded(members: DataFrame) -> DataFrame:
    """(id, n, keyword, df) of ``members`` (id, n, keyword) whose keyword others have too;
    n is the size of the set, df the number of sets with the keyword."""
    df = members.groupBy("keyword").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    return store(members.join(df, "keyword").select("id", "n", "keyword", "df"), "graded")


# -- blocks, within a task


class Block:
    """Sets turned round: the holders of each word."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, size: np.ndarray, lengths: np.ndarray, words: np.ndarray):
        self.ids, self.n, self.size = ids, n, size
        order = np.argsort(words, kind="stable")
        held = words[order]
        # a pair is one number: the block's set above, the other set in the 16 bits below
        self.holders = np.repeat(np.arange(len(ids), dtype=np.uint32) << np.uint32(16), lengths)[order]
        self.dense = len(held) > 0 and held[-1] < DENSE
        if self.dense:
            self.first = np.zeros(int(held[-1]) + 3, np.int32)
            np.cumsum(np.bincount(held, minlength=int(held[-1]) + 2), out=self.first[1:])
        else:
            self.words, first = np.unique(held, return_index=True)
            self.first = np.append(first, len(held)).astype(np.int32)

    def _postings(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the holders of each word begin, and how many they are."""
        if self.dense:
            at = np.minimum(words, len(self.first) - 2)
        elif not len(self.words):
            return np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        else:
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        low = self.first[at]
        many = self.first[at + 1] - low
        return low, many if self.dense else np.where(self.words[at] == words, many, 0)

    def met(self, lengths: np.ndarray, words: np.ndarray, most: Callable[[], int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the block, place in the batch, common words) of all pairs with a batch
        of up to 2**16 sets, some ``most`` numbers at a time; a pair is given once."""
        low, many = self._postings(words)
        some = np.flatnonzero(many)
        low, many = low[some], many[some]
        other = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)[some]
        upto = np.cumsum(many, dtype=np.int64)
        a = 0
        while a < len(some):
            done, limit = int(upto[a - 1]) if a else 0, most()
            b = int(np.searchsorted(upto, done + limit, "right"))
            if b < len(some):  # a set's pairs are counted at once
                b = int(np.searchsorted(other, other[b], "left"))
                if b <= a:
                    b = int(np.searchsorted(other, other[a], "right"))
            total = int(upto[b - 1]) - done
            if total > 4 * limit and other[a] == other[b - 1]:
                counts = np.zeros(len(self.ids), np.int64)
                for i in range(a, b):
                    counts += np.bincount(self.holders[low[i] : low[i] + many[i]] >> np.uint32(16), minlength=len(counts))
                found = np.flatnonzero(counts)
                yield found, np.full(len(found), other[a], np.int64), counts[found]
            else:
                at = np.repeat(low[a:b] - (upto[a:b] - many[a:b] - done).astype(np.int32), many[a:b])
                at += np.arange(total, dtype=np.int32)
                key = self.holders[at]
                key |= np.repeat(other[a:b], many[a:b])
                key.sort()
                new = np.empty(total, bool)
                new[:1] = True
                np.not_equal(key[1:], key[:-1], out=new[1:])
                first = np.flatnonzero(new)
                key = key[first]
                yield key >> np.uint32(16), key & np.uint32(0xFFFF), np.diff(first, append=total)
            a = b


class Best:
    """The k best of each set of a block, by similarity, then by number."""

    def __init__(self, block: Block, k: int):
        self.block, self.k = block, k
        self.least = np.full(len(block.ids), -1.0)
        self.last = np.full(len(block.ids), np.iinfo(np.int64).max)
        self.kept: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.waiting: list[list[np.ndarray]] = []
        self.many = 0

    def offer(self, own: np.ndarray, ids: np.ndarray, n: np.ndarray, shared: np.ndarray) -> None:
        union = self.block.n[own] + n - shared
        similarity = shared / union
        least = self.least[own]
        some = np.flatnonzero(similarity >= least)
        own, ids, union, similarity = own[some], ids[some], union[some], similarity[some]
        some_too = ((similarity > least[some]) | (ids < self.last[own])) & (ids != self.block.ids[own])
        self.waiting.append([own[some_too].astype(np.int64), similarity[some_too], ids[some_too], shared[some][some_too], union[some_too]])
        self.many += len(self.waiting[-1][0])
        if self.many > max(1 << 16, len(self.least) * self.k // 2):
            self.settle()

    def settle(self) -> None:
        own, similarity, ids, shared, union = (np.concatenate(x) for x in zip(self.kept, *self.waiting))
        order = np.lexsort((ids, -similarity, own))
        counts = np.bincount(own, minlength=len(self.least))
        place = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = order[place < self.k]
        self.kept = [x[order] for x in (own, similarity, ids, shared, union)]
        own, similarity, ids = self.kept[:3]
        counts = np.bincount(own, minlength=len(self.least))
        full = np.flatnonzero(counts == self.k)
        last = np.cumsum(counts)[full] - 1
        self.least[full], self.last[full] = similarity[last], ids[last]
        self.waiting, self.many = [], 0

    def rows(self) -> list[np.ndarray]:
        """src, dst, shared, all, similarity, place."""
        self.settle()
        own, similarity, ids, shared, union = self.kept
        counts = np.bincount(own, minlength=len(self.least))
        return [self.block.ids[own], ids, shared, union, similarity, np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts) + 1]


def _summed(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int]]:
    """The sum of ``values`` for each key; small sums are exact as doubles."""
    there = np.flatnonzero(np.bincount(keys))
    if len(values) and int(values.max()) * len(values) < 1 << 53:
        sums = np.bincount(keys, weights=values)
        return [(int(v), int(sums[v])) for v in there]
    return [(int(v), int(values[keys == v].sum())) for v in there]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _set_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """id, n, size, number of words, words."""
    words = batch.column("words")
    return [_longs(batch, "id"), _longs(batch, "n"), _longs(batch, "size"), words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), words.flatten().to_numpy(zero_copy_only=False).astype(np.int32)]


def _blocks(batches: Iterator[pa.RecordBatch], posting: int) -> Iterator[Block]:
    """The sets of a partition in blocks."""
    held, sets, words = [], 0, 0
    for batch in batches:
        for a in range(0, batch.num_rows, max(1, posting // 4)):
            one = _set_arrays(batch.slice(a, max(1, posting // 4)))
            if held and (sets + len(one[0]) > 16 * posting or words + len(one[4]) > 2048 * posting):
                yield Block(*map(np.concatenate, zip(*held)))
                held, sets, words = [], 0, 0
            held.append(one)
            sets, words = sets + len(one[0]), words + len(one[4])
    if held:
        yield Block(*map(np.concatenate, zip(*held)))


def _past(files: list[str], posting: int) -> Iterator[list[np.ndarray]]:
    for uri in files:
        with open_shared(uri, "rb") as f:
            for batch in pq.ParquetFile(f).iter_batches(4 * posting, use_threads=False):
                yield _set_arrays(batch)


def _ramp(most: int) -> Callable[[], int]:
    """Few numbers first, for bounds are met early."""
    now = [most // 8]

    def limit() -> int:
        now[0] = min(most, 2 * now[0] + 1)
        return now[0]

    return limit


_KINDS = {
    "best": "src long, dst long, shared long, all long, similarity double, place int",
    "pairs": "src long, n long, dst long, m long, shared long",
    "links": "src long, dst long, shared int",
    "counts": "shared long, pairs long",
}


def _given(kind: str, columns: list[np.ndarray], posting: int) -> Iterator[pa.RecordBatch]:
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in _KINDS[kind].split(", ")])
    for a in range(0, len(columns[0]), 16 * posting):
        yield pa.record_batch([pa.array(c[a : a + 16 * posting], t) for c, t in zip(columns, schema.types)], schema=schema)


def _meeting(files: list[str], kind: str, k: int, after: bool, posting: int) -> Callable:
    """The work of a task (``_KINDS``)."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, posting):
            best, counts, most = Best(block, k), {}, _ramp(128 * posting)
            for ids, n, size, lengths, words in _past(files, posting):
                for own, other, shared in block.met(lengths, words, most):
                    if kind == "best":
                        best.offer(own, ids[other], n[other], shared)
                    elif kind in ("pairs", "links"):
                        src, dst = block.ids[own], ids[other]
                        apart = np.flatnonzero(src < dst if after else src != dst)
                        src, dst, shared = src[apart], dst[apart], shared[apart]
                        yield from _given(kind, [src, dst, shared] if kind == "links" else [src, block.n[own[apart]], dst, n[other[apart]], shared], posting)
                    else:
                        for v, pairs in _summed(shared, block.size[own] * size[other]):
                            counts[v] = counts.get(v, 0) + pairs
            if kind == "best":
                yield from _given(kind, best.rows(), posting)
            elif kind == "counts":
                yield from _given(kind, [np.array(list(x), np.int64) for x in (counts, counts.values())], posting)

    return meet


# -- sets and pairs, as tables


def numbered(rows: DataFrame) -> DataFrame:
    """(keyword, word): the distinct keywords of ``rows``, numbered in their order; stored."""
    return store(places(rows.select("keyword").where("keyword is not null").distinct(), [F.col("keyword")], into="word").select("keyword", F.col("word").cast("int").alias("word")), "words")


def _gathered(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(id, n, size, words) of ``rows`` (id, n, keyword)."""
    return rows.join(words, "keyword").groupBy("id", "n").agg(F.array_sort(F.collect_set("word")).alias("words")).select("id", "n", F.lit(1).cast("long").alias("size"), "words")


def expanded(rows: DataFrame, all_rows: DataFrame, kind: str = "pairs", k: int = 1, after: bool = False, least: int = 1) -> DataFrame:
    """What sets of ``rows`` have in common with those of ``all_rows``, each (id, n, size,
    words) or members (id, n, keyword). ``kind``: the pairs (src, n, dst, m, shared) or but
    links (src, dst, shared); the k best of each set (src, dst, shared, all, similarity,
    place); or counts (shared, pairs): over ordered pairs, each set and itself among them,
    sums of the product of their sizes.
    ``after``: only pairs with a set of higher number; ``least``: blocks at least."""
    spark = rows.sparkSession
    ship(spark)
    if "words" not in rows.columns:
        words = numbered(all_rows)
        rows, all_rows = _gathered(rows, words), _gathered(all_rows, words)
    past = store(all_rows.select("id", "n", "size", "words"), "sets")
    cores = spark.sparkContext.defaultParallelism
    # full blocks, as many for each core; hashes deal nearly evenly, so a little room is left
    blocks = max(least, cores * -(-past.count() // (15 * POSTING * cores)))
    asked = rows.select("id", "n", "size", "words").repartition(max(1, blocks), "id")
    return asked.mapInArrow(_meeting(past.inputFiles(), kind, k, after, POSTING), _KINDS[kind])


def overlaps(members: DataFrame) -> DataFrame:
    """(src, dst, shared): all pairs of sets (src below dst) with common keywords."""
    rows = graded(members)
    return expanded(rows, rows, after=True).select("src", "dst", "shared")


def _similarity(shared: Column, union: Column) -> Column:
    return shared / union


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(src, dst, shared, all, similarity, place) from src, dst, n, m, shared."""
    union = F.col("n") + F.col("m") - F.col("shared")
    order = Window.partitionBy("src").orderBy(F.col("similarity").desc(), "dst")
    scored = pairs.select("src", "dst", "shared", union.alias("all"), _similarity(F.col("shared"), union).alias("similarity"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _bounded(pairs: DataFrame, k: int) -> DataFrame:
    """Candidates of a round (with ``rest``, the keywords of src not expanded) that can
    still be among the k, and ``closed``: whether no unseen set can be."""
    own = Window.partitionBy("src")
    place = F.row_number().over(own.orderBy(F.col("low").desc()))
    low = _similarity(F.col("shared"), F.col("n") + F.col("m") - F.col("shared"))
    more = F.col("shared") + F.least("rest", F.col("m") - F.col("shared"))
    high = _similarity(more, F.col("n") + F.col("m") - more)
    ranked = pairs.withColumns({"low": low, "high": high}).withColumn("at", place)
    ranked = ranked.withColumn("least", F.coalesce(F.max(F.when(F.col("at") == k, F.col("low"))).over(own), F.lit(-1.0)))
    unseen = _similarity(F.col("rest"), F.col("n"))  # a set that is all of what is left; equal ones could win by number
    return ranked.where(F.col("high") >= F.col("least")).select("src", "n", "rest", "dst", "m", "shared", ((F.col("rest") == 0) | (F.col("least") > unseen)).alias("closed"))


def _rounds(frequent: DataFrame) -> list[int]:
    """The limits of rounds: those above which half the pairs or more lie, by the number
    and frequency of keywords (many, df)."""
    pairs = F.col("many") * F.col("df").cast("double")
    sums = frequent.agg(F.sum(pairs), *[F.sum(F.when(F.col("df") > x, pairs)) for x in LIMITS]).first()
    return [x for x, above in zip(LIMITS, sums[1:]) if above and 2 * above >= sums[0]]


def frequencies(sets: DataFrame) -> DataFrame:
    """(word, df) of sets (id, n, size, words)."""
    return sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def nearest_sets(sets: DataFrame, k: int, asked: DataFrame) -> DataFrame:
    """``nearest`` for ``asked`` among stored ``sets``, both (id, n, size, words)."""
    if _rounds(frequencies(sets).groupBy("df").agg((F.count(F.lit(1)) * F.col("df")).alias("many"))):
        return nearest(sets.select("id", "n", F.explode("words").alias("keyword")), k, asked.select("id"))
    return expanded(asked, sets, "best", k)


def nearest(members: DataFrame, k: int, only: DataFrame | None = None) -> DataFrame:
    """(src, dst, shared, all, similarity, place): for each set of ``members`` (id long,
    n, keyword, distinct) its k most similar sets with common keywords, ties by id; with
    ``only`` (id) for those sets, against all."""
    rows = graded(members)
    waiting, found = rows if only is None else store(rows.join(only, "id", "left_semi"), "waiting"), None
    for limit in _rounds(rows.groupBy("df").agg(F.count(F.lit(1)).alias("many"))):
        rest = waiting.groupBy("id").agg(F.count_if(F.col("df") > limit).alias("rest"))
        asked = waiting.where(F.col("df") <= limit)
        pairs = expanded(asked, rows.where(F.col("df") <= limit)).join(rest.withColumnRenamed("id", "src"), "src")
        seen = store(_bounded(pairs, k), "candidates")
        closed = seen.where("closed")
        whole = rows.groupBy("id").agg(F.collect_set("keyword").alias("words"))
        side = lambda c: whole.select(F.col("id").alias(c), F.col("words").alias(f"{c}_words"))
        compared = closed.where("rest > 0").join(side("src"), "src").join(side("dst"), "dst").withColumn("shared", F.size(F.array_intersect("src_words", "dst_words")).cast("long"))
        exact = closed.where("rest = 0").select("src", "n", "dst", "m", "shared").unionByName(compared.select("src", "n", "dst", "m", "shared"))
        one = store(_best(exact, k), "nearest")
        found = one if found is None else found.unionByName(one)
        waiting = store(waiting.join(closed.select(F.col("src").alias("id")).distinct(), "id", "left_anti"), "waiting")
    last = expanded(waiting, rows, "best", k)
    return last if found is None else found.unionByName(last)
