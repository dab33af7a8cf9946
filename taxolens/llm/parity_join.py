"""N-gram Jaccard join by parity sketches, and its components.

A document's set is its distinct 5-word shingles, as 64-bit hashes. Hash space is cut
into parts; a part's sketch is the XOR of the hashes that fall into it. A token that two
sets do not share changes one part, so the number of parts that differ is at most the
symmetric difference: sets with Jaccard >= 3/4 have one of at most (a + b) / 7. Of the
parts of a set in any one order, the first ``difference + 1`` must hold one that the
other set has among its own: sketches are joined by equality of those parts, within
bands of size (a set also enters the next band if its partner may be there). Nothing is
lost by this filter, whatever the order; the order taken is rare parts first, by counts
over the whole corpus in a table of fixed size, so that passages which many documents
share make candidates only of sets that have little else.

Candidates pass a parity sketch of single bits (its Hamming distance is a lower bound
too) and then an exact comparison of the sets, computed again from the texts.

Work that grows with a group of alike documents is kept linear: equal sets are one class
beforehand; within a group of equal sketches, members are tried against four leaders,
not with each other, and a signature of very many sets is dealt over several tasks. Only
in groups that still span several components afterwards are the members outside their
largest component compared with all, block by block, by bit sketches, for a forest of the
closest pairs. What is still apart then, of the nodes of other such pairs, is compared
once more by finer sketches. Links within a component change nothing.

Defined cases: a null or empty text, or one without words: empty set, linked with
nothing; fewer than five words: one shingle; rows without an id take no part in links
and have no component; repeated rows are one class; rows that share an id but not their
text are classes of their own; sets at exactly 75 % link; a very long text is hashed in
windows; other columns of any name stay out of the plan; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import keep, mix64, quoted, release, small_batches, unused, utf8
from taxolens.llm.hashing import hashed_words
from taxolens.operators.components import connected_components

WORDS = 5
#: Sets below this size have one part per token.
WHOLE_BELOW = 256
#: Parts of a band per token of its smallest set.
PARTS = 0.7
#: Signatures in one bucket, on average, and in one forwarded piece.
BUCKET = 400_000
PIECE = 1 << 18
#: Slots of the table that counts parts, as a power of two, and those of one of its rows.
SLOT_BITS, CHUNK_BITS = 19, 12
#: Holders of one signature in one task, by the table's estimate.
HOT = 1 << 20
#: Bytes of sketches in one block of a group that is compared, of queries and of all.
QUERY_BYTES, GROUP_BYTES = 1 << 20, 4 << 20
#: Rows of 32 bytes that are broadcast to pick texts.
FEW = 200_000
#: Names a task remembers so as not to tell the same thing twice.
REMEMBERED = 50_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _shingle(h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text, from those of its words."""
    if not h.size:
        return h
    with np.errstate(over="ignore"):
        if h.size < WORDS:
            one = np.uint64(h.size)
            for k, w in enumerate(h):
                one = one * _M[4] + w * _M[k]
            return mix64(np.array([one], np.uint64))
        n = h.size - WORDS + 1
        s = h[:n] * _M[0]
        for k in range(1, WORDS):
            s += h[k : k + n] * _M[k]
        s = mix64(s)
    s.sort()
    fresh = np.ones(n, bool)
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    return s if fresh.all() else s[fresh]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The set of each text."""
    return map(_shingle, hashed_words(texts))


#: Where bands of size begin; sets that link are in one band or in neighbouring ones.
BANDS = [-(-(4**k) // 3**k) for k in range(1, 64)]


def set_id(tokens: np.ndarray) -> tuple[int, int]:
    """122 bits that name a set, as two signed numbers. The low six bits of the first
    are the band of its size."""
    h = xxhash.xxh3_128_digest(tokens.tobytes())
    low = int.from_bytes(h[:8], "little", signed=True) & ~63
    return low | bisect_right(BANDS, tokens.size), int.from_bytes(h[8:], "little", signed=True)


def bit_sketch(tokens: np.ndarray, per_token: int = 2) -> bytes:
    """Parity of tokens by their low bits; ``per_token`` to twice as many bits a token."""
    m = 1 << max(6, int(tokens.size * per_token - 1).bit_length() if tokens.size else 6)
    return np.packbits(np.bincount((tokens & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Bits that differ, after the longer sketch is folded to the shorter."""
    if len(a) < len(b):
        a, b = b, a
    return int(np.bitwise_count(_fold([a], len(b))[0] ^ np.frombuffer(b, np.uint64)).sum())


def may_link(na: int, nb: int) -> int:
    """The largest symmetric difference of linked sets of these sizes, or -1."""
    return -1 if 4 * min(na, nb) < 3 * max(na, nb) else (na + nb) // 7


def parts(tokens: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """For each band that the set enters: how many parts it is joined by, and all."""
    n = tokens.size
    out = []
    band = n.bit_length() - 1
    for j in (band, band + 1):
        if j > band and 4 * n < 3 * (1 << j):
            break
        largest = min(4 * n // 3, (2 << j) - 1)
        wanted = (n + largest) // 7 + 1
        with np.errstate(over="ignore"):
            if (2 << j) <= WHOLE_BELOW:
                found = mix64(tokens + _M[0] * np.uint64(j))
            else:
                count = int(PARTS * (1 << j))
                part = ((tokens >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                size = np.diff(np.append(first, n)).astype(np.uint64)
                both = np.bitwise_xor.reduceat(tokens, first)
                found = mix64(both + part[first] * _M[1] + size * _M[2] + np.uint64(j) * _M[3])
        out.append((wanted, found))
    return out


def signatures(tokens: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """The parts by which a set is joined, in all its bands: the rarest ones. The high
    byte of a signature is the level of its part in the table of counts."""
    out = []
    for wanted, found in parts(tokens):
        own = found >> np.uint64(8)
        if levels is not None:
            own |= levels[found >> np.uint64(64 - SLOT_BITS)].astype(np.uint64) << np.uint64(56)
        if own.size > wanted:
            own = np.partition(own, wanted - 1)[:wanted]
        out.append(own)
    return np.concatenate(out)


class PartCounts:
    """How many sets have parts in each slot of a table of fixed size."""

    def __init__(self):
        self.table = np.zeros(1 << SLOT_BITS, np.uint32)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, tokens: np.ndarray) -> None:
        for _, found in parts(tokens):
            self.held.append((found >> np.uint64(64 - SLOT_BITS)).astype(np.int32))
            self.size += found.size
        if self.size >= PIECE:
            self.fold()

    def fold(self) -> None:
        if self.held:
            self.table += np.bincount(np.concatenate(self.held), minlength=self.table.size).astype(np.uint32)
            self.held, self.size = [], 0

    def rows(self) -> tuple[list[int], list[bytes], list[bytes]]:
        """Chunks of the table that aren't empty: number, slots and counts."""
        self.fold()
        at = np.flatnonzero(self.table)
        edges = np.searchsorted(at >> CHUNK_BITS, np.arange((1 << (SLOT_BITS - CHUNK_BITS)) + 1)).tolist()
        some = [(k, a, b) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]
        slots, counts = (at & ((1 << CHUNK_BITS) - 1)).astype(np.uint16), self.table[at]
        return [k for k, *_ in some], [slots[a:b].tobytes() for _, a, b in some], [counts[a:b].tobytes() for _, a, b in some]


ABOUT = "doc_id long, n long, s1 long, s2 long, sketch binary, chunk int, slots binary, counts binary"


def _describe(batches):
    """What ABOUT holds: a row for each document, then the task's counts of parts."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in ABOUT.split(", ")]
    counted, done = PartCounts(), set()
    for batch in batches:
        out = []
        for tokens in shingle_sets(utf8(batch.column("text"))):
            name = set_id(tokens)
            out.append((tokens.size, *name, bit_sketch(tokens)))
            if tokens.size and name[0] not in done:
                if len(done) < REMEMBERED:
                    done.add(name[0])
                counted.add(tokens)
        none = [pa.nulls(len(out), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], *none], names)
    chunk, slots, counts = counted.rows()
    if chunk:
        none = [pa.nulls(len(chunk), t) for t in (pa.int64(), *kinds)]
        yield pa.RecordBatch.from_arrays([*none, pa.array(chunk, pa.int32()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], names)
    release()


def _sum_chunks(batches):
    tables: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, s, c in zip(*(x.to_pylist() for x in batch.columns)):
            own = tables.setdefault(k, np.zeros(1 << CHUNK_BITS, np.int64))
            own[np.frombuffer(s, np.uint16)] += np.frombuffer(c, np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array(list(tables), pa.int32()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["chunk", "counts"])


def part_levels(about: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """From the counts of all tasks: the level of each slot (0: as full as most), and
    over how many tasks the holders of a signature of each level are dealt. The driver
    gets a table of ``2 ** SLOT_BITS`` counts, however large the corpus."""
    chunks = about.where("chunk is not null").select("chunk", "slots", "counts").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, counts binary")
    table = np.zeros(1 << SLOT_BITS, np.int64)
    for r in chunks.collect():
        table[r.chunk << CHUNK_BITS : (r.chunk + 1) << CHUNK_BITS] = np.frombuffer(r.counts, np.int64)
    usual = table.mean() + 4 * np.sqrt(table.mean()) + 2
    levels = np.clip(1 + np.floor(4 * np.log2(np.maximum(table, 1) / usual)), 0, 255).astype(np.uint8)
    return levels, np.clip(usual * 2.0 ** (np.arange(256) / 4) / HOT, 1, 1 << 20).astype(np.uint64)


def _scatter(buckets: int, levels: np.ndarray, spread: np.ndarray):
    """Signatures of texts, by bucket: rows (bucket, signatures, set names)."""

    def scatter(batches):
        sigs, names, held = [], [], 0
        done: set[int] = set()

        def rows():
            s = np.concatenate(sigs)
            who = np.repeat(np.array([x for x, _ in names], np.int64), [k for _, k in names])
            share = mix64(who.view(np.uint64)) % spread[s >> np.uint64(56)]
            with np.errstate(over="ignore"):
                to = (mix64(s + share * _M[1]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            s, who, to = s[order], who[order], to[order]
            edges = np.append(np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])), to.size)
            for at in range(0, edges.size - 1, 256):
                some = list(zip(edges[at : at + 257][:-1].tolist(), edges[at : at + 257][1:].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in some]), pa.array([s[a:b].tobytes() for a, b in some], pa.binary()), pa.array([who[a:b].tobytes() for a, b in some], pa.binary())], ["bucket", "sigs", "names"])

        for batch in batches:
            for tokens in shingle_sets(utf8(batch.column(0))):
                if not tokens.size:
                    continue
                name = set_id(tokens)[0]
                if name in done:
                    continue
                if len(done) < REMEMBERED:
                    done.add(name)
                own = signatures(tokens, levels)
                sigs.append(own)
                names.append((name, own.size))
                held += own.size
                if held >= PIECE:
                    yield from rows()
                    sigs, names, held = [], [], 0
        if held:
            yield from rows()
        release()

    return scatter


def _runs(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    fresh = np.ones(sorted_columns[0].size, bool)
    if fresh.size:
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return fresh


def _gather(spread: np.ndarray):
    """Groups of equal signatures and neighbouring bands of size: pairs (kind 0: a leader
    with each other member; which member leads depends on one of four orders, by the
    signature) and, for groups of three and more, their members (kind 1: group, member)."""

    def gather(batches):
        s = [np.zeros(0, np.uint64)]
        w = [np.zeros(0, np.int64)]
        for batch in batches:
            s += [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            w += [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
        sig, who = np.concatenate(s), np.concatenate(w)
        del s, w
        order = np.argsort(sig, kind="stable")
        sig, who = sig[order], who[order]
        same = sig[1:] == sig[:-1]
        if not same.any():
            return
        several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        sig, who = sig[several], who[several]
        # each member is in two windows of two bands
        band = np.concatenate([who & 63, (who & 63) + 1])
        sig, who = np.tile(sig, 2), np.tile(who, 2)
        with np.errstate(over="ignore"):
            turn = mix64(who.view(np.uint64) + np.array(_M[:4])[sig & np.uint64(3)])
        order = np.lexsort((turn, band, sig))
        sig, band, who = sig[order], band[order], who[order]
        fresh = _runs(sig, band, who)
        sig, band, who = sig[fresh], band[fresh], who[fresh]
        first = np.flatnonzero(_runs(sig, band))
        size = np.diff(np.append(first, sig.size))
        lead = np.repeat(who[first], size)
        a, b = np.minimum(lead, who), np.maximum(lead, who)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        kept = _runs(a, b) & (a != b)
        a, b = a[kept], b[kept]
        step = 1 << 16
        for at in range(0, a.size, step):
            x, y = a[at : at + step], b[at : at + step]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(x.size, np.int32)), pa.array(x), pa.array(y)], ["kind", "a", "b"])
        dealt = spread[sig[first] >> np.uint64(56)] > 1
        big = (size >= 3) | dealt
        # a group's name: the sum of its members' mixed names, so that equal groups are
        # told once; one that is dealt over several tasks goes by its signature and band
        with np.errstate(over="ignore"):
            name = np.where(dealt, mix64(sig[first] + band[first].astype(np.uint64) * _M[2]), np.add.reduceat(mix64(who.view(np.uint64)), first)).view(np.int64)
        name, where = np.unique(name[big], return_index=True)
        starts, sizes = first[big][where], size[big][where]
        at = 0
        while at < name.size:
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), step, "right")))
            rows = np.repeat(starts[at:to] - np.concatenate([[0], np.cumsum(sizes[at:to])[:-1]]), sizes[at:to]) + np.arange(sizes[at:to].sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows.size, np.int32)), pa.array(np.repeat(name[at:to], sizes[at:to])), pa.array(who[rows])], ["kind", "a", "b"])
            at = to
        release()

    return gather


def _fold(sketches: list[bytes], m: int) -> np.ndarray:
    """Bit sketches of at least ``m`` bytes, folded to it: a row of words each."""
    out = np.empty((len(sketches), m), np.uint8)
    for i, s in enumerate(sketches):
        x = np.frombuffer(s, np.uint8)
        out[i] = np.bitwise_xor.reduce(x.reshape(-1, m), axis=0) if x.size > m else x
    return out.view(np.uint64)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(ra, rb, far): pairs of set names as nodes, where size and bit sketch let them
    through, with the distance of their sketches."""
    side = lambda x: classes.select(F.col("s1").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("node").alias(f"r{x}"))

    @F.arrow_udf("int")
    def far(na: pa.Array, nb: pa.Array, ka: pa.Array, kb: pa.Array) -> pa.Array:
        out = []
        for x, y, p, q in zip(na.to_pylist(), nb.to_pylist(), ka.to_pylist(), kb.to_pylist()):
            most = may_link(x, y)
            d = hamming(p, q) if most >= 0 else 1
            out.append(d if d <= most else None)
        return pa.array(out, pa.int32())

    met = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb) and ra <> rb")
    return met.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb"), far("na", "nb", "ka", "kb").alias("far")).where("far is not null").distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("ra").alias("node")).unionByName(pairs.select(F.col("rb").alias("node"))).distinct()


def _texts(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): a text of each of ``nodes``. Rows that share an id but not their set
    are told apart by the set's name."""

    @F.arrow_udf("s1 long, s2 long")
    def name(texts: pa.Array) -> pa.Array:
        found = [set_id(t) for t in shingle_sets(utf8(texts))]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["s1", "s2"])

    wanted = keep(classes.join(nodes, "node", "left_semi").select("node", F.col("rep").alias("doc_id"), "s1", "s2"), "wanted")
    if wanted.count() <= FEW:  # else texts are dealt by id
        wanted = F.broadcast(wanted)
    # as not deterministic, the name is made of the texts that are wanted, not of all
    own = docs.select("doc_id", "text").join(wanted, "doc_id").withColumn("name", name.asNondeterministic()(F.col("text")))
    return keep(own.where("name.s1 = s1 and name.s2 = s2").select("node", "text").dropDuplicates(["node"]), "texts")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (ra, rb) of nodes whose sets link, by their texts."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(shingle_sets(utf8(x)), shingle_sets(utf8(y))):
            same = np.intersect1d(a, b, assume_unique=True).size
            out.append(same > 0 and 100 * same >= 75 * (a.size + b.size - same))
        return pa.array(out, pa.bool_())

    side = lambda r, t: texts.select(F.col("node").alias(r), F.col("text").alias(t))
    return pairs.select("ra", "rb").join(side("ra", "ta"), "ra").join(side("rb", "tb"), "rb").where(linked("ta", "tb")).select("ra", "rb")


def _fine(texts: DataFrame) -> DataFrame:
    """(node, n, sketch): sketches of eight to sixteen bits a token."""

    @F.arrow_udf("n long, sketch binary")
    def sketch(column: pa.Array) -> pa.Array:
        sets = list(shingle_sets(utf8(column)))
        return pa.StructArray.from_arrays([pa.array([t.size for t in sets], pa.int64()), pa.array([bit_sketch(t, 8) for t in sets], pa.binary())], ["n", "sketch"])

    return keep(texts.select("node", sketch(F.col("text")).alias("s")).select("node", "s.*"), "fine")


def _across(members: DataFrame, label: DataFrame, sketches: DataFrame, forest: bool) -> DataFrame:
    """Pairs (ra, rb, g) within groups that still span components, by bit sketches: all
    of them, or only a forest over the components, of the closest pairs. Of a group with
    other pairs besides, the nodes of all its pairs come as rows without ``rb``.
    ``members`` are (g, node), ``sketches`` (node, n, sketch).

    Queries are the members outside their group's largest component; they meet all
    members. Both are dealt in blocks of bounded bytes, so a task's work is bounded
    whatever the group's size, and rows grow with members times blocks of queries."""
    sizes = sketches.select("node", F.octet_length("sketch").alias("bytes"))
    placed = members.join(sizes, "node").join(label, F.col("node") == F.col("id"), "left").select("g", "node", "bytes", F.coalesce("component", "node").alias("component"))
    per = placed.groupBy("g", "component").agg(F.count(F.lit(1)).alias("size"), F.sum("bytes").alias("bytes"))
    largest = F.max(F.struct("size", F.col("component"), F.col("bytes")))
    open_ = per.groupBy("g").agg(F.count(F.lit(1)).alias("parts"), largest.alias("main"), F.sum("bytes").alias("bytes")).where("parts > 1")
    open_ = open_.select(
        "g", F.col("main.component").alias("main"), F.ceil((F.col("bytes") - F.col("main.bytes")) / float(QUERY_BYTES)).cast("int").alias("blocks"), F.ceil(F.col("bytes") / float(GROUP_BYTES)).cast("int").alias("chunks")
    )
    dealt = F.xxhash64("node")
    own = keep(
        placed.drop("bytes").join(open_, "g")
        .withColumns({"query": F.col("component") != F.col("main"), "block": F.pmod(dealt, "blocks").cast("int"), "chunk": F.pmod(F.shiftright(dealt, 20), "chunks").cast("int")}),
        "open",
    )
    # where a group is one block and one chunk, each member comes once and does both
    asks, answers, met = (F.col(c) for c in ("query", "block", "chunk"))
    once = (F.col("blocks") == 1) & (F.col("chunks") == 1)
    zero = F.lit(0)
    alone = own.where(once).select("g", zero.alias("i"), zero.alias("j"), asks.alias("asks"), F.lit(True).alias("answers"), asks.alias("mine"), "node", "component")
    many = own.where(~once)
    asking = many.where("query").select("g", answers.alias("i"), F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("j"), F.lit(True).alias("asks"), F.lit(False).alias("answers"), F.lit(True).alias("mine"), "node", "component")
    # a query is met by those of later blocks, and of its own by greater nodes
    answering = many.select("*", F.explode(F.sequence(zero, F.when(asks, answers).otherwise(F.col("blocks") - 1))).alias("i")).select(
        "g", "i", met.alias("j"), F.lit(False).alias("asks"), F.lit(True).alias("answers"), (asks & (answers == F.col("i"))).alias("mine"), "node", "component"
    )
    rows = alone.unionByName(asking).unionByName(answering).join(sketches.select("node", "n", "sketch"), "node")
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").mapInArrow(_compare_blocks(forest), "ra long, rb long, g long")


def _forest(distance: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges of a graph, by ascending distance, join what was apart."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    taken = []
    order = np.argsort(distance, kind="stable")
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        if (x := root(x)) != (y := root(y)):
            up[x] = y
            taken.append(i)
    return np.array(taken, np.int64)


def _compare(t: pa.Table, forest: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block of queries and a block of a group that sketches let through; and
    the nodes of all such pairs, if not all are given."""
    sides = []
    for role in ("asks", "answers"):
        own = np.flatnonzero(t.column(role).to_numpy())
        n = t.column("n").to_numpy()[own]
        own = own[np.argsort(n, kind="stable")]
        sketch = t.column("sketch").take(pa.array(own)).to_pylist()
        sides.append([*(t.column(c).to_numpy()[own] for c in ("n", "node", "component", "mine")), np.array([len(s) for s in sketch], np.int64), sketch])
    (qn, qnode, qcomp, _, qsize, qsketch), (n, node, comp, mine, size, sketch) = sides
    lows, tops = np.searchsorted(n, -(-3 * qn // 4)), np.searchsorted(n, 4 * qn // 3, "right")
    left, right, distance = [], [], []
    for m in np.unique(qsize).tolist():
        queries = np.flatnonzero(qsize == m)
        asked = _fold([qsketch[i] for i in queries.tolist()], m)
        for k in np.unique(size).tolist():  # sketches grow with n, so each size is a range
            a, b = np.searchsorted(size, (k, k + 1)).tolist()
            if k > 2 * m or m > 2 * k:
                continue
            least = min(k, m)
            bits = _fold(sketch[a:b], least)
            own = asked if least == m else _fold([qsketch[i] for i in queries.tolist()], least)
            for x, word in zip(queries.tolist(), own):
                low, top = max(a, int(lows[x])), min(b, int(tops[x]))
                if low >= top:
                    continue
                at = low + np.flatnonzero((comp[low:top] != qcomp[x]) & (~mine[low:top] | (node[low:top] > qnode[x])))
                if not at.size:
                    continue
                far = np.bitwise_count(bits[at - a] ^ word).sum(1)
                near = far <= (qn[x] + n[at]) // 7
                if near.any():
                    right.append(at[near])
                    left.append(np.full(right[-1].size, x))
                    distance.append(far[near])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    x, y = np.concatenate(left), np.concatenate(right)
    more = np.zeros(0, np.int64)
    if forest:
        kept = _forest(np.concatenate(distance), qcomp[x], comp[y])
        if kept.size < x.size:
            more = np.union1d(qnode[x], node[y])
        x, y = x[kept], y[kept]
    return np.minimum(qnode[x], node[y]), np.maximum(qnode[x], node[y]), more


def _compare_blocks(forest: bool):
    """Blocks in order of (g, i, j); one that a batch ends in waits for the next."""

    def compare(batches):
        held: list[pa.RecordBatch] = []
        key, seen = None, set()

        def told():
            x, y, more = _compare(pa.Table.from_batches(held).combine_chunks(), forest)
            fresh = [p for p in zip(x.tolist(), y.tolist()) if p not in seen]
            if len(seen) < 2 * REMEMBERED:
                seen.update(fresh)
            ra, rb = [p[0] for p in fresh] + more.tolist(), [p[1] for p in fresh] + [None] * more.size
            return pa.RecordBatch.from_arrays([pa.array(ra, pa.int64()), pa.array(rb, pa.int64()), pa.array([key[0]] * len(ra), pa.int64())], ["ra", "rb", "g"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("g", "i", "j")]
            edges = [*np.flatnonzero(_runs(*keys)).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                own = tuple(int(c[a]) for c in keys)
                if own != key and held:
                    yield told()
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield told()
        release()

    return compare


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ABOUT, and classes of equal sets: s1, s2, node, rep (the least doc_id), n
    and sketch."""
    about = keep(docs.select("doc_id", "text").mapInArrow(_describe, ABOUT), "sets")
    known = about.where("n > 0 and doc_id is not null").groupBy("s1", "s2")
    one = known.agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return about, keep(one.withColumn("node", F.monotonically_increasing_id()), "classes")


def _label(docs: DataFrame, about: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component) of the nodes that are linked with a lesser one."""
    spark = docs.sparkSession
    levels, spread = part_levels(about)
    total = classes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, round(total / 2 / BUCKET), int(spark.conf.get("spark.sql.shuffle.partitions")))
    scattered = docs.where("doc_id is not null").select("text").mapInArrow(_scatter(buckets, levels, spread), "bucket long, sigs binary, names binary")
    found = keep(scattered.repartition(buckets, "bucket").mapInArrow(_gather(spread), "kind int, a long, b long"), "groups")
    near = keep(_near(found.where("kind = 0").select("a", "b").distinct(), classes), "near")
    texts = _texts(docs, classes, _ends(near))
    label = spark.createDataFrame([], "id long, component long")
    links, done = None, near.select("ra", "rb")
    # each node's closest pair; all stars; a forest over components within groups; what is left
    for step in ("closest", "stars", "forest", "rest"):
        if step == "closest":
            both = near.unionByName(near.select(F.col("rb").alias("ra"), F.col("ra").alias("rb"), "far"))
            best = both.groupBy("ra").agg(F.min(F.struct("far", "rb")).alias("best")).select("ra", "best.rb")
            tried = best.select(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).distinct()
        elif step == "stars":
            tried = _apart(near, label)
        elif step == "forest":
            members = found.where("kind = 1").select(F.col("a").alias("g"), F.col("b").alias("s1")).distinct().join(classes.select("s1", "node"), "s1").select("g", "node")
            across = keep(_across(members, label, classes.select("node", "n", "sketch"), True), "across")
            if across.isEmpty():
                break  # no group spans components by its sketches
            tried = keep(across.where("rb is not null").select("ra", "rb").distinct().join(done, ["ra", "rb"], "left_anti"), "tried")
            done = done.unionByName(tried)
            texts = texts.unionByName(_texts(docs, classes, _ends(tried).join(texts.select("node"), "node", "left_anti")))
        else:
            members = keep(across.where("rb is null").select("g", F.col("ra").alias("node")).distinct(), "left")
            if members.isEmpty():
                break  # all pairs that sketches let through have been tried
            texts = _texts(docs, classes, members.select("node").distinct())
            tried = keep(_across(members, label, _fine(texts), False).select("ra", "rb").distinct().join(done, ["ra", "rb"], "left_anti"), "tried")
        got = keep(_verify(tried, texts), "links")
        if got.isEmpty():
            continue
        links = got if links is None else links.unionByName(got)
        label = connected_components(links.select(F.col("ra").alias("u"), F.col("rb").alias("v")))
    return label


def _named(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ABOUT, and (s1, s2, rep, root, component): the least doc_id of each class
    and of its component; ``root`` tells components apart whose rows share that id."""
    small_batches(docs.sparkSession)
    about, classes = _classes(docs)
    label = _label(docs, about, classes)
    own = classes.join(label, F.col("node") == F.col("id"), "left").select("s1", "s2", "rep", F.coalesce("component", "node").alias("root"))
    least = own.groupBy("root").agg(F.min("rep").alias("component"))
    return about.where("chunk is null"), keep(own.join(least, "root").select("s1", "s2", "rep", "root", "component"), "named")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    about, named = _named(docs)
    linked = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return about.join(named.select("s1", "s2", "component"), ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), linked).alias("component_id")
    )


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    of = lambda x: label.select(F.col("id").alias(f"i{x}"), F.col("component").alias(f"c{x}"))
    return (
        pairs.join(of("a"), F.col("ra") == F.col("ia"), "left").join(of("b"), F.col("rb") == F.col("ib"), "left")
        .where(F.coalesce("ca", "ra") != F.coalesce("cb", "rb")).select("ra", "rb")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, of its least id; columns as given. Rows without
    an id stay, and so does one row of each id without words; of repeated rows, one."""
    about, named = _named(docs)
    leads = named.where("rep = component").groupBy("root", "component").agg(F.min(F.struct("s1", "s2")).alias("s")).select(F.col("component").alias("__id"), "s.*")
    several = keep(about.where("doc_id is not null").groupBy("doc_id").agg(F.count_distinct("s1", "s2").alias("sets")).where("sets > 1").select("doc_id"), "shared-ids")
    bare = about.where("n = 0 and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    ids = leads.select("__id").unionByName(bare).distinct()
    own = docs.where("doc_id is not null").join(ids, docs["doc_id"] == ids["__id"], "left_semi")
    if several.isEmpty():
        kept = own.dropDuplicates(["doc_id"])
    else:

        @F.arrow_udf("struct<s1: long, s2: long, n: long>")
        def name(texts: pa.Array) -> pa.Array:
            found = [(*set_id(t), t.size) for t in shingle_sets(utf8(texts))]
            return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["s1", "s2", "n"])

        mine, lead = unused(docs.columns, "__set"), unused(docs.columns, "__lead")
        given = leads.select(F.struct(F.col("__id"), "s1", "s2").alias(lead))
        one = own.withColumn(mine, name(F.col("text"))).dropDuplicates(["doc_id", mine])
        same = (F.col("doc_id") == F.col(f"{lead}.__id")) & (F.col(f"{mine}.s1") == F.col(f"{lead}.s1")) & (F.col(f"{mine}.s2") == F.col(f"{lead}.s2"))
        kept = one.join(given, same, "left").where((F.col(f"{mine}.n") == 0) | F.col(lead).isNotNull())
    return kept.select(*quoted(docs.columns)).unionByName(docs.where("doc_id is null"))
