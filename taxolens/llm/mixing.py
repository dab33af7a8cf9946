"""Mixing sources to target weights by pivotal dependent rounding, in SQL functions.

Each source has a target share of all words; a document's expected copies are
``target / source_size``. The whole part is given outright. The fractional parts are
rounded in pairs: word mass moves at random between the two documents of a pair
until one of them is taken or left, and the other goes on with what remains. A block
of documents is folded so into one residual; residuals are blocks of the next level,
up to one per source. Mass is preserved at every step, so a source misses its target
by one document at most. Blocks are dealt by hash: a hot source has many.

Rows go by a hash of all their columns and by an occurrence number among equal rows: equal
rows are counted before they are shuffled and numbered afterwards, so they lie in blocks
of their own each, and however they are dealt, reruns agree.

Defined cases: a null, empty or wordless text has size 0 and is never taken; null sources
are one source, the last; repeated rows are rounded each for itself; ties of random
numbers go by hash and number; a long text is never divided, so its source may miss the
target by its size; columns of any name and type are kept (maps are hashed as JSON); no
rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from taxolens.llm.common import keep, n_words, quoted, unused

#: Documents (later residuals) folded in one block, on average.
BLOCK = 256
#: No source is repeated more often than so many times.
MOST_COPIES = 3
#: Weights, dealt to the sources in their order, over and over.
WEIGHTS = (1, 2, 3)
SEED = 17


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """Distinct sources with their sums and 0-based rank by code point, null last.

    The rank comes from a range partitioning and per-partition counts, so no task
    has all sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = [F.col("source").isNull(), F.col("source")]
    placed = keep(
        per.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}),
        "mix-sources",
    )
    before, total = {}, 0
    for part, n in sorted(placed.groupBy("__part").count().collect()):  # a number a partition
        before[part] = total
        total += n
    if not before:
        return placed.select("source", "source_size", "docs", F.lit(0).cast("long").alias("rank"))
    offset = F.create_map(*[F.lit(x) for p in before.items() for x in p])[F.col("__part")].cast("long")
    return placed.select("source", "source_size", "docs", (F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) + offset).alias("rank"))


def targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target``: shares by weight, stopped at ``most`` times the source's size,
    the excess given to the others by weight until none is above."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)})
    total, all_weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (total or 0) / all_weights if all_weights else 0.0
    while total:
        stopped = F.col("cap") < level * F.col("weight")
        cut, free = sources.agg(F.sum(F.when(stopped, F.col("cap"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not free:
            break
        higher = (total - (cut or 0.0)) / free
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least("cap", F.lit(float(level)) * F.col("weight")))


def _fold(pieces: Column) -> Column:
    """Fold an array of (u, doc_id, h, k, size, p) into (left: one of them, done: array
    of (doc_id, h, k, size, x))."""
    first = F.element_at(pieces, 1)
    done = lambda e, x: F.struct(e.doc_id.alias("doc_id"), e.h.alias("h"), e.k.alias("k"), e.size.alias("size"), F.lit(x).alias("x"))
    carry = lambda e, p: F.struct(e.u.alias("u"), e.doc_id.alias("doc_id"), e.h.alias("h"), e.k.alias("k"), e.size.alias("size"), p.alias("p"))
    none = F.slice(F.transform(pieces, lambda e: done(e, 0)), 1, 0)

    def step(acc: Column, b: Column) -> Column:
        a = acc.left
        up = F.least(a.size * (1.0 - a.p), b.size * b.p)
        down = F.least(a.size * a.p, b.size * (1.0 - b.p))
        rise = (up + down == 0.0) | (b.u * (up + down) < down)
        one = lambda who, x, other, p: F.struct(carry(other, p).alias("left"), F.array_append(acc.done, done(who, x)).alias("done"))
        clip = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
        return (
            F.when(rise & (a.size * (1.0 - a.p) <= b.size * b.p), one(a, 1, b, clip(b.p - a.size * (1.0 - a.p) / b.size)))
            .when(rise, one(b, 0, a, clip(a.p + b.size * b.p / a.size)))
            .when(a.size * a.p <= b.size * (1.0 - b.p), one(a, 0, b, clip(b.p + a.size * a.p / b.size)))
            .otherwise(one(b, 1, a, clip(a.p - b.size * (1.0 - b.p) / a.size)))
        )

    start = F.struct(carry(first, first.p).alias("left"), none.alias("done"))
    return F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))), start, step)


def _unit(h: Column, k: Column, level: int) -> Column:
    """A number in [0, 1) from a row's hash and number."""
    return F.xxhash64(h, k, F.lit(SEED + level)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)


def _block(h: Column, k: Column, level: int, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(h, k, F.lit(1000 + level)), blocks)


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, MapType):
        return True
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind)


def row_hash(docs: DataFrame) -> Column:
    """A hash of all columns; of maps, of their JSON (keys in the order they come)."""
    columns = [F.to_json(F.struct(F.col(q))) if _has_map(f.dataType) else F.col(q) for q, f in zip(quoted(docs.columns), docs.schema)]
    return F.xxhash64(*columns, F.lit(SEED))


def decide(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (with doc_id, text, source): doc_id, h and k (hash of
    the whole row, number among equal rows), size, source_size, target, copies, taken."""
    equal = docs.select("doc_id", "source", n_words("text").alias("size"), row_hash(docs).alias("h")).groupBy("doc_id", "source", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = keep(equal.select("doc_id", "source", "size", "h", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("k")), "mix-sizes")
    sources = keep(targets(ranked_sources(sizes), weights, most), "mix-targets")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sources.select(F.col("source").alias("__s"), "rank", "source_size", "target", "docs", copies.alias("share"))
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("__s"))).withColumns({"whole": F.floor("share"), "p": F.col("share") - F.floor("share")})
    open_ = (F.col("p") > 0) & (F.col("size") > 0)

    def fold(pieces: DataFrame, level: int) -> DataFrame:
        """Blocks of ``pieces`` (rank, blocks, doc_id, h, k, size, p), folded."""
        h, k = F.col("h"), F.col("k")
        item = F.struct(_unit(h, k, level).alias("u"), "doc_id", "h", "k", "size", "p")
        grouped = pieces.groupBy("rank", "blocks", _block(h, k, level, F.col("blocks")).alias("block")).agg(F.sort_array(F.collect_list(item)).alias("pieces"))
        return keep(grouped.select("rank", "blocks", _fold(F.col("pieces")).alias("f")).select("rank", "blocks", "f.left", "f.done"), "mix-level")

    level = fold(joined.where(open_).select("rank", F.ceil(F.col("docs") / float(block)).alias("blocks"), "doc_id", "h", "k", F.col("size").cast("double").alias("size"), "p"), 0)
    most_blocks = math.ceil((sources.agg(F.max("docs")).first()[0] or 0) / block)
    levels = [level]
    while most_blocks > 1:  # residuals are one per block, and few
        most_blocks = math.ceil(most_blocks / block)
        left = levels[-1].select("rank", F.ceil(F.col("blocks") / float(block)).alias("blocks"), "left.doc_id", "left.h", "left.k", "left.size", "left.p")
        levels.append(fold(left, len(levels)))
    rounded = levels[-1].select("rank", "left.doc_id", "left.h", "left.k", "left.size", (_unit(F.col("left.h"), F.col("left.k"), 99) < F.col("left.p")).cast("int").alias("x"))
    for level in levels:
        rounded = rounded.unionByName(level.select("rank", F.explode("done").alias("d")).select("rank", "d.doc_id", "d.h", "d.k", "d.size", "d.x"))
    shut = joined.where(~open_).select("rank", "doc_id", "h", "k", F.col("size").cast("double").alias("size"), F.lit(0).alias("x"))
    per = sources.select("rank", "source_size", "target", F.floor(copies).alias("whole"))
    return (
        rounded.unionByName(shut).join(per, "rank")
        .withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("x")).otherwise(0).cast("long"))
        .select("doc_id", "h", "k", F.col("size").cast("long").alias("size"), "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as it is taken; columns as given.

    Of equal rows one is kept and repeated as often as all of them are taken; rows meet
    their decisions by hash and doc_id."""
    names = docs.columns
    h, i, n, own = (unused(names, c) for c in ("__h", "__i", "__n", "__row"))
    taken = decide(docs, weights, most).where("copies > 0").groupBy(F.col("h").alias(h), F.col("doc_id").alias(i)).agg(F.sum("copies").cast("int").alias(n))
    rows = docs.select(F.struct(*[F.col(q).alias(f"c{j}") for j, q in enumerate(quoted(names))]).alias(own), row_hash(docs).alias(h), F.col("doc_id").alias("__doc"))
    one = rows.groupBy(h, "__doc").agg(F.any_value(own).alias(own))
    met = one.join(taken, (one[h] == taken[h]) & one["__doc"].eqNullSafe(taken[i]))
    return met.select(own, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[F.col(f"{own}.c{j}").alias(c) for j, c in enumerate(names)])
