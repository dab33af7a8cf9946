"""Places of rows in an order, running sums, values at a rank and lowest rows, without a
task that sorts or holds all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxolens.operators.components import store


def places(rows: DataFrame, order: list[Column], within: list[str] | None = None, into: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in ``order``, counted for each group ``within``.

    Rows are range-partitioned by group and order and numbered as they lie; what a
    partition numbers is shifted by the sizes of the same group's earlier partitions. A
    large group is spread over many partitions; only a row per partition and group meets
    in a window."""
    by = within or []
    keys = [*map(F.col, by), *order]
    placed = store(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}),
        "placed",
    )
    sizes = placed.groupBy("__part", *by).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__part", *[F.col(c).alias(f"__{c}") for c in by], (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
    same = placed["__part"] == shifts["__part"]
    for c in by:
        same = same & placed[c].eqNullSafe(shifts[f"__{c}"])
    return placed.join(shifts, same).select(*[placed[c] for c in rows.columns], (F.col("__shift") + F.col("__row") + 1).alias(into))


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], within: list[str] | None = None) -> DataFrame:
    """``rows`` with running sums in ``order``: ``sums`` maps new columns to integer ones.
    Rows that are equal in ``order`` must be one row, as they are after grouping by it.

    Rows are range-partitioned; each partition sums up its own, and adds what the group's
    earlier partitions come to. Only a row per partition and group meets in a window."""
    by = within or []
    keys = [*map(F.col, by), *order]
    placed = store(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()), "ranged")
    own = Window.partitionBy("__part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = placed.withColumns({into: F.sum(c).over(own) for into, c in sums.items()})
    totals = placed.groupBy("__part", *by).agg(*[F.sum(c).alias(f"__{into}") for into, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__part").alias("__at"), *[F.col(c).alias(f"__by_{c}") for c in by], *[F.coalesce(F.sum(f"__{into}").over(before), F.lit(0)).alias(f"__{into}") for into in sums])
    same = F.col("__part") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return walked.join(shifts, same).select(*rows.columns, *[(F.col(into) + F.col(f"__{into}")).alias(into) for into in sums])


#: Ranges that values are counted in at once.
RANGES = 4096


def at_ranks(rows: DataFrame, column: str, ranks: list[int]) -> list[int]:
    """The values of an integer column at ``ranks`` (from 0, ascending, nulls left out).

    A round counts the values of ranges within the bounds known so far, which are at most
    ``RANGES`` sums, and goes on in the range that holds the rank: six rounds at most."""
    found = []
    values = rows.select(F.col(column).cast("long").alias("v")).where("v is not null")
    for rank in ranks:
        bounds = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
        low, high = bounds[0], bounds[1]
        if not 0 <= rank < bounds[2]:
            raise ValueError(f"there is no rank {rank}")
        while low < high:
            width = -(-(high - low + 1) // RANGES)
            own = values.where(F.col("v").between(low, high)).groupBy(F.expr(f"(cast(v as decimal(20,0)) - {low}BD) div {width}BD").alias("r")).agg(F.count(F.lit(1)).alias("n"))
            for r, n in sorted(map(tuple, own.collect())):
                if rank < n:
                    low, high = low + r * width, min(high, low + (r + 1) * width - 1)
                    break
                rank -= n
        found.append(low)
    return found


def median(rows: DataFrame, column: str) -> float | None:
    """The exact median of an integer column: the mean of the two middle values."""
    n = rows.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    middle = at_ranks(rows, column, sorted({(n - 1) // 2, n // 2}))
    return (middle[0] + middle[-1]) / 2


#: Groups of so many times the wanted rows are cut before they meet.
LARGE = 4
#: Rows that are broadcast; more are joined by key.
MOST_CUTS = 200_000
_DIGITS = 4  # of a hexadecimal hash: 65,536 ranges


def few(rows: DataFrame) -> DataFrame:
    """Stored ``rows``, marked for broadcast unless there are many."""
    return F.broadcast(rows) if rows.limit(MOST_CUTS + 1).count() <= MOST_CUTS else rows


def lowest(rows: DataFrame, by: list[str], digest: Column, ties: list[Column], size: int) -> DataFrame:
    """The ``size`` rows of each group with the lowest ``digest`` (a hash as hexadecimal
    text), then by ``ties``.

    Hashes spread evenly, so counts of their first digits, summed in the tasks, say how far
    a large group must be read: beyond that range its rows are dropped where they lie, and
    the window sees little more than ``size`` rows a group."""
    hashed = rows.withColumn("__digest", digest)
    counts = hashed.groupBy(*by, F.substring("__digest", 1, _DIGITS).alias("__range")).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*by)
    upto = F.sum("__n").over(own.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = counts.withColumns({"__upto": upto, "__all": F.sum("__n").over(own)}).where((F.col("__all") > LARGE * size) & (F.col("__upto") >= size))
    cuts = store(reached.groupBy(*[F.col(c).alias(f"__cut_{c}") for c in by]).agg(F.min("__range").alias("__last")), "cuts")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__cut_{c}"))
    left = hashed.join(few(cuts), same, "left").where(F.col("__last").isNull() | (F.substring("__digest", 1, _DIGITS) <= F.col("__last")))
    place = F.row_number().over(own.orderBy("__digest", *ties))
    return left.withColumn("__place", place).where(F.col("__place") <= size).select(*rows.columns)
