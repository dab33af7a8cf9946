"""Exact sums of doubles: rounded once, the same whatever the order and partitions.

A double is an integer times a power of two. It is cut into limbs of 32 bits at fixed
places, the lowest at the smallest subnormal; limbs are added as integers, carried into
each other once at the end, and their 62 highest bits, with a mark for anything below, are
rounded to a double. A limb holds 2**31 values; beyond that the sum of longs is an error.

Nulls are left out; no value gives null. NaN, or infinities of both signs, give NaN, one
infinity gives itself; a sum beyond the largest double is infinite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a limb, the place of the smallest bit of a double, and bits of a mantissa.
LIMB, LOWEST, MANTISSA = 32, -1074, 53
#: Limbs of the largest double, with room for carries.
LIMBS = 68
_MASK = (1 << LIMB) - 1
#: Bits that are rounded to a double: more than two beyond a mantissa, and within a long.
_KEPT = 62


def let(x: Column, f) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _two(power: Column) -> Column:
    return F.pow(F.lit(2.0), power)


def _scaled(x: Column, power: Column) -> Column:
    """x times two to a power, in two steps, so that neither is out of range."""
    return let(F.struct(F.floor(power / 2).alias("half"), power.alias("power")), lambda p: x * _two(p.half) * _two(p.power - p.half))


def _left(v: Column, n: Column) -> Column:
    return F.call_function("shiftleft", v, n.cast("int"))


def _right(v: Column, n: Column) -> Column:
    return F.call_function("shiftright", v, n.cast("int"))


def limbs(x: Column) -> Column:
    """A finite double as array<struct<limb:int,v:long>> of three limbs; of 0: none."""
    size = F.abs(x)
    # the logarithm may be off by one beside a power of two
    high = let(F.floor(F.log2(size)), lambda g: F.when(_two(g) > size, g - 1).when(_two(g + 1) <= size, g + 1).otherwise(g))
    place = F.greatest(high - (MANTISSA - 1), F.lit(LOWEST).cast("long"))
    part = let(place, lambda p: F.struct(_scaled(x, -p).cast("long").alias("whole"), F.floor((p - LOWEST) / LIMB).cast("int").alias("limb"), ((p - LOWEST) % LIMB).cast("int").alias("up")))
    split = let(part, lambda p: F.struct(p.whole.alias("whole"), p.limb.alias("limb"), p.up.alias("up"), _right(p.whole, LIMB - p.up).alias("above")))
    one = lambda limb, v: F.struct(limb.cast("int").alias("limb"), v.alias("v"))
    cut = let(split, lambda p: F.array(one(p.limb, _left(p.whole - _left(p.above, LIMB - p.up), p.up)), one(p.limb + 1, p.above.bitwiseAND(F.lit(_MASK))), one(p.limb + 2, F.shiftright(p.above, LIMB))))
    return F.when(x == 0, F.array().cast("array<struct<limb:int,v:bigint>>")).otherwise(cut)


def _carried(sums: Column) -> Column:
    """struct<carry, digits>: limbs (lowest first, of any sign) as digits below 2**32."""
    state = lambda carry, digits: F.struct(carry.alias("carry"), digits.alias("digits"))
    step = lambda a, v: let(a.carry + v, lambda t: state(F.shiftright(t, LIMB), F.array_append(a.digits, t.bitwiseAND(F.lit(_MASK)))))
    return F.aggregate(sums, state(F.lit(0).cast("long"), F.array().cast("array<bigint>")), step)


def _rounded(digits: Column) -> Column:
    """The double next to digits (lowest first, below 2**32), ties to even."""
    none = F.lit(0).cast("long")
    of = lambda d, top, k: F.coalesce(F.when(top >= k, F.get(d, top - k)), none)
    top = lambda d: F.aggregate(F.sequence(F.lit(0), F.size(d) - 1), F.lit(-1), lambda a, i: F.when(F.get(d, i) != 0, i).otherwise(a))
    lower = lambda d, t: F.exists(F.slice(d, 1, F.greatest(F.lit(0), t - 2)), lambda v: v != 0)
    found = let(digits, lambda d: let(top(d), lambda t: F.struct(t.alias("top"), of(d, t, 0).alias("a"), of(d, t, 1).alias("b"), of(d, t, 2).alias("c"), lower(d, t).alias("lower"))))
    return let(found, lambda p: let(F.length(F.bin(p.a)), lambda bits: _near(p, bits)))


def _near(p: Column, bits: Column) -> Column:
    """Rounds three highest digits a, b and c, the first of so many bits."""
    few = bits <= _KEPT - LIMB  # the third digit has a part in the kept bits
    drop = F.when(few, bits + (2 * LIMB - _KEPT)).otherwise(bits - (_KEPT - LIMB))
    below = lambda v, n: v - _left(_right(v, n), n)

    def kept(n):
        high = _left(p.a, _KEPT - bits)
        long = high + F.when(few, _left(p.b, _KEPT - LIMB - bits) + _right(p.c, n)).otherwise(_right(p.b, n))
        lost = p.lower | F.when(few, below(p.c, n) != 0).otherwise((below(p.b, n) != 0) | (p.c != 0))
        return long.bitwiseOR(F.when(lost, F.lit(1)).otherwise(F.lit(0)).cast("long"))

    large = _scaled(let(drop, kept).cast("double"), p.top * LIMB + bits + (LOWEST - _KEPT))
    return F.when(p.top < 0, 0.0).when(p.top == 0, _scaled(p.a.cast("double"), F.lit(LOWEST))).otherwise(large)  # one digit is exact


def _total(sums: Column) -> Column:
    """The double of limb sums, an array<long> of LIMBS entries, lowest first."""
    sign = lambda s: F.when(_carried(s).carry < 0, F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return let(sums, lambda s: let(sign(s), lambda by: by * _rounded(_carried(F.transform(s, lambda v: v * by)).digits)))


def _finished(pairs: Column, marks: Column, n: Column) -> Column:
    """The sum from limb sums (array<struct<limb,v>>, each limb once), ``marks`` (bits 1
    NaN, 2 infinity, 4 its negative) and the number of values."""
    dense = let(F.map_from_entries(pairs), lambda m: F.transform(F.sequence(F.lit(0), F.lit(LIMBS - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0).cast("long"))))
    odd = F.when(marks.isin(1, 3, 5, 6, 7), F.lit(float("nan"))).when(marks == 2, F.lit(float("inf"))).when(marks == 4, F.lit(float("-inf")))
    return F.when(n > 0, F.when(marks > 0, odd).when(F.size(pairs) == 0, 0.0).otherwise(_total(dense)))


def _mark(x: Column) -> Column:
    return F.when(F.isnan(x), 1).when(x == float("inf"), 2).when(x == float("-inf"), 4).otherwise(0)


def exact_sums(rows: DataFrame, keys: list[str], value: str, into: str = "sum") -> DataFrame:
    """``keys`` and the exact sum of ``value`` for each group of ``rows``. A value is one row,
    by the lowest of its three limbs, and limbs are added in the tasks first; a group is at
    most LIMBS rows after the shuffle.

    The place is found from a logarithm that may be off by one beside a power of two, so
    one bit more is kept below; by powers of two a size is scaled, and cut in whole
    numbers of 32 bits, without rounding; its sign is put to each."""
    x, limb = F.col("__x"), F.col("__limb")
    given = rows.select(*keys, F.col(value).cast("double").alias("__x")).where(x.isNotNull()).withColumn("__mark", _mark(x))
    finite = (F.col("__mark") == 0) & (x != 0)
    lowest = F.greatest(F.floor((F.floor(F.log2(F.abs(x))) - MANTISSA - LOWEST) / LIMB), F.lit(0).cast("long"))
    placed = given.withColumn("__limb", F.when(finite, lowest.cast("int")).otherwise(-1))
    # half the power twice: the whole one may be beyond the largest double
    half = _two(-(limb * LIMB + LOWEST) / 2)
    whole = placed.withColumn("__half", half).withColumn("__y", F.when(limb >= 0, F.abs(x) * F.col("__half") * F.col("__half")).otherwise(0.0))
    high = whole.withColumn("__c", F.floor(F.col("__y") / 2.0 ** (2 * LIMB)))
    rest = high.withColumn("__y", F.col("__y") - F.col("__c") * 2.0 ** (2 * LIMB))
    middle = rest.withColumn("__b", F.floor(F.col("__y") / 2.0**LIMB))
    low = middle.withColumn("__a", (F.col("__y") - F.col("__b") * 2.0**LIMB).cast("long"))
    signed = lambda c: F.sum(F.when(x < 0, -F.col(c)).otherwise(F.col(c))).alias(c)
    sums = low.groupBy(*keys, "__limb").agg(*[signed(c) for c in ("__a", "__b", "__c")], F.count(F.lit(1)).alias("__n"), F.bit_or("__mark").alias("__mark"))
    one = lambda i, c: F.struct((limb + i).alias("limb"), F.col(c).alias("v"))
    parts = F.collect_list(F.when(limb >= 0, F.array(one(0, "__a"), one(1, "__b"), one(2, "__c"))))
    met = sums.groupBy(*keys).agg(F.flatten(parts).alias("__own"), F.bit_or("__mark").alias("__mark"), F.sum("__n").alias("__n"))
    own = lambda p, i: F.aggregate(F.filter(p, lambda e: e.limb == i), F.lit(0).cast("long"), lambda a, e: a + e.v)
    merged = let(F.col("__own"), lambda p: F.transform(F.array_distinct(F.transform(p, lambda e: e.limb)), lambda i: F.struct(i.alias("limb"), own(p, i).alias("v"))))
    return met.select(*keys, _finished(merged, F.col("__mark"), F.col("__n")).alias(into))


def exact_array_sum(values: Column) -> Column:
    """The exact sum of a short array of doubles. One value is its own sum, and two are
    added with one rounding by the processor. Up to 512 values of a share's size (2**-10 to
    1) are cut in two at 2**-31: both halves add up as integers, the halves' sums are exact
    doubles, and adding these is the one rounding."""
    zero = F.lit(0).cast("long")
    own = lambda parts, i: F.aggregate(parts, zero, lambda a, p: a + F.when(p.limb == i, p.v).otherwise(zero))
    pairs = lambda parts: F.transform(F.array_distinct(F.transform(parts, lambda p: p.limb)), lambda i: F.struct(i.alias("limb"), own(parts, i).alias("v")))
    marks = lambda given: F.aggregate(F.transform(given, _mark), F.lit(0), lambda a, m: a.bitwiseOR(m))
    finite = lambda given: F.flatten(F.transform(F.filter(given, lambda v: _mark(v) == 0), limbs))
    whole = lambda given: _finished(let(finite(given), pairs), marks(given), F.size(given))
    few = lambda given: F.when(F.size(given) == 1, given[0]).when(F.size(given) == 2, given[0] + given[1])
    half = float(1 << 31)
    upper = lambda given: F.aggregate(given, zero, lambda a, v: a + F.floor(v * half))
    lower = lambda given: F.aggregate(given, zero, lambda a, v: a + ((v * half - F.floor(v * half)) * half).cast("long"))
    shares = lambda given: (upper(given).cast("double") * half + lower(given).cast("double")) / (half * half)
    small = lambda given: F.size(given).between(3, 512) & F.forall(given, lambda v: v.between(2.0**-10, 1.0))
    return let(F.filter(values, lambda v: v.isNotNull()), lambda given: F.when(F.size(given).between(1, 2), few(given)).when(small(given), shares(given)).otherwise(whole(given)))


def share_limbs(v: Column) -> list[Column]:
    """Three whole numbers of a double of 0 to 1 without bits below 2**-93, for sums (``shares_sum``)."""
    half = float(1 << 31)
    rest = v * half - F.floor(v * half)
    return [F.floor(v * half), F.floor(rest * half), F.floor((rest * half - F.floor(rest * half)) * half)]


def shares_sum(high: Column, middle: Column, low: Column) -> Column:
    """The double next to the sum whose limbs add up to these, of up to 2**21 values. The
    lowest limb is 0 unless a value is below 2**-10, so mostly one addition is the only rounding."""
    half = float(1 << 31)
    two = lambda power: F.lit(1 << power).cast("decimal(20,0)")
    whole = (high.cast("decimal(17,0)") * two(31) + middle.cast("decimal(17,0)")).cast("decimal(28,0)") * F.lit(1 << 31).cast("decimal(10,0)") + low.cast("decimal(17,0)")
    return F.when(low == 0, (high.cast("double") * half + middle.cast("double")) / (half * half)).otherwise(whole.cast("double") / (half * half * half))
