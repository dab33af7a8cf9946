"""URL filters: longest-rule decisions, then a Bloom filter cascade over hosts.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the
longest fitting rule wins. Urls without a rule are judged by a key, their registered
name or their page (host and path): the cascade's first level holds the listed keys, the second the unlisted keys of
the corpus that the first lets through, the third the listed keys that the second
lets through, and so on until a level lets nothing wrong through. Over the key
universe it was built for, membership is exact, without joining urls to the list.

The list is a table of keys, of any length; the universe is every key of the corpus, so
nothing outside it is ever asked. Building is distributed: keys and their bit positions
stay in DataFrames, and each level of each shard (``SHARD_KEYS`` listed keys) is written as
a file to the shared folder. The driver gets a path and a size a file. Workers read the
files of the shards that their rows ask for and keep the last ``FILES_KEPT`` of them.

Defined cases: a null or empty url or one without ``://`` has an empty host and path, fits
no rule and is allowed; of rules of one length that fit, the last in order of host and path
wins; repeated urls are each judged, repeated and null keys of the list count once and
never; a very long url is matched as it is; input columns named host, path, rule, verdict
or listed are replaced, all others stay; a table without rows gives none, an empty list
blocks nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import fresh_path, keep, open_shared, publish, release

# Fixed values: (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARD_KEYS = 1 << 20
#: Files of 1.25 MB and less that a worker keeps.
FILES_KEPT = 64
BITS_PER_KEY = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: str) -> tuple[Column, Column]:
    """Host and path of the url in the named column; both empty where it has none."""
    u = f"`{url}`"
    rest = F.expr(f"if(instr({u}, '://') > 0, substring({u}, instr({u}, '://') + 3), '')")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=tuple(RULES)) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` text, and its verdict; else nulls."""
    said = said_verdict = F.lit(None).cast("string")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        said, said_verdict = F.when(fits, h + p).otherwise(said), F.when(fits, verdict).otherwise(said_verdict)
    return said, said_verdict


def site(host: Column, path: Column | None = None) -> Column:
    """A key for whole sites: the last three labels of the host."""
    return F.substring_index(host, ".", -3)


def page(host: Column, path: Column) -> Column:
    """A key for single pages: host and path."""
    return F.concat(host, path)


#: Hash functions of a level.
K = 4


@dataclass
class Cascade:
    """``levels[i][shard]`` is (bits, path of the filter); keys go to ``hash % shards``."""

    shards: int
    levels: list[dict[int, tuple[int, str]]]


def _hashes(key: Column, levels: range) -> Column:
    return F.array(*[F.xxhash64(key, F.lit(x)) for level in levels for x in range(K * level, K * level + K)])


def _write(sizes: dict[int, int], folder: str):
    """Words of a level's filters (shard, word, bits) as files: rows (shard, path)."""

    def write(batches):
        filters: dict[int, np.ndarray] = {}
        for batch in batches:
            shard, word, bits = (batch.column(i).to_numpy() for i in range(3))
            for s in np.unique(shard).tolist():
                own = filters.setdefault(s, np.zeros((sizes[s] + 63) // 64, np.int64))
                own[word[shard == s]] = bits[shard == s]
        paths = []
        for s, own in filters.items():
            paths.append(f"{folder}/shard-{s:06d}.bits")
            publish(paths[-1], own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(list(filters), pa.int32()), pa.array(paths, pa.string())], ["shard", "path"])
        release()

    return write


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS, max_levels: int = 40) -> Cascade:
    """The cascade over the distinct ``key`` column of ``universe``; ``listed`` has the
    keys that are listed, in its column ``key``."""
    spark = universe.sparkSession
    known = listed.where(F.col("key").isNotNull()).select("key", F.lit(True).alias("named")).distinct()
    keys = universe.where(F.col("key").isNotNull()).select("key").distinct().join(known, "key", "left").select("key", F.coalesce("named", F.lit(False)).alias("listed"))
    keys = keep(keys, "cascade-keys")
    shards = max(1, math.ceil(keys.where("listed").count() / shard_keys))
    keys = keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    inside, outside = keys.where("listed").select("key", "shard"), keys.where("not listed").select("key", "shard")
    levels: list[dict[int, tuple[int, str]]] = []
    for level in range(max_levels):
        count = dict(inside.groupBy("shard").count().collect())  # a number a shard
        if not count:
            return Cascade(shards, levels)
        sizes = {s: max(64, BITS_PER_KEY * c) for s, c in count.items()}
        size = F.create_map(*[F.lit(x) for p in sizes.items() for x in p])[F.col("shard")].cast("long")
        at = F.transform(_hashes(F.col("key"), range(level, level + 1)), lambda h: F.pmod(h, size))
        words = keep(
            inside.select("shard", F.explode(at).alias("at"))
            .groupBy("shard", F.shiftright("at", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits")),
            "cascade-words",
        )
        files = words.repartition(len(sizes), "shard").mapInArrow(_write(sizes, fresh_path(spark, f"cascade-{level}")), "shard int, path string").collect()  # a path a shard
        levels.append({r.shard: (sizes[r.shard], r.path) for r in files})
        # which of the others are let through: their bits joined with the level's words
        passed = (
            outside.where(F.col("shard").isin(*sizes)).select("key", "shard", F.explode(F.array_distinct(at)).alias("at"))
            .withColumn("word", F.shiftright("at", 6))
            .join(words, ["shard", "word"], "left")
            .groupBy("key", "shard")
            .agg(F.bool_and(F.coalesce(F.expr("(shiftright(bits, cast(at % 64 as int)) & 1L) = 1L"), F.lit(False))).alias("passed"))
            .where("passed").select("key", "shard")
        )
        inside, outside = keep(passed, f"cascade-{level + 1}"), inside
    raise RuntimeError(f"the cascade has not ended after {max_levels} levels")


@lru_cache(maxsize=FILES_KEPT)
def _bits(path: str) -> np.ndarray:
    """A worker's own copy of a filter, for its next batches and tasks too."""
    with open_shared(path, "rb") as f:
        return np.frombuffer(f.read(), np.uint64)


def _member(levels: list[dict[int, tuple[int, str]]]):
    """Arrow UDF of a shard and a key's hashes: is the key listed? A key's answer is
    the parity of the first level that does not hold it."""

    @F.arrow_udf("boolean")
    def member(shard: pa.Array, hashes: pa.Array) -> pa.Array:
        sh = shard.to_numpy(zero_copy_only=False)
        h = hashes.flatten().to_numpy(zero_copy_only=False).reshape(len(sh), -1)
        answer = np.zeros(len(sh), bool)
        for s in np.unique(sh).tolist():
            own = np.flatnonzero(sh == s)
            for i, level in enumerate(levels):
                if s not in level or not own.size:
                    break
                m, path = level[s]
                words, ok = _bits(path), np.ones(own.size, bool)
                for j in range(K):
                    at = h[own, K * i + j] % np.int64(m)
                    ok &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
                own = own[ok]
                answer[own] = i % 2 == 0
        return pa.array(answer)

    return member


def listed_mask(df: DataFrame, key: Column, cascade: Cascade, into: str = "listed") -> DataFrame:
    """``df`` with a boolean column more: is the key on the list? No join."""
    if not cascade.levels:
        return df.withColumn(into, F.lit(False))
    shard = F.pmod(F.xxhash64(key), F.lit(cascade.shards)).cast("int")
    return df.withColumn(into, F.coalesce(_member(cascade.levels)(shard, _hashes(key, range(len(cascade.levels)))), F.lit(False)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=tuple(RULES), key: Callable[[Column, Column], Column] = site) -> DataFrame:
    """``pages`` (with ``url``) plus host, path, rule, verdict and listed. ``listed`` is the
    table of blocked keys (``key``), which are made by ``site`` or ``page``."""
    host, path = host_path("url")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    parts = pages.drop("host", "path", "rule", "verdict", "listed").withColumns({"host": host, "path": path})
    own = key(F.col("host"), F.col("path"))
    universe = parts.where("host <> ''").select(own.alias("key"))
    judged = listed_mask(parts, own, build(universe, listed))
    return judged.withColumns({"listed": F.col("listed") & (F.col("host") != ""), "rule": rule}).withColumn(
        "verdict", F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow"))
    )
