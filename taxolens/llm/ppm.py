"""Language-model scoring by prediction by partial matching over bytes.

A text is its words joined by one space (A-Z lower-cased), then an end byte. The model
is the byte-context trie of the training rows: how often each byte follows each context
of up to ``ORDER`` bytes, counted over all of them. A byte is coded in the longest
context that the trie has. If the byte was seen there, it costs ``n / (total + kinds)``
of the mass; if not, an escape costs ``kinds / (total + kinds)`` and the next shorter
context decides with the symbols already excluded, down to a uniform order -1 over 256.

Counting is distributed: tasks pre-aggregate distinct (context, byte) pairs; shorter
contexts come from all pairs by sums. Only the costs of the most frequent pairs of full
order travel to the workers (at most ``HEAD_PAIRS``, whatever the corpus), in files of the
shared folder that tasks write, so the driver holds names only; all other pairs of a text,
seen or not, are joined by code with costs that come from all pairs of all orders.

Word counts for the base score are kept by a 64-bit hash of the word. The most frequent
``HEAD_WORDS`` travel with the scorer; rarer words (each in few documents, so no task is
hot) are joined by hash.

Defined cases: null and empty texts have only the end token; without training rows the
base counts are zero and the model is uniform; repeated rows are scored each; ties in
count at the edge of what travels stay behind together; a long text is scored in pieces
of bounded size; columns named like a result are replaced by it, all others but the text
stay; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import fresh_path, keep, open_shared, publish, quoted, release, small_batches, unused, utf8
from taxolens.llm.hashing import Lookup, hashed_words

ORDER = 5
#: Pairs of full order and words that travel with the scorer: 24 bytes each.
HEAD_PAIRS, HEAD_WORDS = 1 << 20, 1 << 18
#: They lie in so many files at most.
HEAD_FILES = 16
#: The end of a text; no word has it. It also fills the contexts before the first byte.
END = 10
#: Hash that stands for the end token.
END_HASH = np.int64(0)
FOLDS, HELD_OUT = 5, 1
#: A task forwards its counts when it has so many distinct ones.
FLUSH = 1 << 20
#: Bytes counted or scored in one piece.
PIECE = 1 << 20


def fold(column: str = "doc_id"):
    """Spark column: crc32 of the id as text mod 5 (null ids: 0)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS, F.lit(0))


def grams(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes of (context, byte) for every byte of every text and its end; and where
    each text's codes begin (one entry more than texts)."""
    pad = bytes([END]) * order
    data = np.frombuffer(b"".join([pad + t + bytes([END]) for t in texts]), np.uint8)
    code = np.zeros(data.size - order, np.int64)
    for k in range(order + 1):
        code |= data[k : data.size - order + k].astype(np.int64) << (8 * (order - k))
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + order)])[:-1]
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    return code[at], np.concatenate([[0], np.cumsum(sizes)])


def _canonical(words: list[bytes]) -> bytes:
    return b" ".join(words)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n): occurrences of each pair of full order in ``text``."""

    def count(batches):
        codes, numbers, held = [], [], 0

        def fold_up():
            c, n = np.concatenate(codes), np.concatenate(numbers)
            distinct, at = np.unique(c, return_inverse=True)
            return distinct, np.bincount(at, n, distinct.size).astype(np.int64)

        for batch in batches:
            texts = [_canonical(t.lower().split()) for t in utf8(batch.column(0))]
            i = 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (size == 0 or size + len(texts[j]) < PIECE):
                    size, j = size + len(texts[j]), j + 1
                c, n = np.unique(grams(texts[i:j], order)[0], return_counts=True)
                codes.append(c)
                numbers.append(n)
                held, i = held + c.size, j
                if held >= FLUSH:
                    c, n = fold_up()
                    codes, numbers, held = [c], [n], c.size
                    if held >= FLUSH // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["code", "n"])
                        codes, numbers, held = [], [], 0
        if codes:
            c, n = fold_up()
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["code", "n"])
        release()

    return docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _threshold(counts: DataFrame, most: int, n: str = "n") -> int:
    """The least count (column ``n``) with which at most ``most`` rows remain."""
    bins = counts.groupBy(F.floor(F.log2(F.col(n).cast("double")) * 16).alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("low")).orderBy(F.desc("bin")).collect()  # at most 16 rows a doubling
    total, low = 0, 1
    for r in bins:
        if total + r["rows"] > most:
            return low if total else r["low"] + 1
        total, low = total + r["rows"], r["low"]
    return low


def gram_tables(docs: DataFrame, order: int = ORDER) -> list[DataFrame]:
    """(code, n) of all pairs of the texts of ``docs``, by order."""
    tables = [keep(count_grams(docs, order), "grams")]
    for k in reversed(range(order)):  # sums over longer contexts
        short = tables[0].groupBy(_last(k).alias("code")).agg(F.sum("n").alias("n"))
        tables.insert(0, keep(short, "grams-short") if k >= 1 else short)
    return tables


def _last(k: int):
    """Spark column: the pair of order ``k`` that ends a longer pair."""
    return F.col("code").bitwiseAND(F.lit((1 << (8 * (k + 1))) - 1))


def _context(k: int):
    """Spark column: the context of ``k`` bytes of a pair of that order or a longer one."""
    return F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * k)) - 1))


@dataclass
class Head:
    """Frequent keys and what each of them costs."""

    keys: Lookup
    cost: np.ndarray

    @classmethod
    def read(cls, paths: tuple[str, ...]) -> Head:
        keys, costs = [np.zeros(0, np.int64)], [np.zeros(0)]
        for path in paths:
            with open_shared(path, "rb") as f:
                own = np.frombuffer(f.read(), np.int64).reshape(2, -1)
            keys.append(own[0])
            costs.append(own[1].view(np.float64))
        return cls(Lookup(np.concatenate(keys)), np.concatenate(costs))

    def costs(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs (0 outside the head); and which keys are in it."""
        at = self.keys.find(keys)
        known = at >= 0
        value = np.zeros(keys.size)
        value[known] = self.cost[at[known]]
        return value, known


def write_head(rows: DataFrame, label: str) -> tuple[str, ...]:
    """Write keys and costs (two columns) by tasks; the paths of the files."""
    folder = fresh_path(rows.sparkSession, label)

    def write(batches):
        keys, costs = [], []
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            costs.append(batch.column(1).to_numpy().view(np.int64))
        if keys:
            path = f"{folder}/head-{TaskContext.get().partitionId():03d}"
            publish(path, np.concatenate(keys + costs).tobytes())
            yield pa.RecordBatch.from_pydict({"path": [path]})
        release()

    return tuple(sorted(r.path for r in rows.coalesce(HEAD_FILES).mapInArrow(write, "path string").collect()))


#: The heads that a worker has read last, by their paths.
_READ: dict[tuple, tuple[Head, ...]] = {}


def _heads(paths: tuple[tuple[str, ...], ...]) -> tuple[Head, ...]:
    if paths not in _READ:
        _READ.clear()
        _READ[paths] = tuple(Head.read(p) for p in paths)
    return _READ[paths]


def _contexts(table: DataFrame, k: int) -> DataFrame:
    return table.groupBy(_context(k).alias("context")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))


def _seen_costs(tables: list[DataFrame], order: int) -> DataFrame:
    """(code, n, cost) of all pairs of full order."""
    full = tables[order].withColumn("context", _context(order))
    return full.join(_contexts(tables[order], order), "context").select("code", "n", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("cost"))


def _unseen_costs(codes: DataFrame, tables: list[DataFrame], order: int) -> DataFrame:
    """(code, cost) of pairs that full order lacks, through escapes and exclusions. All bytes
    after a context also follow its shorter contexts, so what is excluded in a context
    is what follows the next longer one, if that occurs."""
    part = codes.select("code", F.lit(0.0).alias("cost"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        part = part.withColumns({"context": _context(k), "pair": _last(k)}).join(_contexts(tables[k], k), "context", "left")
        part = part.join(tables[k].select(F.col("code").alias("pair"), "n"), "pair", "left")
        if k < order:
            longer = tables[k + 1].select(_context(k + 1).alias("longer"), _last(k).alias("code")).join(tables[k], "code")
            gone = longer.groupBy("longer").agg(F.sum("n").alias("gone"), F.count(F.lit(1)).alias("out"))
            part = part.withColumn("longer", _context(k + 1)).join(gone, "longer", "left")
        else:
            part = part.withColumns({"gone": F.lit(0), "out": F.lit(0)})
        free = F.col("kinds") - F.coalesce("out", F.lit(0))
        mass = F.col("total") - F.coalesce("gone", F.lit(0)) + free
        more = F.when(F.col("done"), 0.0).when(F.col("n").isNotNull(), F.log10(F.col("n") / mass)).when(free > 0, F.log10(free / mass)).otherwise(0.0)
        # kept: six orders in one plan weigh on the driver
        part = keep(part.select("code", (F.col("cost") + more).alias("cost"), (F.col("done") | F.col("n").isNotNull()).alias("done")), "escapes")
    left = max(1, 256 - tables[0].count())
    return part.select("code", F.when(F.col("done"), F.col("cost")).otherwise(F.col("cost") - float(np.log10(left))).alias("cost"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c): occurrences of each word's hash; the end token is END_HASH."""

    def count(batches):
        held, size, ends = [], 0, 0

        def rows():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "c"])

        for batch in batches:
            for hashes in hashed_words(utf8(batch.column(0))):
                held.append(hashes)
                size, ends = size + hashes.size, ends + 1
                if size > FLUSH:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END_HASH]), pa.array([ends], pa.int64())], ["word", "c"])
        release()

    return docs.select("text").mapInArrow(count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


PART = "n_tokens long, n_known long, head_score double, pair_score double, tail array<long>, times array<int>, pairs array<long>, pair_times array<int>"
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def _scorer(paths: tuple[tuple[str, ...], ...], order: int):
    """An Arrow UDF from texts to PART: what the heads (pairs, words) in the files ``paths``
    say, and what is left to be joined."""
    names = [x.split()[0] for x in PART.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), *[pa.list_(pa.int64()), pa.list_(pa.int32())] * 2]

    @F.arrow_udf(PART)
    def part(column: pa.Array) -> pa.Array:
        head, head_words = _heads(paths)
        texts, out, pieces, at = utf8(column), [], [], 0
        canon = [_canonical(t.lower().split()) for t in texts]
        while at < len(canon):
            to, size = at, 0
            while to < len(canon) and (size == 0 or size + len(canon[to]) < PIECE):
                size, to = size + len(canon[to]), to + 1
            codes, edges = grams(canon[at:to], order)
            value, known = head.costs(codes)
            sums = np.add.reduceat(value, edges[:-1]).tolist()
            for total, a, b in zip(sums, edges[:-1].tolist(), edges[1:].tolist()):
                pieces.append((total, *np.unique(codes[a:b][~known[a:b]], return_counts=True)))
            at = to
        for hashes, (pair_score, pairs, pair_times) in zip(hashed_words(texts), pieces):
            own = np.append(hashes.view(np.int64), END_HASH)
            cost, known = head_words.costs(own)
            tail, times = np.unique(own[~known], return_counts=True)
            out.append((own.size, int(known.sum()), float(cost.sum()), pair_score, tail, times.astype(np.int32), pairs, pair_times.astype(np.int32)))
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

    return part


def score(docs: DataFrame, training: DataFrame, order: int = ORDER, most: int = HEAD_PAIRS, head: int = HEAD_WORDS) -> DataFrame:
    """Columns of ``docs`` but its text, with n_tokens, n_known, train_tokens, base_score
    and score. ``training`` has the rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    words = keep(count_words(training), "words")
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tables = gram_tables(training, order)
    seen = keep(_seen_costs(tables, order), "costs")
    pairs_head = seen.where(F.col("n") >= _threshold(seen, most)).select("code", "cost")
    words_head = words.where(F.col("c") >= _threshold(words, head, "c")).select("word", F.log10(F.col("c") + F.lit(0.5)).alias("cost"))
    heads = write_head(pairs_head, "head-pairs"), write_head(words_head, "head-words")
    below = np.log10(total + 0.5 * (distinct + 1))

    rest = quoted([c for c in docs.columns if c != "text" and c.lower() not in RESULT])
    s, row = unused(docs.columns, "__s"), unused(docs.columns, "__row")
    part = keep(docs.select(*rest, F.monotonically_increasing_id().alias(row), _scorer(heads, order)(F.col("text")).alias(s)), "scored")
    each = lambda a, b: part.select(F.col(row).alias("at"), F.explode(F.arrays_zip(F.col(f"{s}.{a}").alias("k"), F.col(f"{s}.{b}").alias("times"))).alias("t")).select("at", "t.k", "t.times")
    tail = (
        each("tail", "times").join(words, F.col("k") == F.col("word"), "left").groupBy("at")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("tail_score"))
    )
    pairs = keep(each("pairs", "pair_times").select("at", F.col("k").alias("code"), "times"), "pairs")
    unseen = keep(pairs.select("code").distinct().join(seen, "code", "left_anti"), "unseen")
    costs = seen.select("code", "cost").unionByName(_unseen_costs(unseen, tables, order))
    others = pairs.join(costs, "code").groupBy("at").agg(F.sum(F.col("times") * F.col("cost")).alias("pair_score"))
    left = keep(others.join(tail, "at", "full").select("at", "pair_score", "more", "tail_score"), "left").select(F.struct("*").alias(unused(docs.columns, "__left")))
    last = left.columns[0]
    of = lambda c: F.coalesce(F.col(f"{last}.{c}"), F.lit(0))
    return part.join(left, F.col(row) == F.col(f"{last}.at"), "left").select(
        *rest, F.col(f"{s}.n_tokens").alias("n_tokens"), (F.col(f"{s}.n_known") + of("more")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col(f"{s}.head_score") + of("tail_score") - F.col(f"{s}.n_tokens") * F.lit(float(below))).alias("base_score"), (F.col(f"{s}.pair_score") + of("pair_score")).alias("score"),
    )
