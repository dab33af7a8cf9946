"""The best labels of each record, from label matrices in blocks.

Labels come in the order of their ids, ``BLOCK`` to a matrix; what a pass sends to the
tasks is at most ``PASS_BYTES``. In a task, a batch of records meets one block after the
other: a matrix product, then a running maximum, a running sum of exponentials and the
running best labels of each record. So no row is made for a record and a label, and a
record's state is a few numbers. More labels than a pass holds take further passes, whose
states are merged by record.

Labels are ordered by logit at ``COMPARE`` decimals, then by id. Records must be distinct;
a label without a vector has the cosine -1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.session import ship

BLOCK, PASS_BYTES = 4096, 64 << 20
#: Decimals at which logits are compared.
COMPARE = 9
STATE = "work_id string, peak double, mass double, best array<struct<id:string,name:string,logit:double>>"


class Running:
    """Maximum, sum of exponentials and best labels of some records over blocks."""

    def __init__(self, n: int, most: int):
        self.peak, self.mass = np.full(n, -np.inf), np.zeros(n)
        self.most, self.logit, self.label = most, np.full((n, 0), -np.inf), np.zeros((n, 0), np.int64)

    def add(self, logits: np.ndarray, first: int) -> None:
        """A block of logits, a row a record, of labels numbered from ``first``."""
        peak = np.maximum(self.peak, logits.max(1))
        self.mass = self.mass * np.exp(self.peak - peak) + np.exp(logits - peak[:, None]).sum(1)
        self.peak = peak
        every = np.concatenate([self.logit, logits], 1)
        label = np.concatenate([self.label, np.broadcast_to(np.arange(first, first + logits.shape[1]), logits.shape)], 1)
        left, row, found = np.round(every, COMPARE), np.arange(len(every)), []
        for _ in range(min(self.most, every.shape[1])):  # the first of equal ones has the least id
            found.append(left.argmax(1))
            left[row, found[-1]] = -np.inf
        at = np.stack(found, 1)
        self.logit, self.label = every[row[:, None], at], label[row[:, None], at]

    def rows(self, works: pa.Array, ids: list[str], names: list[str | None]) -> pa.RecordBatch:
        best = [[{"id": ids[j], "name": names[j], "logit": x} for j, x in zip(js, xs)] for js, xs in zip(self.label.tolist(), self.logit.tolist())]
        kind = pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("logit", pa.float64())]))
        return pa.RecordBatch.from_arrays([works.cast(pa.string()), pa.array(self.peak), pa.array(self.mass), pa.array(best, kind)], ["work_id", "peak", "mass", "best"])


def _merged(states: DataFrame, most: int) -> DataFrame:
    """States of the same records from several passes as one."""
    met = states.groupBy("work_id").agg(F.max("peak").alias("top"), F.collect_list(F.struct("peak", "mass", "best")).alias("s"))
    order = F.array_sort(F.flatten(F.transform("s", lambda s: F.transform(s.best, lambda b: F.struct((-F.round(b.logit, COMPARE)).alias("key"), b.id.alias("id"), b["name"].alias("name"), b.logit.alias("logit"))))))
    best = F.transform(F.slice(order, 1, most), lambda b: F.struct(b.id.alias("id"), b["name"].alias("name"), b.logit.alias("logit")))
    mass = F.aggregate("s", F.lit(0.0), lambda a, s: a + s.mass * F.exp(s.peak - F.col("top")))
    return met.select("work_id", F.col("top").alias("peak"), mass.alias("mass"), best.alias("best"))


def finished(states: DataFrame) -> DataFrame:
    """(work_id, prediction, confidence, candidates) of states."""
    p = F.transform("best", lambda b: F.struct(b.id.alias("id"), b["name"].alias("name"), (F.exp(b.logit - F.col("peak")) / F.col("mass")).alias("probability")))
    return states.select("work_id", p.alias("candidates")).select("work_id", F.col("candidates")[0].id.alias("prediction"), F.col("candidates")[0].probability.alias("confidence"), "candidates")


def _passes(labels: DataFrame, size: Callable[[dict], int]) -> Iterator[list[dict]]:
    """Labels in the order of their ids, in lists of at most ``PASS_BYTES``."""
    waiting, held = [], 0
    for row in labels.orderBy("option_id").toLocalIterator():
        own = size(row)
        if waiting and held + own > PASS_BYTES:
            yield waiting
            waiting, held = [], 0
        waiting.append(row)
        held += own
    if waiting:
        yield waiting


def by_vectors(records: DataFrame, labels: DataFrame, sharpness: float, most: int = 3) -> DataFrame:
    """``records``: work_id, vector; ``labels``: option_id, option_name, vector. Logits are
    products times ``sharpness``."""
    spark = records.sparkSession
    ship(spark)
    states = None
    for rows in _passes(labels, lambda r: 8 * len(r["vector"] or [])):
        ids, names = [r["option_id"] for r in rows], [r["option_name"] for r in rows]
        given = np.array([r["vector"] is not None for r in rows])
        width = max((len(r["vector"]) for r in rows if r["vector"] is not None), default=0)
        matrix = np.array([r["vector"] if r["vector"] is not None else [0.0] * width for r in rows], float)
        sent = spark.sparkContext.broadcast((ids, names, given, matrix))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, names, given, matrix = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                state = Running(batch.num_rows, most)
                for a in range(0, len(ids), BLOCK):
                    product = vectors @ matrix[a : a + BLOCK].T if matrix.shape[1] else np.zeros((batch.num_rows, len(ids[a : a + BLOCK])))
                    state.add(sharpness * np.where(given[a : a + BLOCK], product, -1.0), a)
                yield state.rows(batch.column("work_id"), ids, names)

        one = records.select(F.col("work_id").cast("string"), "vector").where("vector is not null").mapInArrow(run, STATE)
        states = [*(states or []), one]
    return _result(records, states, most)


def _result(records: DataFrame, states: list[DataFrame] | None, most: int) -> DataFrame:
    if not states:
        return finished(records.sparkSession.createDataFrame([], STATE))
    whole = states[0]
    for more in states[1:]:
        whole = whole.unionByName(more)
    return finished(whole if len(states) == 1 else _merged(whole, most))


def by_function(records: DataFrame, labels: DataFrame, function: Callable, most: int = 3) -> DataFrame:
    """``records``: work_id, text; ``labels``: option_id, option_name. ``function`` turns
    batches of (work_id, text, option_id, option_name) into batches of (work_id, option_id,
    logit), in any sizes, each record's rows together; it is called once a task, and its
    rows are made and used up inside the task."""
    spark = records.sparkSession
    ship(spark)
    states = None
    for rows in _passes(labels, lambda r: len(r["option_id"]) + len(r["option_name"] or "") + 64):
        sent = spark.sparkContext.broadcast(([r["option_id"] for r in rows], [r["option_name"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, names = sent.value
            number = {x: i for i, x in enumerate(ids)}

            def questions() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for work, text in zip(batch.column("work_id").to_pylist(), batch.column("text").to_pylist()):
                        for a in range(0, len(ids), BLOCK):
                            n = len(ids[a : a + BLOCK])
                            yield pa.RecordBatch.from_arrays([pa.array([work] * n, pa.string()), pa.array([text] * n, pa.string()), pa.array(ids[a : a + BLOCK], pa.string()), pa.array(names[a : a + BLOCK], pa.string())], ["work_id", "text", "option_id", "option_name"])

            current, row, left = None, np.full(len(ids), np.nan), len(ids)
            for answer in function(questions()):
                for work, option, logit in zip(*(answer.column(c).to_pylist() for c in ("work_id", "option_id", "logit"))):
                    if work != current:
                        if current is not None and left:
                            raise ValueError(f"labels were omitted for {current}")
                        current, left = work, len(ids)
                        row[:] = np.nan
                    if not np.isnan(row[number[option]]):
                        raise ValueError(f"a label was given twice for {current}")
                    row[number[option]] = logit
                    left -= 1
                    if not left:
                        state = Running(1, most)
                        state.add(row[None], 0)
                        yield state.rows(pa.array([work]), ids, names)
            if current is not None and left:
                raise ValueError(f"labels were omitted for {current}")

        one = records.select(F.col("work_id").cast("string"), "text").mapInArrow(run, STATE)
        states = [*(states or []), one]
    return _result(records, states, most)
