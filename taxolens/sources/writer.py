"""Ordered text files written in two phases: parts by executors, one file at commit.

``spark.write.format("text_parts")`` writes each partition as a part into a staging folder,
with its digest, rows and bytes; commit lists the parts of the attempts that succeeded in
the order of their partitions, abort removes the folder. Only then is the file put
together, part by part with each digest checked, beside the target, and takes its place at
once: until then, and if a task fails for good, what was there stays. No row passes
through the driver's memory. The folder must be one that executors and driver share.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from taxolens.session import ship

_LIST, _CHUNK = "parts.json", 1 << 20


class WriteError(OSError):
    """Parts that are missing or not what their task has written."""


@dataclass
class Part(WriterCommitMessage):
    partition: int
    name: str
    rows: int
    bytes: int
    sha256: str


class PartsWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, rows: Iterator) -> Part:
        task = TaskContext.get()
        name = f"{task.partitionId():08d}-{task.taskAttemptId()}"
        sha, n, size = hashlib.sha256(), 0, 0
        with open(Path(self.folder, name), "xb") as f:
            for row in rows:
                data = row[0].encode()
                f.write(data)
                sha.update(data)
                n, size = n + 1, size + len(data)
        return Part(task.partitionId(), name, n, size, sha.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        fresh = Path(self.folder, f"{_LIST}.{uuid.uuid4().hex}")
        fresh.write_text(json.dumps([vars(p) for p in parts]))
        os.replace(fresh, Path(self.folder, _LIST))

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class TextParts(DataSource):
    """Option: folder. Rows have one column of text, written as it is."""

    @classmethod
    def name(cls):
        return "text_parts"

    def schema(self):
        return "text string"

    def writer(self, schema, overwrite):
        return PartsWriter(self.options["folder"])


class Staged:
    """A folder beside a target, for parts and files that take their places together."""

    def __init__(self, folder: str | os.PathLike):
        self.target = Path(folder)

    def __enter__(self) -> Staged:
        os.makedirs(self.target, exist_ok=True)
        self.folder = self.target / f".taxolens-{uuid.uuid4().hex}"
        self.folder.mkdir()
        return self

    def __exit__(self, *_) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def parts(self, texts: DataFrame, label: str) -> list[dict]:
        """The parts of ``texts`` (one column, in its order), written by executors."""
        spark = texts.sparkSession
        ship(spark)
        spark.dataSource.register(TextParts)
        folder = self.folder / label
        folder.mkdir()
        texts.toDF("text").write.format("text_parts").option("folder", str(folder)).mode("append").save()
        found = json.loads((folder / _LIST).read_text())
        return [p | {"path": str(folder / p["name"])} for p in found]

    def joined(self, parts: list[dict], name: str, before: str = "", after: str = "") -> str:
        """Parts as one file of this folder, each with its digest checked; gives the
        digest of the whole."""
        whole = hashlib.sha256()
        with open(self.folder / name, "xb") as f:

            def put(data: bytes) -> None:
                f.write(data)
                whole.update(data)

            put(before.encode())
            for p in parts:
                own = hashlib.sha256()
                with open(p["path"], "rb") as part:
                    while data := part.read(_CHUNK):
                        own.update(data)
                        put(data)
                if own.hexdigest() != p["sha256"]:
                    raise WriteError(f"a part of {name} isn't what its task has written")
            put(after.encode())
            f.flush()
            os.fsync(f.fileno())
        return whole.hexdigest()

    def publish(self, *names: str) -> None:
        """Files of this folder take their places."""
        for name in names:
            os.replace(self.folder / name, self.target / name)


def mapped(rows: DataFrame, line: Callable[[dict], str]) -> DataFrame:
    """A text for each row, made in Arrow batches on executors; the order stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line(r) for r in batch.to_pylist()], pa.string())], ["text"])

    return rows.mapInArrow(run, "text string")


def csv_line(values) -> str:
    line = io.StringIO()
    csv.writer(line).writerow(values)
    return line.getvalue()


def write_csv(path: str | os.PathLike, df: DataFrame) -> None:
    """A table of any size as one CSV file, in the order of ``df``."""
    path, names = Path(path), df.columns
    with Staged(path.parent) as stage:
        parts = stage.parts(mapped(df, lambda r: csv_line([r[c] for c in names])), "rows")
        stage.joined(parts, path.name, csv_line(names))
        stage.publish(path.name)


def listed(stage: Staged, name: str, head: str, tail: str, rows: DataFrame, text: Callable[[dict], str]) -> list[dict]:
    """A file of ``stage``: ``head``, then a text for each row with commas between, then
    ``tail``. Gives the parts of the rows."""
    parts = stage.parts(mapped(rows, lambda r: ",\n" + text(r)), name + "-rows")
    stage.joined(parts, name + "-joined")
    with open(stage.folder / (name + "-joined"), encoding="utf-8", newline="") as made, open(stage.folder / name, "x", encoding="utf-8", newline="") as whole:
        made.read(2)  # no comma before the first
        whole.write(head + "\n")
        shutil.copyfileobj(made, whole)
        whole.write("\n" + tail)
    return parts


def write_json_list(path: str | os.PathLike, head: dict, key: str, rows: DataFrame) -> int:
    """A JSON document of any size: the fields of ``head``, then ``key`` with a list of the
    rows, each on a line, in the order of ``rows``. Gives the number of rows."""
    path = Path(path)
    before, after = (json.dumps(head | {key: []}, ensure_ascii=False, indent=2, allow_nan=False) + "\n").rsplit("[]", 1)
    with Staged(path.parent) as stage:
        parts = listed(stage, path.name, before + "[", "  ]" + after, rows, lambda r: "    " + json.dumps(r, ensure_ascii=False, allow_nan=False))
        stage.publish(path.name)
    return sum(p["rows"] for p in parts)
