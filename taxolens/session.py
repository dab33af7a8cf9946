"""What a session needs before Python functions of this package run on executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per Spark context, as ``--py-files`` would:
    functions are looked up there by name, whatever the path of the driver was."""
    context = spark.sparkContext
    if getattr(context, "_taxolens_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="taxolens-")) / "taxolens.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._taxolens_shipped = True


def run_dir(spark: SparkSession) -> str:
    """The folder of this Spark context's intermediate tables and files."""
    context = spark.sparkContext
    if not getattr(context, "_taxolens_run", None):
        context._taxolens_run = f"{shared_dir(spark)}/taxolens/run-{uuid.uuid4().hex}"
    return context._taxolens_run


def clear(spark: SparkSession) -> None:
    """Delete what this context has put into the shared folder. Results that are still
    read from there must have been written elsewhere first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine, as in tests, is one made,
    which goes when Python ends; on a cluster that is an error, for executors would each
    write to a disk of their own."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("taxolens.local.shared", None)
        if not found:
            master = spark.sparkContext.master
            if not re.match(r"local($|\[)", master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
            path = tempfile.mkdtemp(prefix="taxolens-shared-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            found = f"file://{path}"
            spark.conf.set("taxolens.local.shared", found)
    return found.rstrip("/")


def local_path(uri: str) -> str:
    """``file:`` URIs as plain paths; others as they are."""
    for prefix in ("file://", "file:"):
        if uri.startswith(prefix):
            return "/" + uri[len(prefix) :].lstrip("/")
    return uri


def open_shared(uri: str, mode: str):
    """Open a file of the shared folder on an executor, by pyarrow's file systems
    where it isn't a local mount. Writers get a name of their own and rename."""
    path = local_path(uri)
    if "://" not in path:
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)  # noqa: SIM115
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner) if "w" in mode else system.open_input_file(inner)
