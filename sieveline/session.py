"""Sessions, and the package on the executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


_made: set[str] = set()
_BYTES, _BYTES_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers wherever they run (once for each application).

    Arrow batches are bounded by bytes too, unless the session says otherwise: a number of rows doesn't bound long texts.
    """
    context = spark.sparkContext
    if spark.conf.get(_BYTES, None) == _BYTES_DEFAULT:
        spark.conf.set(_BYTES, str(4 << 20))
    if getattr(context, "_sieveline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._sieveline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder is made in local mode only, and removed when Python ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    path = os.path.join(tempfile.gettempdir(), f"sieveline-{spark.sparkContext.applicationId}")
    if path not in _made:
        _made.add(path)
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
