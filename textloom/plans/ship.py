"""Sending this package to the executors, so that they can import it wherever they run."""

from __future__ import annotations

import atexit
import os
import tempfile
import weakref
import zipfile

from pyspark import SparkContext
from pyspark.sql import SparkSession

_SENT: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files once; the driver serves the archive to the executors."""
    context = spark.sparkContext
    if context in _SENT:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    fd, path = tempfile.mkstemp(prefix="textloom-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join(os.path.basename(home), os.path.relpath(full, home)))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.unlink(path))  # executors that start late fetch it too
    _SENT.add(context)
