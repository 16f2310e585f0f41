"""Cutting lineage with tables in the folder that all executors share.

Iterative operators write an intermediate result once and go on from the
written table, so that a lost executor costs a read and not the whole history.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list["Workspace"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark is local."""
    said = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if said:
        return said.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Workspace:
    """Written intermediate tables of one operator call; they live until ``close`` or the end of the process."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.names = 0
        _OPEN.append(self)

    def cut(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        """``df`` written as parquet and read again; the new frame has no history but the files."""
        path = f"{self.root}/{self.names}"
        self.names += 1
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._textloom_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, df: DataFrame | None) -> None:
        """Deletes the table behind a frame returned by ``cut``."""
        path = getattr(df, "_textloom_path", None)
        if path:
            self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass
        if self in _OPEN:
            _OPEN.remove(self)


@atexit.register
def _close_all() -> None:
    for workspace in list(_OPEN):
        workspace.close()
