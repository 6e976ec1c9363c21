"""Shared scratch space for cutting lineage.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names, which driver and executors
share; they survive a lost executor because they are ordinary Parquet files.  Only where the setting is
absent and the session runs on one machine (unit tests) a temporary folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder of this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="locusframe-scratch-")
    return _own["dir"]


#: Most rows and bytes of one Arrow batch: two workers an executor hold some of them at once, whole texts in them.
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to the ones above. They stay so, as results are read later on."""
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int("".join(c for c in spark.conf.get(key, "0") if c.isdigit()) or 0) if name == "maxRecordsPerBatch" else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


class Scratch:
    """A folder of one query run. ``cut`` writes a table and reads it back; the folder goes at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        small_batches(spark)
        atexit.register(self.clear)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{label}"

    def cut(self, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        """Write df as Parquet in the shared folder and return it as read from there."""
        at = self.path(label)
        df.write.option("compression", codec).parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._scratch = (self, at)
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove the files of a table made by cut, once nothing reads it any more."""
        _, at = getattr(df, "_scratch", (None, None))
        if at:
            self._delete(at)

    def _delete(self, at: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Remove the whole folder; harmless once the session has ended."""
        try:
            self._delete(self.root)
        except Exception:  # the gateway is gone: there is no session to clean for
            return
