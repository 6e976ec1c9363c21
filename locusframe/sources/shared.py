"""Folder for files that queries write and read back: the one that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[tuple[str, str], str] = {}


def _checkpoints(spark: SparkSession) -> str | None:
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root and (root.removeprefix("file://") if root.startswith("file://") else root.removeprefix("file:"))


def parts_root(spark: SparkSession, path: str) -> str | None:
    """A folder in which executors can leave parts of the driver's file ``path``; None if there is none."""
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return os.path.dirname(os.path.abspath(path))
    root = _checkpoints(spark)
    return None if not root or "://" in root else root


def folder(spark: SparkSession, name: str) -> str:
    """A folder of this session for files of one kind, made once. On a cluster ``spark.checkpoint.dir`` must name a
    shared local folder, as the text writers here write local files."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        root = _checkpoints(spark)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = tempfile.gettempdir()
        if "://" in root:
            raise ValueError("the text writers need a spark.checkpoint.dir in a local file system")
        _made[key] = os.path.join(root, f"files-{uuid.uuid4().hex}")
        os.makedirs(_made[key])
    return _made[key]
