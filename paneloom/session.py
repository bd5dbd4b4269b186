"""Session settings the operators rely on, and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

#: The folder of the innermost open scope.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings the operators count on and make sure a checkpoint folder is set."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # A hot key is split even when that costs one more exchange further down.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    checkpoint_folder(spark)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        named = tempfile.mkdtemp(prefix="paneloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for tables written on the way: below the open scope's folder, else below the checkpoint folder."""
    base = _SCOPE.get() or checkpoint_folder(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope: tables that are written on the way inside it are deleted when it ends.

    Results that are still to be read belong inside. Scopes may be nested. Outside of any scope such tables stay as long
    as the checkpoint folder does.
    """
    folder = shared_folder(spark, "scratch")
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
