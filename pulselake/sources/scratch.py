"""A folder for what queries store on the way: shared, or local in local mode."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from pulselake.sources import keyed

_OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that spark.checkpoint.dir names; below a local one only where that is unset in local mode. It
    is deleted when the driver exits."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master, app = spark.sparkContext.master, spark.sparkContext.applicationId
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="pulselake-")
        root = _OWN[app]
    path = f"{root.rstrip('/')}/pulselake/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        keyed.drop(spark, path)
    except Exception:  # noqa: BLE001 - the session is already gone; nothing is left to clean with
        return
