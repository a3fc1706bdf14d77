"""A Spark session with the settings that the library expects, and checkpoints in a folder that all machines reach."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "brightloom", **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow; other settings come from the caller or the cluster."""
    builder = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints, which all machines reach. Local mode may use one of its own; a cluster must name one in
    spark.checkpoint.dir."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written once, so that lineage ends and lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """The same rows; Python functions over them find this package on every executor, wherever the driver was started."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        top = Path(__file__).resolve().parent
        path = os.path.join(tempfile.mkdtemp(), f"{top.name}_library.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(path)
    return df
