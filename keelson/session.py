"""The session the engine expects: UTC, adaptive execution, partitions by cores."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that they need no installed copy of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(here):
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="keelson-"), "keelson"), "zip", os.path.dirname(here), os.path.basename(here))
        context.addPyFile(made)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set and all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rsplit("/", 1)[0]
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def session(master: str | None = None, app: str = "keelson", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()
