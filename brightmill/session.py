"""Session settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Results are defined in UTC; AQE re-plans shuffles from measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the engine's settings; `master` and sizes are left to the cluster unless given."""
    builder = SparkSession.builder.appName("brightmill")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_SHIPPED: set[str] = set()
_TEMPORARY: dict[str, str] = {}


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once an application, as --py-files would."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A folder that the driver and all executors share, or `name` in it: the one that spark.checkpoint.dir names, or the context's
    checkpoint folder. Only a session on one machine may do without either; it then gets a temporary folder."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _TEMPORARY.get(context.applicationId) or _TEMPORARY.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-"))
    return f"{base.rstrip('/')}/{name}" if name else base
