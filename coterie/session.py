"""Session for local use and tests, the shared scratch folder, and the package on executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(app_name: str = "coterie", cores: int | str = "*") -> SparkSession:
    """A local session. On a cluster, pass the cluster's own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table, below the folder the cluster shares.

    The folder is ``spark.checkpoint.dir``. Only a local session may go without
    it: a machine-local folder is invisible to the other machines of a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="coterie-")
    return f"{base.rstrip('/')}/coterie/{name}-{uuid.uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once for a session's context."""
    context = spark.sparkContext
    if not getattr(context, "_coterie_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="coterie-"), "coterie")
        context.addPyFile(shutil.make_archive(target, "zip", root, "coterie"))
        context._coterie_shipped = True
