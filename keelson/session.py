"""Session construction and shared-storage locations.

On a cluster the session is created by the platform; ``get_spark`` only adds
settings that are unset, so cluster values always win.  Scratch output goes
under ``spark.checkpoint.dir`` (a shared folder), never a machine-local temp
directory.  A default checkpoint folder is set only when the session has none,
which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of stages that went out of scope are removed by the context cleaner
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "keelson") -> SparkSession:
    """Return the active session, creating a local one when none exists."""
    active = SparkSession.getActiveSession()
    if active is not None:
        _apply_defaults(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    _apply_defaults(spark)
    return spark


def _apply_defaults(spark: SparkSession) -> None:
    conf = spark.conf
    if conf.get("spark.sql.session.timeZone", None) != "UTC":
        conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared checkpoint folder of the session.

    Read from ``spark.checkpoint.dir``; only when that is unset (local tests)
    a folder is chosen and set on the session and the SparkContext.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; point it at a folder every executor shares")
        root = tempfile.mkdtemp(prefix="keelson-ckpt-")      # local mode only (tests)
        spark.conf.set("spark.checkpoint.dir", root)
    try:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return root


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers when they cannot see its folder: a zip of the sources is added
    to the session once. A platform that installs the package everywhere needs none of this."""
    import io
    import zipfile
    sc = spark.sparkContext
    folder = os.path.dirname(os.path.abspath(__file__))
    if any("keelson" in str(f) for f in sc.listFiles) or folder.startswith(tuple(
            p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)):
        return
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for at, dirs, names in os.walk(folder):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("keelson", os.path.relpath(full, folder)))
    target = os.path.join(tempfile.mkdtemp(prefix="keelson-zip-"), "keelson.zip")     # on the driver; Spark sends it on
    with open(target, "wb") as f:
        f.write(raw.getvalue())
    sc.addPyFile(target)


_SCOPE = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint root, or under the folder of the ``scratch_scope`` around it."""
    root = getattr(_SCOPE, "root", None) or checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def scratch_scope(spark: SparkSession, folder: str) -> Iterator[None]:
    """Scratch folders made inside by this thread lie in ``folder`` and go at the end, after a failure too: for work that repeats, like
    micro-batches. DataFrames that read them must not outlive the scope."""
    before = getattr(_SCOPE, "root", None)
    _SCOPE.root = f"{folder.rstrip('/')}/{uuid.uuid4().hex[:12]}"
    try:
        yield
    finally:
        delete_folder(spark, _SCOPE.root)
        _SCOPE.root = before


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of a folder, wherever it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return fs.exists(p)


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    p, fs = hadoop_path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.sparkContext.defaultParallelism)
    except Exception:
        return int(os.cpu_count() or 8)
