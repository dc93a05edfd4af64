"""Session construction and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(app: str = "tidemark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_LOCAL_ROOT: dict[str, str] = {}  # one temporary folder per local process


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path under the folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that names no folder (a test) gets a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        if "dir" not in _LOCAL_ROOT:
            _LOCAL_ROOT["dir"] = tempfile.mkdtemp(prefix="tidemark-")
        root = _LOCAL_ROOT["dir"]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ship(spark: SparkSession, *packages: str) -> None:
    """Make this package importable in Python workers that do not have it installed.

    Executors get it as an added file.  Workers of a local session also look in the
    folder it was loaded from.  Further folders of the same source tree may be named.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("to") == sc.applicationId:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    bundle = os.path.join(tempfile.mkdtemp(prefix="tidemark-src-"), "tidemark_src.zip")
    with zipfile.ZipFile(bundle, "w") as z:
        for package in ("tidemark", *packages):
            for folder, _, files in os.walk(os.path.join(here, package)):
                for f in files:
                    if f.endswith(".py"):
                        path = os.path.join(folder, f)
                        z.write(path, os.path.relpath(path, here))
    sc.addPyFile(bundle)
    if sc.master.startswith("local"):
        have = sc.environment.get("PYTHONPATH", "")
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (here, have) if p)
    _SHIPPED["to"] = sc.applicationId


_SHIPPED: dict[str, str] = {}


def cut_lineage(df, purpose: str):
    """Write an intermediate table to the shared folder and read it back.

    Unlike a cached or local checkpoint this survives the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
