"""Session helpers: building a local session for tests/bench and resolving
the shared folder that holds state, snapshots and staging tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "tiltframe") -> SparkSession:
    """Session for tests and the local bench. On a cluster the caller builds
    its own session; nothing in the library depends on these settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session (then from the context's checkpoint folder). Where
    neither is set a local session gets a scratch folder of its own; on a
    cluster that is an error, because executors would not see it.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: state and staging tables need a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tiltframe-ckpt-", dir=os.environ.get("TILTFRAME_SCRATCH", "/tmp"))
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def new_run_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one model run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tiltframe`` importable in every Python worker: zip the package
    once per application and hand it to ``SparkContext.addPyFile`` (the
    ``--py-files`` mechanism; Spark serves the file to the executors)."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED or os.environ.get("TILTFRAME_SHIP", "1") == "0":
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="tiltframe-pyfiles-"), "tiltframe.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
