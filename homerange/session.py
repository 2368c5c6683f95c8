"""Session helpers.

On a cluster the session comes from the launcher and carries its own
settings; :func:`tune` only fills in what is unset. :func:`get_spark` is for
local runs and tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the operators are written against. AQE re-plans joins from real
# shuffle sizes (broadcast only when the measured side is under the
# threshold), coalesces small partitions and splits skewed join partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Static broadcast decisions use plan statistics against this size.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`DEFAULTS` where the session has no value of its own."""
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A cluster sets ``spark.checkpoint.dir`` to a shared file system and that
    is used. Only a local master without the setting (tests) gets a scratch
    folder; on a cluster the missing setting is an error, since any folder
    chosen here could be local to one machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="homerange-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors through the session's own file service, once
    per application, so that Python tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="homerange-ship-")) / "homerange_tasks.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Have the folder removed when the application ends; it need not exist yet."""
    fs, where = _file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    return it read back.

    This cuts the lineage at a narrow waist of the flow: later plans start
    from files (small plans, exact size statistics for broadcast decisions),
    and a lost executor costs a re-read, not a recomputation of everything
    upstream. One write job; the folder is the one the session names, and it
    is removed when the application ends, or by :func:`discard`."""
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/homerange/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._homerange_table = path
    return out


def discard(df) -> None:
    """Remove the table behind a frame from :func:`materialize`, once no plan
    that reads it will run again."""
    path = getattr(df, "_homerange_table", None)
    if path:
        fs, where = _file_system(df.sparkSession, path)
        fs.delete(where, True)


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "homerange") -> SparkSession:
    """Local session for tests, benchmarks and the driver contract."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("HOMERANGE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
