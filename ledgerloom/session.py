"""Session settings, and the package on the executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def build(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, adaptive plans, skew joins split at run time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_folders: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share, deleted at exit or by drop(). Where that is unset, one of our own in local
    mode and an error elsewhere."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}/{label}"
    _folders[path] = spark
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system and path of a location, in the driver."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop(path: str) -> None:
    """Delete a folder of scratch()."""
    fs, at = file_system(_folders.pop(path), path.rsplit("/", 1)[0])
    fs.delete(at, True)


@atexit.register
def _drop_all() -> None:
    while _folders:
        try:
            drop(next(iter(_folders)))
        except Exception:  # noqa: BLE001  at exit the JVM may be gone
            return


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in a folder of scratch(): it is computed once, and survives the loss of executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that it need not be installed there."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark
