"""Sessions, shared folders and shipping of this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent

#: Bytes of an Arrow batch that goes to Python; long texts make batches of many rows large.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def session(app: str = "coppice", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators expect; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Readies a session for this package's Python workers.

    Batches are bounded in bytes where the session still has Spark's default, and the package
    is sent along where the workers' path does not already have it.
    """
    if spark.conf.get(_BATCH_CONF) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH_CONF, f"{BATCH_BYTES}b")
    have = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and (Path(p) / _ROOT.name).resolve() == _ROOT for p in have):
        return
    context = spark.sparkContext
    if getattr(context, "_coppice_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in _ROOT.rglob("*.py"):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(archive)
    context._coppice_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset and everything runs here.

    Raises on a cluster without that setting: other machines do not see a folder of this one.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"coppice-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def removed(spark: SparkSession, path: str) -> None:
    """Removes a file or folder wherever Spark's file systems reach it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialises ``df`` in the shared folder and cuts its lineage there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
