"""Session helpers: how the package reaches executors, and where shared intermediate tables go."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.abspath(__file__))
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def session(app: str = "sitelake", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the engine is tested under."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Bytes of an Arrow batch between the JVM and a Python worker. Both sides hold a batch or two, and workers that
#: wait for their next task keep what they once took, so Spark's 64 MB weigh on every later stage.
ARROW_BYTES, _DEFAULT_ARROW_BYTES = 8 << 20, 64 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it.

    Arrow batches are bounded by ARROW_BYTES, unless the session has a bound of its own.
    """
    if spark.conf.get(_ARROW_CONF) == f"{_DEFAULT_ARROW_BYTES}b":
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for top, dirs, files in os.walk(_ROOT):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(top, f)
                    z.write(full, os.path.join("sitelake", os.path.relpath(full, _ROOT)))
    path = os.path.join(tempfile.mkdtemp(prefix="sitelake-"), "sitelake.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="sitelake-checkpoint-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, remembered so that release() can delete it."""
    path = f"{shared_dir(spark)}/sitelake/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table of this application; call it when no result that reads them is needed."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        delete(spark, p)
    return len(paths)
