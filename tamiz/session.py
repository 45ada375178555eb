"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_shipped: list[str] = []


def local_session(name: str = "tamiz", cpus: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    package = Path(__file__).resolve().parent
    name = f"{package.name}-{spark.sparkContext.applicationId}.zip"
    if any(name in path for path in _shipped):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tamiz-ship-"), name)
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(path)
    _shipped.append(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``).

    Only on a local master may it be unset; then a temporary folder stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tamiz-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared one; dropped when the driver ends."""
    path = f"{shared_dir(spark)}/tamiz-{label}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: lineage ends here, and a
    lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = path or work_dir(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the shuffle files of frames that nothing refers to any more be dropped now, not when the driver next collects garbage."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)  # Spark drops the files in the background


def _drop_work() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:
            pass


atexit.register(_drop_work)
