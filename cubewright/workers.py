"""What the engine needs of the cluster: the package on its executors, and a place for intermediate rows."""

from __future__ import annotations

import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Send the package's sources to the executors, once per application."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        with zipfile.ZipFile(at := f"{folder}/{top.name}.zip", "w") as out:
            for file in sorted(top.rglob("*.py")):
                out.write(file, str(file.relative_to(top.parent)))
        kept = shutil.copy(at, tempfile.mkdtemp(prefix="cubewright-"))
    spark.sparkContext.addPyFile(kept)
    _SHIPPED.add(spark.sparkContext.applicationId)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``, which all executors share, and read from there.

    Where it is unset and all runs on one machine, a temporary folder stands in.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not at and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="cubewright-"))
    return df.checkpoint()
