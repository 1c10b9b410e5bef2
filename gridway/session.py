"""What a session needs before it runs this package's Python on executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the session's executors, once; they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="gridway-ship-")) / "gridway.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A new folder in the one that spark.checkpoint.dir names and driver and executors share; without a name that one itself.

    Where it is unset, a folder of this machine will do only if everything runs on it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridway-shared-")
    return f"{found}/{name}-{uuid.uuid4().hex}" if name else found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder. Unlike a checkpoint it hands on nothing that the optimiser has concluded about df, which would add
    up over the rounds of a loop."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def emptied(df: DataFrame) -> None:
    """Write the folder of a stored table anew without rows, as it is no longer needed."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(folder)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
