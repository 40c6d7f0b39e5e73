"""Session settings the library relies on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name: str = "wayfare", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; further settings as keyword arguments.

    Keyword names use ``__`` for dots: ``spark__sql__shuffle__partitions="8"``.
    Partition counts are left to adaptive execution unless given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python of the executors, once for an application, so that none needs an installed copy."""
    context, here = spark.sparkContext, Path(__file__).resolve().parent
    if not getattr(context, f"_{here.name}_shipped", False):
        archive = Path(tempfile.mkdtemp(prefix=f"{here.name}-code-")) / f"{here.name}.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for file in sorted(here.rglob("*.py")):
                packed.write(file, file.relative_to(here.parent))
        context.addPyFile(str(archive))
        setattr(context, f"_{here.name}_shipped", True)
    return spark


def ensure_utc(spark: SparkSession) -> SparkSession:
    """Instant arithmetic and text output assume a UTC session; zones are always explicit arguments."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. A folder of this machine is used only where that
    setting is absent, which is the case in local tests.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    fresh = tempfile.mkdtemp(prefix="wayfare-")
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/scratch-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    return f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete one intermediate table, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Call it when results are written: until then they read them."""
    discard(spark, _own_folder(spark))


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within go when it ends, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that are costly to compute and used more than once; lost executors do not cost the work again. The shuffle files that were needed
    to make it go when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with short_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def release(table: DataFrame) -> None:
    """Delete a table made by ``materialize``, once no other table still has to be read from it."""
    discard(table.sparkSession, table._scratch)
