"""Session, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if a count, taken first and stopped at this limit, proves it smaller.
BROADCAST_ROWS = 200_000


def session(app: str = "gridloom", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings tests and the bench rely on; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once an application, so that it need not be installed on every machine."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    at = Path(tempfile.mkdtemp(prefix="gridloom-code-")) / f"gridloom-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path(here.name) / p.relative_to(here))
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset (tests) one of our own.

    On a cluster a folder of the driver's machine would be another one on each executor, so there an unset folder is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.conf.get("spark.gridloom.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "local")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by all executors of {master}")
        at = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.gridloom.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there and a lost executor costs no recompute."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{os.getpid()}/{tag}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote for this driver process; call it once results are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/gridloom-{os.getpid()}")
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count proves ``df`` to have at most ``limit`` rows; larger sides are shuffled."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def small_collect(df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table that must be small; more than ``limit`` is an error and never a silent cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
