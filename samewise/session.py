"""Session settings and the shared folder that stages write to."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "samewise") -> SparkSession:
    """A local session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application, so that they need no path set up."""
    sc = spark.sparkContext
    if getattr(sc, "_samewise", None) != sc.applicationId:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="samewise-")) / "samewise.zip"  # of the driver; the workers fetch it from there
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._samewise = sc.applicationId
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where the setting is absent, a temporary one for a local master,
    whose executors are this process; a cluster must name one."""
    sc = spark.sparkContext
    there = sc.getConf().get("spark.checkpoint.dir", None)
    if not there and sc.getCheckpointDir():
        there = sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        there = "file://" + tempfile.mkdtemp(prefix="samewise-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint: its lineage ends here and it is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark deletes the shuffle files of a query when it ends.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths staged since the innermost staged_alone began.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under a folder of this application."""
    return f"{shared_dir(spark).rstrip('/')}/samewise-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def clear_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged. Results read from it must have been written or collected."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/samewise-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """df written to the shared folder as a table and read again: columns can then be pruned, and it is computed once. What was shuffled
    for it is deleted as soon as it is written; else it stays on disk until the driver collects its garbage."""
    spark, path = df.sparkSession, staged_path(df.sparkSession, name)
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_FREE, before)
    if (made := _made.get()) is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, staged; all that was staged on the way to it is deleted then, so make must stage nothing that others read."""
    token = _made.set([])
    try:
        out = make()
        way = list(_made.get())
        out = staged(out, name)
        path = _made.get()[-1]
    finally:
        _made.reset(token)
    spark = out.sparkSession
    for p in way:
        there = spark._jvm.org.apache.hadoop.fs.Path(p)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    if (made := _made.get()) is not None:
        made.append(path)
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that no side is sent through the driver for. Spark judges a table by the bytes of its files, and ids and
    hashes take many times that in memory; a query of many joins holds all that is sent at once."""
    return df.hint("merge")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
