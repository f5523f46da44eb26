"""Session helpers: defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "textlake") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName(name)
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def tune(spark: SparkSession) -> SparkSession:
    """Settings the wide text projections like; all may be changed at run time.

    The JVM never compiles methods over 8000 bytes, so larger generated methods are
    better split; skewed joins and small partitions are left to adaptive execution.
    """
    for name, value in {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.adaptive.enabled": "true",
                        "spark.sql.adaptive.skewJoin.enabled": "true",
                        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true"}.items():
        spark.conf.set(name, value)
    return spark


#: Rows that a task of heavy work per row should have at most.
TASK_ROWS = 50_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan into at least one task per core and one per ``TASK_ROWS`` rows.

    Splits go by bytes and hold whole row groups, so a compact table of many rows has few and long ones, some of them empty;
    its rows are counted, from the files' footers, and dealt anew. A scan with as many splits as that stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-df.count() // TASK_ROWS))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, *keys)


#: Temporary folders of local sessions, whose options cannot be changed once they run.
_local_folders: dict[str, str] = {}


def by_shuffle(df: DataFrame) -> DataFrame:
    """A side of a join that Spark would take for small: exploded rows and built texts are many times what the scan's size says.

    Such sides meet by shuffle and sort; collected for a broadcast they would grow with the input in the driver.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    run = spark.sparkContext.applicationId
    if run not in _local_folders:
        _local_folders[run] = tempfile.mkdtemp(prefix="textlake-")
    return _local_folders[run]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: lost executors then cost a re-read only."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
