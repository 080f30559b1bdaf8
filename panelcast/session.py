"""Session defaults, and the one way lineage is cut."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("panelcast")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), value)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, falls back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelcast-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow iterative state in the shared folder."""
    sc = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several jobs read as a parquet table and read it back.

    Unlike a cache this survives lost executors without recomputation, and later readers
    still prune columns and push filters into the scan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables (or unions of some) that nothing reads any more."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of plans that nobody holds any more, such as those that fed a staged
    table. Spark does so after the driver's next collection, which may be half an hour away."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
