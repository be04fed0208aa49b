"""Session factory, shared-folder handling and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on (UTC, ANSI, adaptive execution)."""
    builder = SparkSession.builder.master(master).appName("millrace")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only on a local master, where it is unset, a folder is created and set; elsewhere that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = getattr(spark, "_millrace_shared", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
            spark.sparkContext.setCheckpointDir(folder)
            spark._millrace_shared = folder
    return folder.rstrip("/")


_tables: list[str] = []


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: a durable lineage cut.

    The files survive the loss of any executor; the name is made unique per call. They stay
    until release(), since results read them lazily.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    register(path)
    return spark.read.schema(df.schema).parquet(path)


def register(path: str) -> None:
    """A path of the shared folder that release() shall delete."""
    _tables.append(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by release()."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    register(path)
    return path


def local(path: str) -> str:
    """The path of a file: URI; small artifacts that the driver writes need one."""
    if "://" in path and not path.startswith("file:"):
        raise ValueError(f"{path} is not on a file system that the driver reaches")
    return "/" + path.removeprefix("file:").lstrip("/")


def release(spark: SparkSession) -> int:
    """Delete what written() and register() noted in this process; call it once results are consumed."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_tables)
    while _tables:
        path = fs_path(_tables.pop())
        path.getFileSystem(conf).delete(path, True)
    return count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
