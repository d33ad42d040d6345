"""Intermediate tables in the shared folder of the cluster."""

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER_SETTING = "spark.checkpoint.dir"
WAREHOUSE_SETTING = "spark.sql.warehouse.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints, else its warehouse.

    Both are shared by all executors of a cluster. A warehouse on the driver's
    own disk is not, and is refused unless the executors are on that machine
    too. Nothing is ever put in a temporary folder of one machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get(FOLDER_SETTING, None) or context.getConf().get(FOLDER_SETTING)
    folder = folder or context.getCheckpointDir()
    if not folder:
        folder = spark.conf.get(WAREHOUSE_SETTING)
        on_one_disk = folder.startswith(("file:", "/")) and not _default_is_shared(spark, folder)
        if on_one_disk and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError(f"set {FOLDER_SETTING} to a folder that all executors share")
    return folder.rstrip("/")


def _default_is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether a path without a scheme lies in a file system of the cluster."""
    if folder.startswith("file:"):
        return False
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return not conf.get("fs.defaultFS", "file:///").startswith("file:")


def run_folder(spark: SparkSession) -> str:
    """The folder of all tables that this application stages."""
    return f"{shared_folder(spark)}/themeloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(table: DataFrame, name: str) -> DataFrame:
    """Write the table out and go on from the copy.

    The copy ends the lineage, survives the loss of executors, and lets later
    steps read only the columns they use.
    """
    spark = table.sparkSession
    path = new_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def release(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more.

    Only files below this application's own folder are removed.
    """
    spark = table.sparkSession
    own = f"/themeloom/{spark.sparkContext.applicationId}/"
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if own in folder:
            _remove(spark, folder)


def release_all(spark: SparkSession) -> None:
    """Remove every table that this application has staged."""
    _remove(spark, run_folder(spark))
