"""Tables written between two steps of a query, in the cluster's shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

#: Folders of which an application has found that its executors share them.
_SHARED: set[tuple[str, str]] = set()


def scratch_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or set by ``setCheckpointDir``; one of them has to be.

    On a cluster a ``file:`` folder may be a mount that all machines share or one that each has for itself.  A
    small job tells, once per application; the latter is refused.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    folder = folder.rstrip("/")
    alone = spark.sparkContext.master.startswith("local")
    if not alone and (folder.startswith("file:") or spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        spark._jsparkSession.sessionState().newHadoopConf()
    ).getScheme() == "file"):
        _check_shared(spark, folder)
    return folder


def _check_shared(spark: SparkSession, folder: str) -> None:
    """Fails unless what tasks on all executors write under ``folder`` is there for the driver and other tasks."""
    try:
        found = (spark.sparkContext.applicationId, folder)
        if found in _SHARED:
            return
        tasks = 2 * spark.sparkContext.defaultParallelism
        path = f"{folder}/inktally/{spark.sparkContext.applicationId}/shared-{uuid.uuid4().hex}"
        spark.range(0, tasks, 1, tasks).write.parquet(path)
        whole = spark.read.schema("id bigint").parquet(path).count() == tasks
    except Exception as stopped:
        raise ValueError(f"{SETTING} is {folder}; executors have to share it, which could not be found out") from stopped
    if not whole:
        raise ValueError(f"{SETTING} is {folder}, a folder of one machine; executors have to share it")
    _SHARED.add(found)


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` written out and read back: fixed rows, short lineage, survives lost executors.

    It stays until :func:`clear_scratch`.
    """
    spark = frame.sparkSession
    path = f"{scratch_folder(spark)}/inktally/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(place)]


def clear_scratch(spark: SparkSession) -> None:
    """Removes what this application has written; call it when its results have been used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_folder(spark)}/inktally/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
