"""Tables between steps, in the folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only on one machine may the session name none; then a temporary folder is set for it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` as the machine's own, if that is where it leads."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = named.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    whole = store.makeQualified(named).toUri()
    return whole.getPath() if whole.getScheme() == "file" else None


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files, so that lost executors cost no more than they held."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders that nothing reads any more."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context.hadoopConfiguration()).delete(at, True)
