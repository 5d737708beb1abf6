"""Folders of the file system that Spark's paths name: list, publish by one rename, remove."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    """The JVM, the file context of a path, and the path as its class."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    contexts = jvm.org.apache.hadoop.fs.FileContext
    return jvm, contexts.getFileContext(at.toUri(), conf) if at.toUri().getScheme() else contexts.getFileContext(conf), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    _, context, at = _system(spark, path)
    if not context.util().exists(at):
        return []
    return sorted(x.getPath().getName() for x in context.util().listStatus(at))


def publish(spark: SparkSession, made: str, path: str) -> bool:
    """Rename ``made`` to ``path`` in one step. False if somebody else has published there; nothing is overwritten."""
    jvm, context, at = _system(spark, path)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    if not context.util().exists(at.getParent()):
        context.mkdir(at.getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(made), at, none)
    except Py4JJavaError as error:
        if "FileAlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    _, context, at = _system(spark, path)
    if context.util().exists(at):
        context.delete(at, True)
