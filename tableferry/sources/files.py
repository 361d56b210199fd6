"""Small file operations through Hadoop's file system API, on whatever storage a path names."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle, handle.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    handle, fs = _handle(spark, path)
    return bool(fs.exists(handle))


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none when the folder does not exist."""
    handle, fs = _handle(spark, path)
    if not fs.exists(handle):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(handle))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder tree; returns whether something was there."""
    handle, fs = _handle(spark, path)
    return bool(fs.delete(handle, True))


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file, or None when it does not exist."""
    handle, fs = _handle(spark, path)
    if not fs.exists(handle):
        return None
    stream = fs.open(handle)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str, suffix: str) -> None:
    """Replace a small file by writing it beside and renaming over it in one step."""
    fresh, fs = _handle(spark, f"{path}.{suffix}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(
        fresh.toUri(), spark._jsparkSession.sessionState().newHadoopConf()
    )
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(fresh, hadoop.Path(path), options)


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it exists already; whether this call created it."""
    handle, fs = _handle(spark, path)
    if fs.exists(handle):
        return False
    try:
        stream = fs.create(handle, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    return True


def create_whole(spark: SparkSession, path: str, text: str, suffix: str) -> bool:
    """Like `create_once`, but the file appears with its whole text: written beside and renamed, unless it exists."""
    beside, fs = _handle(spark, f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}.{suffix}")
    stream = fs.create(beside, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(beside.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(beside, hadoop.Path(path), spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0))
    except Py4JJavaError as error:
        fs.delete(beside, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
