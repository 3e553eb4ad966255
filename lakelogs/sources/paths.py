"""Folders that driver and executors share, and the file-system handle behind a path."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; below a folder of this machine where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder."""
    fs, at = file_system(spark, path), hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, hidden ones included."""
    fs, at = file_system(spark, path), hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isFile()) if fs.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    return file_system(spark, path).exists(hadoop_path(spark, path))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system's scheme."""
    return file_system(spark, path).makeQualified(hadoop_path(spark, path)).toString()


def remove(spark: SparkSession, path: str) -> None:
    file_system(spark, path).delete(hadoop_path(spark, path), True)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that a glob pattern matches."""
    return [s.getPath().toString() for s in file_system(spark, pattern).globStatus(hadoop_path(spark, pattern)) or []]


def remove_matching(spark: SparkSession, pattern: str) -> None:
    """Remove what a glob pattern matches."""
    for path in matching(spark, pattern):
        remove(spark, path)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, to = file_system(spark, target), hadoop_path(spark, target)
    fs.mkdirs(to.getParent())
    if not fs.rename(hadoop_path(spark, source), to):
        raise OSError(f"can't move {source} to {target}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text (hidden files too), None if there is none."""
    fs, at = file_system(spark, path), hadoop_path(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    out = file_system(spark, path).create(hadoop_path(spark, path), True)
    out.write(bytearray(text.encode()))
    out.close()


def commit_text(spark: SparkSession, path: str, text: str) -> None:
    """As ``write_text``, but the file is there as a whole or not at all."""
    draft = f"{path.rpartition('/')[0]}/_draft-{uuid.uuid4().hex}"
    write_text(spark, draft, text)
    move(spark, draft, path)
