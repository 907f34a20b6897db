"""Paths through Hadoop's file system: the same for local, shared and object storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """The path and its file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    return p, fs


def qualified(spark: SparkSession, path: str) -> str:
    """The full URI of a path, for comparing paths."""
    p, fs = _at(spark, path)
    return str(fs.makeQualified(p).toString()).rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return bool(fs.exists(p))


def expand(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Full URIs of the files and folders that paths and patterns name, sorted within each."""
    out = []
    for path in [paths] if isinstance(paths, str) else paths:
        p, fs = _at(spark, path)
        out += sorted(str(s.getPath().toString()).rstrip("/") for s in (fs.globStatus(p) or []))
    return out


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none for a file or a missing path."""
    p, fs = _at(spark, path)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    return [str(s.getPath().getName()) for s in fs.listStatus(p)]


def replace_folder(spark: SparkSession, target: str, files: Sequence[str], names: Sequence[str], staging: str) -> None:
    """Make ``target`` a folder of ``files`` under new ``names``: gathered in ``staging`` first, then
    put in place of an older ``target`` by one rename."""
    to, fs = _at(spark, target)
    stage, _ = _at(spark, staging)
    fs.mkdirs(stage)
    for file, name in zip(files, names):
        if not fs.rename(_at(spark, file)[0], _at(spark, join(staging, name))[0]):
            raise OSError(f"can't move {file} to {staging}")
    fs.create(_at(spark, join(staging, "_SUCCESS"))[0]).close()
    fs.delete(to, True)
    if not fs.rename(stage, to):
        raise OSError(f"can't move {staging} to {target}")


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"
