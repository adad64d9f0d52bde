"""Small state files on any file system that Spark knows, replaced in one step."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    conf = spark._jsc.hadoopConfiguration()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(conf)
    return system, system.makeQualified(at), conf


def load(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The JSON in a file, None if there is no file."""
    system, at, _ = _system(spark, path)
    if not system.exists(at):
        return None
    with_in = system.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(with_in)))
    finally:
        with_in.close()


def save(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    """Write a file beside the old one, then put it in its place."""
    system, at, conf = _system(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f"{at.getName()}.tmp")
    out = system.create(beside, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.hsync()
    out.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf).rename(beside, at, how)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if there is no folder."""
    system, at, _ = _system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(at)) if system.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    system, at, _ = _system(spark, path)
    system.delete(at, True)
