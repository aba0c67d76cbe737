"""Folders of versions: a write makes a new version, readers take the newest complete one, and the ones before go only then.
A write that fails at any point leaves what was there."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions in a folder, the newest last."""
    fs, at = _at(spark, path)
    if not fs.exists(at):
        return []
    found = sorted(s.getPath().toString() for s in fs.listStatus(at) if s.getPath().getName().startswith("v-"))
    return [v for v in found if fs.exists(_at(spark, f"{v}/_SUCCESS")[1])]


def newest(spark: SparkSession, path: str) -> str:
    found = versions(spark, path)
    if not found:
        raise FileNotFoundError(f"no complete version at {path}")
    return found[-1]


def write_version(spark: SparkSession, path: str, write: Callable[[str], None], note: str = "") -> None:
    """``write(folder)`` must leave ``_SUCCESS`` in the folder, as Spark's writers do when all tasks have committed."""
    old = versions(spark, path)
    write(f"{path}/v-{time.time_ns():020d}-{note}-{uuid.uuid4().hex}")
    for v in old:
        fs, at = _at(spark, v)
        fs.delete(at, True)
