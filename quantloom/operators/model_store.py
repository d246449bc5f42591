"""Stored models: tables under one folder, with a version that is committed last.

A version is written whole into a folder of its own; only then does its marker appear among the committed ones. A job that
dies halfway leaves a folder that no reader looks at, and readers of an older version are never disturbed.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_COMMITTED = "_committed"


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed versions, oldest first."""
    files, folder = _folder(spark, f"{path}/{_COMMITTED}")
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def save(tables: Mapping[str, DataFrame], path: str) -> str:
    """Write the tables as a new version and commit it; returns its name."""
    spark = next(iter(tables.values())).sparkSession
    last = versions(spark, path)
    name = f"{int(last[-1].split('-')[0]) + 1 if last else 1:08d}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{path}/{name}/{table}")
    files, marker = _folder(spark, f"{path}/{_COMMITTED}/{name}")
    files.create(marker, False).close()
    return name


def load(spark: SparkSession, path: str, schemas: Mapping[str, str], version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version (else the newest), by name; says clearly that there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed model{'' if version is None else f' of version {version}'} at {path}; train one first")
    return {table: spark.read.schema(schema).parquet(f"{path}/{version or known[-1]}/{table}") for table, schema in schemas.items()}
