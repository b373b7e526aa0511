"""Intermediate tables: written where all executors read, and removed again."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}
_open: list[list[str]] = []


def scratch(spark: SparkSession) -> str:
    """A folder of this session under spark.checkpoint.dir, which executors and driver share; removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "/tmp/checkpoints"
        _folders[app] = f"{base.rstrip('/')}/convolake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Best effort, as the session may have ended already."""
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001
        return


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, what: str, outer: bool = False, **options: str) -> DataFrame:
    """df as a Parquet table in the scratch folder: it cuts the lineage, survives lost executors, and is read as often as needed. It stays until the driver ends, or the released() around it (outer: the one around that)."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    if of := _open[: -1 if outer else None]:
        of[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that operators have saved inside; what is needed after it must have been written elsewhere by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _delete(spark, path)
