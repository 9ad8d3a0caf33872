"""Intermediate tables that several queries read, written once a session to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_known: dict[tuple[str, str, str, tuple], tuple[str, object]] = {}
_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode where it is unset."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir names no folder, and executors of a cluster share no temporary one")
        _folders[app] = f"{named or tempfile.mkdtemp(prefix='medlattice-')}/medlattice-store-{uuid.uuid4().hex[:12]}"
        atexit.register(remove_local, _folders[app])
    return _folders[app]


def remove_local(path: str) -> None:
    """Remove a local folder; other stores keep theirs for their own cleaning."""
    if path.startswith(("/", "file:")):
        shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def written(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """A DataFrame as a table of its own in the shared folder."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, data: str) -> tuple:
    """Names, sizes and times of the entries of a data folder, in any file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(data)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))


def once(spark: SparkSession, data: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` over the data folder, built and written at its first use in this session and again when the data's files change."""
    key = (spark.sparkContext.applicationId, data, name, _state(spark, data))
    if key not in _known:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        df = build()
        df.write.parquet(path)
        _known[key] = (path, df.schema)
    path, schema = _known[key]
    return spark.read.schema(schema).parquet(path)
