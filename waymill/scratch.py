"""The folder that all executors share, for checkpoints and tables between jobs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session: the one in use, else the one that ``spark.checkpoint.dir`` names.

    Only a local session, as in tests, gets a temporary folder where neither is set; on a cluster that is an
    error, since executors don't see the driver's folders.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="waymill-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """``checkpoint()`` to the shared folder: the lineage ends there and lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Tables written in the scopes that are open, the innermost last.
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Keys that are sent to all tasks, some 16 bytes each.
BROADCAST_KEYS = 2_000_000


def only(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows of ``df`` whose key is among ``keys``; where these are few ``df`` is read where it is and not shuffled."""
    keys = written(keys.distinct(), "keys")
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables between jobs that are written inside are removed at the end, whether it is reached or an error is raised.

    A result that is still to be computed from them must be written elsewhere inside, too.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for name in _SCOPES.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, for tasks that read or write files themselves, and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
