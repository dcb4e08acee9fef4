"""Intermediate tables in the folder the cluster shares, which cut lineage for iterative work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
# The workspaces made inside each open scope, the innermost last.
_scopes: list[list[Workspace]] = []


@contextmanager
def scope() -> Iterator[None]:
    """Delete, at the end, all tables that workspaces made inside have written.

    For callers who write their result before the scope ends: a DataFrame that an operator returns may still
    read such tables.
    """
    made: list[Workspace] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for space in made:
            space.delete()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="skychart-")
    return _local_folders[context.applicationId]


class Workspace:
    """Writes named tables under one run folder and reads them back.

    Unlike a cached frame, a written table survives the loss of any executor, and its file sizes
    tell the optimizer whether a side is small enough to broadcast.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/skychart-{uuid.uuid4().hex}"
        self._versions: dict[str, list[str]] = {}
        if _scopes:
            _scopes[-1].append(self)

    def delete(self) -> None:
        """Remove everything written here."""
        self._delete(self.folder)
        self._versions.clear()

    def write(self, df: DataFrame, name: str, codec: str | None = None, group_rows: int | None = None) -> DataFrame:
        """``codec``: a Parquet compression other than the session's. ``group_rows``: rows that writers and readers hold at
        a time at most, for tables with very long rows."""
        versions = self._versions.setdefault(name, [])
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        writer = df.write if group_rows is None else df.write.option("parquet.block.row.count.limit", group_rows)
        writer.parquet(path, compression=codec)
        versions.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replace(self, df: DataFrame, name: str) -> DataFrame:
        """Write the next version of a table, then delete the versions it was computed from."""
        old = list(self._versions.get(name, []))
        table = self.write(df, name)
        for path in old:
            self._delete(path)
            self._versions[name].remove(path)
        return table

    def _delete(self, path: str) -> None:
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        file_system = hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        file_system.delete(hadoop_path, True)
