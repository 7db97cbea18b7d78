"""Durable intermediate tables in the folder that all executors share.

Intermediates are written with Spark's own writers (committed output, so a lost executor costs a
retry and never a row) and read back, which also cuts lineage.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a local master gets a temporary one; a cluster is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _LOCAL.setdefault(context.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="shelfspark-")
        _LOCAL[context.applicationId] = found
    return found.rstrip("/")


class _Scopes(threading.local):
    """The open scopes of a thread."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/shelfspark/{name}-{uuid.uuid4().hex}"
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[list[str]]:
    """Delete the intermediates made inside at its end. A path taken off the list that it gives stays."""
    mine: list[str] = []
    _SCOPES.open.append(mine)
    try:
        yield mine
    finally:
        _SCOPES.open.pop()
        for path in mine:
            remove(spark, path)


#: Internal setting of Spark: bytes after which a batch for a Python worker ends.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def materialize(df: DataFrame, name: str, batch_bytes: int | None = None, by: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    batch_bytes: bounds what is handed to a Python worker at once where rows may be large.
    by: the last column; each of its values gets a folder, so that only its own rows are read for it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_BATCH_BYTES)
    try:
        if batch_bytes:
            spark.conf.set(_BATCH_BYTES, str(batch_bytes))
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_BATCH_BYTES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def keep(df: DataFrame) -> DataFrame:
    """df, a table written inside the innermost scope, which from now on goes with the scope around that one, if there is one."""
    *around, mine = _SCOPES.open
    mine.remove(df.written_to)
    if around:
        around[-1].append(df.written_to)
    return df


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and have Spark delete the shuffle files that no plan refers to.

    Spark does that when the driver's collector finds the plans of ended queries, which it may not for a long time.
    """
    for t in tables:
        remove(t.sparkSession, t.written_to)
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a table that every executor can hold beside its work.
SMALL_BYTES = 16_000_000


def broadcast_if_small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """df, marked for broadcasting if its rows are found small; else for a shuffled join.

    df should be a written table: its rows are counted, and only where they may fit are the bytes of
    strings, binaries and lists summed.
    """
    fixed = 8 * len(df.columns) + 8
    n = df.count()
    if n * fixed > most:
        return shuffled(df)
    wide = [F.coalesce(F.sum(_bytes(F.col(c), kind)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    return F.broadcast(df) if not wide or n * fixed + sum(df.agg(*wide).first()) <= most else shuffled(df)


def shuffled(df: DataFrame) -> DataFrame:
    """df, marked for a join by shuffles and sorts of both sides.

    Spark takes sizes from compressed files, and a list to be exploded for one entry, so that without the mark it may
    broadcast tables many times larger than it may.
    """
    return df.hint("merge")


def _bytes(c: Column, kind: str) -> Column:
    """Bytes beyond a column's fixed width."""
    if kind in ("string", "binary"):
        return F.octet_length(c)
    return 8 * F.size(c) if kind in ("array<int>", "array<bigint>") else F.octet_length(F.to_json(F.struct(c)))
