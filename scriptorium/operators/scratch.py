"""Tables written on the way, in the folder that driver and executors share, and scopes that own them."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession

_CURRENT: ContextVar[Scope | None] = ContextVar("scriptorium scope", default=None)


class Scope:
    """Owns the paths that are handed out while it is entered; each thread has its own.

    Nothing goes by itself, as results are read when they are used: call `release` once what was made of the tables stands.
    The innermost scope owns a path, so releasing one touches no other's tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self._tokens: list[Token] = []

    def __enter__(self) -> Scope:
        self._tokens.append(_CURRENT.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _CURRENT.reset(self._tokens.pop())

    def release(self) -> None:
        """Remove this scope's tables."""
        while self.paths:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths[-1])
            where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
            self.paths.pop()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured a session of one machine, as in tests, gets its own; a cluster is refused."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured:
        current = context.getCheckpointDir()
        if current:
            return current
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="scriptorium-")
        context.setCheckpointDir(configured)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, owned by the current scope; never reused, so a retried job can't read another's rows."""
    path = f"{shared_dir(spark).rstrip('/')}/scriptorium/{label}-{uuid.uuid4().hex}"
    owner = _CURRENT.get()
    if owner is not None:
        owner.paths.append(path)
    return path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: computed once, cuts lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
