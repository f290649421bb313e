"""Tables that cut lineage, in the folder every executor shares.

Each is a plain Parquet table below ``spark.checkpoint.dir``: a lost executor costs a re-read, never a recomputation.
An operator drops the tables that its result doesn't read; the others go when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_local: dict[str, str] = {}
_scopes: ContextVar[tuple[Scope, ...]] = ContextVar("scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session in one process (tests) may go without: it gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="stratum-"))


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@contextmanager
def modest_batches(spark: SparkSession, rows: int = 1000):
    """Arrow batches of 1000 rows meanwhile, unless the session sets their size: 10,000 whole texts fill too much memory outside the heap."""
    if spark._jsparkSession.sessionState().conf().contains(ARROW_ROWS):
        yield
        return
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_ROWS)


class Scope:
    """The tables written meanwhile, but those kept, go at the end."""

    def __init__(self):
        self.tables: list[tuple[SparkSession, str, DataFrame]] = []
        self.kept: list[DataFrame] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a table that settle gave, outlives the scope."""
        self.kept.append(df)
        return df


@contextmanager
def temporary():
    scope, outer = Scope(), _scopes.get()
    token = _scopes.set((*outer, scope))
    try:
        yield scope
    finally:
        _scopes.reset(token)
        for spark, path, df in scope.tables:
            if any(df is k for k in scope.kept):
                if outer:
                    outer[-1].tables.append((spark, path, df))
            else:
                discard(spark, path)


def settle(df: DataFrame, name: str) -> DataFrame:
    """df, written once below the shared folder and read back."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stratum-{spark.sparkContext.applicationId}"
    path = f"{root}/{uuid.uuid4().hex}/{name}"
    with modest_batches(spark):
        df.write.parquet(path)
    fs, p = _file_system(spark, root)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    if scopes := _scopes.get():
        scopes[-1].tables.append((spark, path, out))
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that settle wrote."""
    fs, p = _file_system(spark, path)
    fs.delete(p.getParent(), True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
