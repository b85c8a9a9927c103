"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
LETTERS_UP, LETTERS_LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that one broadcast side may have at most.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, LETTERS_UP, LETTERS_LOW)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or one of our own where none is set and all of Spark is in this process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is to name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quernstone-"))
    return sc.getCheckpointDir()


_SCOPE: ContextVar[list[Staged] | None] = ContextVar("_SCOPE", default=None)


class Scope:
    """What passing() gives: tables staged inside it go at its end, but for those that were handed to keep()."""

    def __init__(self, outer: list[Staged] | None):
        self.outer, self.made = outer, []

    def keep(self, staged: Staged) -> DataFrame:
        """staged.df; the table belongs to the scope around this one, if there is one."""
        self.made.remove(staged)
        if self.outer is not None:
            self.outer.append(staged)
        return staged.df


@contextmanager
def passing() -> Iterator[Scope]:
    """Bounds the disk that an operator needs: its own tables last until its result is written."""
    scope = Scope(_SCOPE.get())
    token = _SCOPE.set(scope.made)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        for staged in scope.made:
            staged.drop()


class Staged:
    """A table written to the shared folder: it cuts lineage, survives lost executors, and is computed once. It stays
    until it is dropped, by hand or by the passing() around it."""

    def __init__(self, df: DataFrame, batch: int | None = None):
        """batch: rows that an Arrow function gets at once, where they are wide."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/staged-{uuid.uuid4().hex}"
        before = self.spark.conf.get(_BATCH)
        try:
            if batch:
                self.spark.conf.set(_BATCH, str(batch))
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            self.spark.conf.set(_BATCH, before)
        self.schema = df.schema
        if (made := _SCOPE.get()) is not None:
            made.append(self)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, n_rows: int) -> DataFrame:
    """df with a broadcast hint if its checked row count allows it; otherwise the join shuffles and AQE splits skew."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df
