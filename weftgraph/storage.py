"""Shared-folder tables: how lineage is cut so that a lost executor costs a re-read, not a re-run.

Tables are written under ``weftgraph/`` in the folder of ``spark.checkpoint.dir``. A result may read such tables for as
long as it is used, so they stay until they are dropped: one by one (``drop``), or all that a block of code has made
(``scratch``), when what it returns has been written elsewhere or is no longer needed.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


class Made(list):
    """Paths that a block of ``scratch`` has made so far."""

    def keep(self, df: DataFrame) -> DataFrame:
        """Leave the tables that ``df`` reads when the block ends."""
        read = {_plain(f.rpartition("/")[0]) for f in df.inputFiles()}
        self[:] = [path for path in self if _plain(path) not in read]
        return df


#: The blocks of ``scratch`` that are open where the code runs: other threads have their own.
_OPEN: ContextVar[tuple[Made, ...]] = ContextVar("open", default=())


def _plain(path: str) -> str:
    """A path without its scheme and host: Spark writes both in more than one way."""
    return unquote(urlsplit(path).path)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset (tests, single machine) a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="weftgraph-"))


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/weftgraph/{label}-{uuid.uuid4().hex}"
    for made in _OPEN.get():
        made.append(path)
    return path


def cut(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the plan above starts from files."""
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that deals out both of its sides: broadcast, a table goes by way of the driver, and in an algorithm of many rounds all of them add up there."""
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``cut`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weftgraph/").toUri().getPath()
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if spark._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().startswith(root):
                _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Made]:
    """Delete what the block has written to the shared folder when it ends. Paths taken out of the yielded list, and tables it was told to ``keep``, stay.

    Only what the block's own thread writes counts: blocks of several threads don't meet.
    """
    made = Made()
    token = _OPEN.set((*_OPEN.get(), made))
    try:
        yield made
    finally:
        _OPEN.reset(token)
        for path in made:
            _delete(spark, path)
