"""Session set-up, and the one way this library cuts lineage: tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library is tested under; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Where neither that setting nor a checkpoint folder exists, a temporary folder is taken in local mode
    (tests on one machine); on a cluster its executors would not share it, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="docloom-checkpoint-")
        context.setCheckpointDir(named)
    return named


#: Spark's setting by which a query's shuffle files go at its end, not when the driver happens to collect its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths written by the scratch scopes that are open, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open scratch scopes", default=())


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a columnar table in the shared folder: computed once, of known size, survives lost executors.

    The table goes when the scratch scope it was written in ends, at the latest with the application;
    the shuffle files of its making go as soon as it is written.
    """
    spark = df.sparkSession
    name = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(name)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    path, system = _path(spark, name)
    system.deleteOnExit(path)
    if scopes := _OPEN.get():
        scopes[-1].append(name)
    return spark.read.schema(df.schema).parquet(name)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope whose cut tables are removed at its end; yields ``keep``, which cuts a table into the scope around it."""
    outer = _OPEN.get()
    mine: list[str] = []
    token = _OPEN.set((*outer, mine))

    def keep(df: DataFrame) -> DataFrame:
        inner = _OPEN.set(outer)
        try:
            return cut(df)
        finally:
            _OPEN.reset(inner)

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for name in mine:
            path, system = _path(spark, name)
            system.delete(path, True)
            system.cancelDeleteOnExit(path)


def task_count(spark: SparkSession) -> int:
    """Shuffle partitions to ask for explicitly where AQE must not merge Python-heavy partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
