"""Tables written once for several uses, in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where there is none and all runs on one machine is one set here."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = known.get() if known.isDefined() else None
    if not where:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints/" + uuid.uuid4().hex
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """All that :func:`kept` writes inside goes when the block ends; what shall stay must be written elsewhere by then."""
    where = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    token = _scratch.set(where)
    try:
        yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: computed once, and whole if an executor is lost."""
    path = f"{_scratch.get() or shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
