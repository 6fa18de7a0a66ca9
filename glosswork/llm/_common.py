"""Helpers that the corpus operators share: work folders, Bloom filters, hashing, components.

Nothing here gathers rows of a corpus on the driver.  The one exception is a
Bloom filter, whose size has a fixed upper bound (``MAX_FILTER_BITS``); beyond it
more rows than needed pass the filter, and every user of it repeats the test
exactly afterwards, so results never depend on the filter's size.
"""

from __future__ import annotations

import contextlib
import contextvars
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shared

MAX_FILTER_BITS = 1 << 28  # 32 MiB, the most that a broadcast filter may take
FILTER_HASHES = 4
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20  # of the rows that Python gets at once
NULL_ID = (1 << 63) - 1
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("llm_scratch", default=None)
BROADCAST_ROWS = 200_000  # a table of counted rows above this is joined by a shuffle


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session has none and all runs on one machine (a local shell, tests) is one set here.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = jvm_dir.get() if jvm_dir.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "/tmp/checkpoints/" + uuid.uuid4().hex
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Rows go to Python and back in small batches while a job runs: whatever the texts' lengths, an executor and its Python
    workers hold some MB of them at a time, and no large buffers stay with them."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    with settings(spark, wanted):
        yield


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings while a job runs."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """All that :func:`save` and the numbering write inside goes when the block ends, but for what is saved to stay."""
    where = f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"
    token = _scratch.set(where)
    try:
        with shared.scratch(spark):
            yield
    finally:
        _scratch.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save(df: DataFrame, name: str, most: int | None = None, stay: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage, survives lost executors.  The job's shuffle files go when it ends.

    ``most``: the most rows that it can have, if they are short and counted; they go to about a file for each 100,000.
    ``stay``: outlives a :func:`scratch`.  ``codec``: the files' compression, if not the session's.
    """
    spark = df.sparkSession
    path = f"{stay and work_dir(spark) or _scratch.get() or work_dir(spark)}/llm-{uuid.uuid4().hex}-{name}"
    with small_batches(spark), settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        (df if most is None else packed(df, most)).write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by :func:`save` that nothing reads any more."""
    path = getattr(df, "_work_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(side: DataFrame) -> DataFrame:
    """``side``, a table of the shared folder, marked for broadcast if it has at most ``BROADCAST_ROWS`` counted rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def small_join(df: DataFrame, side: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with ``side`` of ``rows`` counted rows: broadcast when small, else by a shuffle
    whose skewed partitions adaptive execution splits."""
    return df.join(F.broadcast(side) if rows <= BROADCAST_ROWS else side, on, how)


def hash_sample(df: DataFrame, hashed: Column, most: int, rows: int, *ties: str) -> DataFrame:
    """The at most ``most`` rows with the smallest 64-bit hashes of ``rows`` counted ones.

    Rows above a bound that about twice as many pass are dropped where they lie, so that what is sorted follows ``most``, not the table.
    """
    if rows > 4 * most:
        df = df.where(hashed < F.lit(-(1 << 63) + (1 << 64) * 2 * most // rows))
    return df.orderBy(hashed, *ties).limit(most)


def id_or_last(name: str = "doc_id") -> Column:
    """The id as a long; null becomes the largest one, so that no id passes Python as a float."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID)).alias(name)


def null_again(df: DataFrame, *names: str) -> DataFrame:
    """Undo :func:`id_or_last`."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in names})


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche on 64-bit words (splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def filter_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    """The ``FILTER_HASHES`` bit positions of each 64-bit key, one row per key."""
    with np.errstate(over="ignore"):
        a, b = mix64(keys), mix64(keys + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        steps = np.arange(FILTER_HASHES, dtype=np.uint64)
        return (a[:, None] + steps[None, :] * b[:, None]) & np.uint64(bits - 1)


class KeyFilter:
    """A Bloom filter over 64-bit keys; ``words`` is its bit array."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words) * 64

    def __contains__(self, key) -> bool:
        return bool(self.test(np.array([key], dtype=np.uint64))[0])

    def test(self, keys: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(0, dtype=bool)
        at = filter_positions(keys.astype(np.uint64), self.bits)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def build_filter(keys: DataFrame, max_bits: int = MAX_FILTER_BITS) -> KeyFilter:
    """A filter over the one long column of ``keys``.

    Tasks set bits locally and send only changed 64-bit words, merged by ``bit_or``;
    the driver gets at most ``max_bits`` / 64 words, whatever the corpus holds.
    """
    column, spark = keys.columns[0], keys.sparkSession
    n = keys.count()
    bits = 1 << 13
    while bits < min(16 * n, max_bits):
        bits *= 2

    def set_bits(batches):
        for batch in batches:
            at = np.unique(filter_positions(batch[column].to_numpy().astype(np.int64).view(np.uint64), bits))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    words = np.zeros(bits // 64, dtype=np.uint64)
    with small_batches(spark):
        got = keys.mapInPandas(set_bits, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words[got["word"].to_numpy()] = got["value"].to_numpy().astype(np.int64).view(np.uint64)
    return KeyFilter(words)


def file_count(rows: int) -> int:
    """Files of about 100,000 rows, at least 8."""
    return max(8, rows // 100_000)


def packed(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` counted rows in :func:`file_count` files.

    Not for a ``df`` that passes Python without a shuffle after it: a coalesced task reads many partitions, and what each of them
    queued for Python, a page of 16 MiB at least, is held until the task ends.  Such rows are dealt out by ``repartition``.
    """
    return df.coalesce(file_count(rows))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): a table (id, class_id), class_id the smallest id.

    Alternating large-star and small-star rounds; both only take minima by key (with
    partial aggregation) and join back.  The minima are written first, so that the join's sides are plain
    shuffles, of which adaptive execution splits the one that holds a hub's many edges.  Every
    round is written to the shared folder.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while before[0]:
        size = 2 * before[0]
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(packed(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), size), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = save(packed(large, size), "large")
        drop_saved(least)
        least = save(packed(large.groupBy("u").agg(F.min("v").alias("m")), size), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = save(packed(small.union(least.select("u", F.col("m").alias("v"))).distinct(), size), "small")
        for done in (least, large, edges):
            drop_saved(done)
        edges, after = fresh, state(fresh)
        if after == before:
            break
        before = after
    members = edges.select(F.col("u").alias("id"), F.col("v").alias("class_id"))
    return members.union(edges.select(F.col("v").alias("id"), F.col("v").alias("class_id")).distinct())
