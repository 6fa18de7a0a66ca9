"""Exact dedup by a log-structured merge index.

:class:`LsmIndex` holds levels of runs.  ``flush`` fills memtables of bounded size
(digest -> copies, best row) and writes each as a run: its rows sorted by digest, with a Bloom filter of
the run's own digests.  ``compact`` merges runs by ranges of digests into one level: per digest it adds up the copies and keeps
the smallest identifier in the order of :func:`best_first` (most code points, then smallest
doc_id).  ``probe`` takes rows through a filter of the digests that the level holds more than once, then the level
itself, then byte verification against the row that stays.  A row that the filter refuses is proven single and its text never travels.
Rows whose digests agree with a row of other bytes are grouped by their texts, so a weak digest costs time and never a wrong result.

Digests, lengths and the byte comparison are built-in columns; Python sees digests only.  A digest that a third of all rows
share has one row in a run; the joins of its rows have plain tables on both sides, of which adaptive execution splits the hot partition.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``.

Defined results: null text counts as empty, all empty texts form one group; a null
doc_id is larger than any other; rows that repeat a doc_id each count in
``group_size`` and each are reported (:func:`deduplicate` goes by doc_id and text: of copies,
with or without ids, one row stays, and different texts of one doc_id all stay); of copies of one length
the smaller doc_id stays; a very long text is hashed whole, one row at a time; an empty table gives an empty result; only doc_id and
text are read, further columns of any name are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NULL_ID, KeyFilter, build_filter, drop_saved, filter_positions, save, small

BLANKS = "\t\n\x0b\x0c\r "
MEMTABLE_ROWS = 50_000
BITS_A_KEY = 16
RUN_SCHEMA = "run string, digest binary, copies long, neg_length long, doc_id long, run_filter binary"


def best_first() -> Column:
    return F.struct("neg_length", "doc_id")


def body_of(text: Column) -> Column:
    """The normalised text."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def digested(docs: DataFrame, digest_bytes: int) -> DataFrame:
    """doc_id (null as the largest), neg_length, sha, digest and the text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", (-F.length("text")).cast("long").alias("neg_length"), F.sha2(body_of(F.col("text")), 256).alias("sha"))
    return rows.withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes))


def heads(digests) -> np.ndarray:
    """A 64-bit key of each digest for the filters."""
    return np.frombuffer(b"".join(bytes(d[:8]).ljust(8, b"\0") for d in digests), dtype="<u8").astype(np.uint64)


def run_filter(keys: np.ndarray) -> bytes:
    """The Bloom filter of one run, about ``BITS_A_KEY`` bits a key."""
    bits = 64
    while bits < BITS_A_KEY * len(keys):
        bits *= 2
    words = np.zeros(bits // 64, dtype=np.uint64)
    at = filter_positions(keys, bits).ravel()
    np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return words.tobytes()


def flush_runs(rows: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """Runs of (digest, neg_length, doc_id): one row per digest and memtable, sorted by digest; a run's first row carries its filter."""

    def run(batches):
        from pyspark import TaskContext

        task, flushed, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            table = pd.concat(held, ignore_index=True).sort_values(["digest", "neg_length", "doc_id"], ignore_index=True)
            first = table.drop_duplicates("digest")
            copies = np.diff(np.append(first.index.to_numpy(), len(table)))
            out = first.assign(run=f"{task}-{flushed}", copies=copies, run_filter=None)
            out.iloc[0, out.columns.get_loc("run_filter")] = run_filter(heads(out["digest"]))
            return out

        for batch in batches:
            for start in range(0, len(batch), memtable_rows):
                part = batch.iloc[start:start + memtable_rows]
                if size and size + len(part) > memtable_rows:
                    yield flush()
                    held, size, flushed = [], 0, flushed + 1
                held.append(part)
                size += len(part)
        if size:
            yield flush()

    return rows.select("digest", "neg_length", "doc_id").mapInPandas(run, RUN_SCHEMA)


def merged(runs: DataFrame) -> DataFrame:
    """One level from runs, by ranges of digests: each range is sorted and merged where it lies, without another shuffle."""
    ranged = runs.select("digest", "copies", "neg_length", "doc_id").repartitionByRange("digest").sortWithinPartitions("digest")
    both = ranged.groupBy("digest").agg(F.sum("copies").alias("copies"), F.min(best_first()).alias("best"))
    return both.select("digest", "copies", "best.neg_length", "best.doc_id")


class LsmIndex:
    """Runs not yet merged (level 0) and one merged level, both tables in the shared folder."""

    def __init__(self, spark: SparkSession, runs: DataFrame | None = None, level: DataFrame | None = None, digest_bytes: int = 32):
        self.spark, self.runs, self.level, self.digest_bytes = spark, runs, level, digest_bytes

    def flush(self, docs: DataFrame, memtable_rows: int = MEMTABLE_ROWS) -> LsmIndex:
        """Add the rows of ``docs`` as new runs."""
        fresh = save(flush_runs(digested(docs, self.digest_bytes), memtable_rows), "dedup-runs")
        return LsmIndex(self.spark, fresh if self.runs is None else self.runs.unionByName(fresh), self.level, self.digest_bytes)

    def compact(self) -> LsmIndex:
        """Merge all runs, and the level that there is, into one level."""
        if self.runs is None:
            return self
        columns = ["digest", "copies", "neg_length", "doc_id"]
        every = self.runs.select(*columns) if self.level is None else self.runs.select(*columns).unionByName(self.level)
        return LsmIndex(self.spark, None, save(merged(every), "dedup-level"), self.digest_bytes)

    def holds(self, digests: list[bytes]) -> dict[bytes, bool]:
        """Whether the runs may hold some digests, by the runs' own filters, before any row is read."""
        if self.runs is None or not digests:
            return dict.fromkeys(digests, False)
        keys = heads(digests)
        test = F.pandas_udf(lambda filters: pd.Series([KeyFilter(np.frombuffer(f, dtype=np.uint64)).test(keys).tolist() for f in filters], dtype=object), "array<boolean>")
        found = self.runs.where("run_filter is not null").select(F.posexplode(test("run_filter")).alias("at", "hit")).groupBy("at").agg(F.max("hit").alias("hit")).collect()
        hit = {r["at"]: r["hit"] for r in found}
        return {d: bool(hit.get(i, False)) for i, d in enumerate(digests)}

    def probe(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of ``docs`` proven single: doc_id, sha; the others: digest, doc_id, neg_length, sha, body, and keep_id, copies,
        keep_length of their digest).  The index must be compacted; a digest held once counts as single."""
        repeated = save(self.level.where("copies > 1").select("digest", "copies", F.col("doc_id").alias("keep_id"), F.col("neg_length").alias("keep_length")), "dedup-repeated")
        key = F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("long")
        passing = self.spark.sparkContext.broadcast(build_filter(repeated.select(key.alias("key"))))
        test = F.pandas_udf(lambda keys: pd.Series(passing.value.test(keys.to_numpy(dtype=np.int64).view(np.uint64))), "boolean")
        rows = digested(docs, self.digest_bytes).withColumn("hit", test(key))
        rows = save(rows.select("doc_id", "neg_length", "sha", "digest", F.when(F.col("hit"), body_of(F.col("text"))).alias("body")), "dedup-rows")
        passing.destroy()
        maybe = rows.where("body is not null").join(repeated, "digest", "left")
        single = rows.where("body is null").select("doc_id", "sha")
        return single, maybe


def duplicate_classes(docs: DataFrame, digest_bytes: int = 32, memtable_rows: int = MEMTABLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = LsmIndex(docs.sparkSession, digest_bytes=digest_bytes).flush(docs, memtable_rows)
    runs, index = index.runs, index.compact()
    drop_saved(runs)
    single, maybe = index.probe(docs)
    alone = maybe.where("copies is null").select("doc_id", "sha")
    hits = maybe.where("copies is not null")
    # Byte verification against the row that stays; of rows that repeat its doc_id and length the smallest body.
    keepers = hits.where((F.col("doc_id") == F.col("keep_id")) & (F.col("neg_length") == F.col("keep_length")))
    keepers = save(keepers.groupBy("digest").agg(F.min("body").alias("keep_body")), "dedup-keepers")
    same = F.col("body") == F.col("keep_body")
    verified = save(hits.join(keepers, "digest").select("digest", "doc_id", "neg_length", "sha", "keep_id", "copies", F.when(same, "").otherwise(F.concat(F.lit("x"), "body")).alias("other")), "dedup-verified")
    wrong = save(verified.where("other <> ''").select("digest").distinct(), "dedup-collisions")
    one = F.lit(1).cast("long")
    out = [t.select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), "sha") for t in (single, alone)]
    if wrong.limit(1).count():  # digests of several texts: grouped by the texts themselves
        mixed = save(verified.join(wrong, "digest", "left_semi"), "dedup-mixed")
        groups = save(mixed.groupBy("digest", "other").agg(F.count("*").alias("group_size"), F.min(best_first()).alias("best")), "dedup-groups")
        out.append(mixed.join(groups, ["digest", "other"]).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", "sha"))
        verified = verified.join(wrong, "digest", "left_anti")
    out.append(verified.select("doc_id", "keep_id", F.col("copies").alias("group_size"), "sha"))
    every = out[0]
    for part in out[1:]:
        every = every.union(part)
    known = every.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.nullif("keep_id", F.lit(NULL_ID)).alias("keep_id"), "group_size", F.col("sha").alias("text_sha256"))
    return known.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns, one for each group of equal texts."""
    classes = save(duplicate_classes(docs).select("doc_id", "text_sha256", "kept"), "dedup-classes")

    def key(sha: Column) -> Column:
        return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"), F.unhex(sha).alias("sha"))

    gone = save(classes.where("not kept").select(key(F.col("text_sha256")).alias("gone")).distinct(), "dedup-gone")
    again = save(classes.where("kept").groupBy(key(F.col("text_sha256")).alias("again")).count().where("count > 1").select("again"), "dedup-again")
    # A row travels as one struct beside its key, so that no column's name can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(F.sha2(body_of(F.col("text")), 256)).alias("key"))
    left = rows.join(small(gone), F.col("key") == F.col("gone"), "left_anti")
    if not again.limit(1).count():
        return left.select("row.*")
    # Copies that share an id, or have none: the longest original, then the smallest row by a hash.
    plain = left.join(small(again), F.col("key") == F.col("again"), "left_anti").select("row.*")
    tie = F.xxhash64(*[F.col("row")[name] for name, kind in docs.dtypes if "map<" not in kind])
    best = F.min_by("row", F.struct(-F.length(F.coalesce(F.col("row")["text"].cast("string"), F.lit(""))), tie))
    copies = rows.join(small(again), F.col("key") == F.col("again"), "left_semi").groupBy("key").agg(best.alias("row"))
    return plain.union(copies.select("row.*"))


__all__ = ["LsmIndex", "deduplicate", "duplicate_classes", "flush_runs", "merged"]
