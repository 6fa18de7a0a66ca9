"""Line dedup over a suffix array of line sequences.

The corpus is one sequence of line ids: all documents by doc_id, each one's lines that
are not blank.  Lines that occur once in the corpus are found by counting hashes and, through a filter of bounded
size, never travel; a suffix runs to the next of these or to the end of its document.

Distributed prefix doubling ranks the suffixes: after level j equal ranks mean equal first 2^j lines (or equal whole suffixes).  A rank is the
number of smaller suffixes, so that a group that splits keeps the order of all others; only groups with several members that have not
ended go on.  A group's parts are counted before they are ordered, so what is sorted is counts by (rank, next rank), never a group's members.
Sorted by their last ranks the suffixes are a suffix array.  The longest common prefix of two neighbours there is read
from their ranks by level: the highest level that agrees gives so many lines, then both go on behind these, until they differ.

Neighbours that share at least ``MIN_LINES`` lines make an interval; its members start the same run, and all but the first in
corpus order are later copies, whose lines go.  As every later part of a run starts a run itself, so go whole maximal
runs.  A line alone goes if it has at least ``MIN_WORDS`` words and occurs earlier.

Joins that bring ranks or intervals back to their members have plain tables on both sides, of which adaptive
execution splits a hot one.

Lines are compared without white space at their ends, by 128-bit hashes.  Defined
results: null text is empty and has no lines; blank lines count in ``n_lines`` but
are neither compared nor deleted; a null doc_id comes last; rows that repeat both doc_id and
text are one document; of copies with one doc_id the smaller digest of the text comes first; a very long text is one row, its lines are
ranked like all others; an empty table gives an empty result; only doc_id and text are read, further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, build_filter, id_or_last, null_again, save

MIN_LINES, MIN_WORDS = 3, 10


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two words of each line's hash."""
    raw = b"".join([hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for line in lines])
    words = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
    return words[:, 0].copy(), words[:, 1].copy()


def hit_runs(hit: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of lines of the documents that lie at ``offsets`` the hit ones: (place, document, place behind the run of hits), places over all documents."""
    n = len(hit)
    barrier = np.append(~hit, True)
    barrier[offsets] = True
    stop = np.minimum.accumulate(np.where(barrier, np.arange(n + 1), n)[::-1])[::-1]
    at = np.flatnonzero(hit)
    return at, np.searchsorted(offsets, at, "right") - 1, stop[at + 1]


def text_key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, stripped line) of the lines that are not blank."""
    return [(i, s) for i, line in enumerate(text.split("\n")) if (s := line.strip())]


def line_sequence(docs: DataFrame) -> DataFrame:
    """The documents in corpus order with their repeated lines: place, end of the suffix, number, h1, h2, words."""
    spark = docs.sparkSession
    texts = docs.select(id_or_last(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches):
        for batch in batches:
            key, n = np.unique(line_keys([line for text in batch["text"] for _, line in lines_of(text)])[0], return_counts=True)
            yield pd.DataFrame({"key": key, "n": n.astype(np.int64)})

    counts = texts.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = spark.sparkContext.broadcast(build_filter(save(counts.where("n > 1").select("key"), "line-repeated")))

    def mark(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            own = [lines_of(text) for text in texts]
            lines = [line for found in own for _, line in found]
            numbers = np.array([i for found in own for i, _ in found], dtype=np.int32)
            n_full = np.array([len(found) for found in own], dtype=np.int64)
            offsets = np.append(0, np.cumsum(n_full))
            h1, h2 = line_keys(lines)
            at, doc, stop = hit_runs(repeated.value.test(h1.view(np.uint64)), offsets)
            first = offsets[doc]
            words = np.array([len(lines[i].split()) for i in at], dtype=np.int32)
            fields = [pa.array(x) for x in ((at - first).astype(np.int32), (stop - first).astype(np.int32), numbers[at], h1[at], h2[at], words)]
            marks = pa.StructArray.from_arrays(fields, ["at", "stop", "number", "h1", "h2", "words"])
            n_lines = pa.array([text.count("\n") + 1 if text else 0 for text in texts], pa.int64())
            columns = [batch.column(0), pa.array([text_key(text) for text in texts], pa.binary()), n_lines, pa.array(n_full),
                       pa.ListArray.from_arrays(pa.array(np.searchsorted(at, offsets).astype(np.int32)), marks)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_lines", "n_full", "marks"])

    mark_type = "array<struct<at:int,stop:int,number:int,h1:long,h2:long,words:int>>"
    marked = texts.mapInArrow(mark, f"doc_id long, digest binary, n_lines long, n_full long, marks {mark_type}")
    marked = marked.groupBy("doc_id", "digest").agg(*[F.min(c).alias(c) for c in ("n_lines", "n_full", "marks")])
    parts = max(8, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = marked.repartitionByRange(parts, "doc_id", "digest").sortWithinPartitions("doc_id", "digest")

    def place(batches):
        from pyspark import TaskContext

        part, base = TaskContext.get().partitionId(), 0
        for batch in batches:
            before = base + np.concatenate([[0], np.cumsum(batch["n_full"].to_numpy())])
            base = int(before[-1])
            yield batch.assign(part=part, base=before[:-1])

    return save(ordered.mapInPandas(place, f"doc_id long, digest binary, n_lines long, n_full long, marks {mark_type}, part int, base long"), "line-documents")


def offsets_of(placed: DataFrame, value: str) -> DataFrame:
    """(part, offset): sums of ``value`` over earlier range partitions, one number a partition, added up on the driver."""
    sizes = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.sum(value).alias("n")).collect()}
    offset, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, offset))
        offset += sizes[part]
    return F.broadcast(placed.sparkSession.createDataFrame(rows, "part int, offset long"))


def positions(placed: DataFrame) -> DataFrame:
    """(pos, rest, h1, h2, words, number, doc_id, digest) of the repeated lines; rest: lines to the end of the suffix."""
    based = placed.join(offsets_of(placed, "n_full"), "part").withColumn("start", F.col("base") + F.col("offset"))
    return based.select("doc_id", "digest", "start", F.explode("marks").alias("m")).select(
        (F.col("start") + F.col("m.at")).alias("pos"), (F.col("m.stop") - F.col("m.at")).cast("long").alias("rest"), "m.h1", "m.h2", "m.words", "m.number", "doc_id", "digest")


def running(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``value`` over all rows that are smaller in ``order``; written to the shared folder."""
    def add(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sums = total + np.concatenate([[0], np.cumsum(batch[value].to_numpy(dtype=np.int64))])
            total = int(sums[-1])
            yield batch.assign(part=part, before=sums[:-1])

    schema = ", ".join(f"{n} {kind}" for n, kind in df.dtypes) + ", part int, before long"
    summed = save(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(add, schema), name)
    return summed.join(offsets_of(summed, value), "part").withColumn("before", F.col("before") + F.col("offset")).drop("part", "offset")


def suffix_ranks(located: DataFrame) -> list[DataFrame]:
    """The levels of prefix doubling: (pos, rest, rank, open, and at the first level, first: the class's smallest pos)."""
    classes = located.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("rest").alias("longest"), F.min("pos").alias("first"))
    classes = save(running(classes, ["h1", "h2"], "n", "line-classes"), "line-ranked")
    go_on = (F.col("n") > 1) & (F.col("longest") > 1)
    levels = [save(located.join(classes, ["h1", "h2"]).select("pos", "rest", F.col("before").alias("rank"), go_on.alias("open"), "first"), "line-level")]
    h, n_open = 1, levels[0].where("open").count()
    while n_open:
        now = None
        for i, level in enumerate(levels):
            settled = (level if i == len(levels) - 1 else level.where("not open")).select("pos", "rank")
            now = settled if now is None else now.union(settled)
        behind = now.select((F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        mine = levels[-1].where("open").select("pos", "rest", "rank")
        if n_open <= BROADCAST_ROWS:  # few suffixes go on: the ranks of all others stay where they are
            behind = behind.join(F.broadcast(mine.select("pos")), "pos", "left_semi")
        # A suffix that has ended comes before those that go on.
        keyed = mine.join(behind, "pos", "left").select("pos", "rest", "rank", F.when(F.col("rest") > h, F.col("next")).otherwise(-1).alias("next"))
        keyed = save(keyed, "line-keyed", n_open)
        parts = keyed.groupBy("rank", "next").agg(F.count("*").alias("n"), F.max("rest").alias("longest"))
        parts = running(parts, ["rank", "next"], "n", "line-parts")
        starts = save(parts.groupBy("rank").agg(F.min("before").alias("start")), "line-starts", n_open)
        h *= 2
        parts = save(parts.join(starts, "rank").select(
            "rank", "next", (F.col("rank") + F.col("before") - F.col("start")).alias("fresh"), ((F.col("n") > 1) & (F.col("longest") > h)).alias("open")), "line-split", n_open)
        levels.append(save(keyed.join(parts, ["rank", "next"]).select("pos", "rest", F.col("fresh").alias("rank"), "open"), "line-level", n_open))
        n_open = levels[-1].where("open").count()
    return levels


def levels_shared(a, b) -> int:
    """On how many levels two suffixes' ranks agree; if on one, then on all before."""
    return sum(x == y for x, y in zip(a, b, strict=False))


def neighbours(levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(suffix array: part, nth, pos, rest, and of the neighbour before it that shares a line: prev, prev_rest and agree, the levels
    on which their ranks agree; ranks: pos, rest, ranks by level)."""
    every = [level.select("pos", "rest", F.struct(F.lit(j).alias("j"), "rank").alias("r")) for j, level in enumerate(levels)]
    union = every[0]
    for level in every[1:]:
        union = union.union(level)
    ranks = union.groupBy("pos").agg(F.min("rest").alias("rest"), F.transform(F.array_sort(F.collect_list("r")), lambda r: r["rank"]).alias("ranks"))
    ranks = save(ranks, "line-ranks")

    def pair(batches):
        from pyspark import TaskContext

        part, nth, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            pos, rest, own = batch["pos"].tolist(), batch["rest"].tolist(), [x.tolist() for x in batch["ranks"]]
            before = [last, *zip(pos, rest, own, strict=True)]
            agree = [levels_shared(b[2], x) if b else 0 for b, x in zip(before, own, strict=False)]
            near = [b if n else (None, None) for b, n in zip(before, agree, strict=False)]
            yield pd.DataFrame({"pos": pos, "rest": rest, "part": part, "nth": np.arange(nth, nth + len(pos)), "agree": agree,
                                "prev": pd.array([b[0] for b in near], dtype="Int64"), "prev_rest": pd.array([b[1] for b in near], dtype="Int64")})
            last, nth = before[-1], nth + len(pos)

    order = [F.element_at("ranks", -1), F.col("pos")]
    sorted_ = ranks.repartitionByRange(*order).sortWithinPartitions(*order)
    array = save(sorted_.mapInPandas(pair, "pos long, rest long, part int, nth long, agree int, prev long, prev_rest long"), "line-suffixes")
    # The first suffix of a range partition: its neighbour is the last of the one before; two rows a partition come to the driver.
    ends = array.groupBy("part").agg(F.min_by("pos", "nth").alias("first"), F.max_by("pos", "nth").alias("last")).orderBy("part").collect()
    wanted = array.sparkSession.createDataFrame([(r[x],) for r in ends for x in ("first", "last")], "pos long").distinct()
    known = {r["pos"]: r for r in ranks.join(F.broadcast(wanted), "pos").collect()}
    rows = [(b["first"], a["last"], known[a["last"]]["rest"], n) for a, b in zip(ends, ends[1:], strict=False)
            for n in [levels_shared(known[a["last"]]["ranks"], known[b["first"]]["ranks"])] if n]
    seam = F.broadcast(array.sparkSession.createDataFrame(rows, "pos long, seam long, seam_rest long, seam_agree int"))
    whole = array.join(seam, "pos", "left").select(
        "part", "nth", "pos", "rest", F.coalesce("seam_agree", "agree").alias("agree"), F.coalesce("prev", "seam").alias("prev"), F.coalesce("prev_rest", "seam_rest").alias("prev_rest"))
    return whole, ranks


def common_prefixes(array: DataFrame, ranks: DataFrame) -> DataFrame:
    """(pos, prev, lcp): how many lines each suffix shares with its neighbour in the suffix array, where these are any."""
    open_ = array.where("prev is not null").select(
        "pos", "prev", F.col("pos").alias("a"), F.col("rest").alias("a_rest"), F.col("prev").alias("b"), F.col("prev_rest").alias("b_rest"), "agree")
    agree = F.size(F.filter(F.zip_with("a_ranks", "b_ranks", lambda x, y: x.eqNullSafe(y)), lambda same: same))
    shared = F.when(F.col("agree") > 0, F.pow(F.lit(2.0), F.col("agree") - 1).cast("long")).otherwise(0)
    side = lambda x: ranks.select(F.col("pos").alias(x), F.col("rest").alias(f"{x}_rest"), F.col("ranks").alias(f"{x}_ranks"))
    found = []
    while True:
        step = open_.withColumn("gain", F.least(shared, "a_rest", "b_rest"))
        # Behind lines that agree both go on, unless one has ended.
        step = step.withColumn("more", (F.col("gain") > 0) & (F.col("gain") < F.least("a_rest", "b_rest")))
        step = save(step.select("pos", "prev", "gain", "more", (F.col("a") + F.col("gain")).alias("a"), (F.col("b") + F.col("gain")).alias("b")), "line-prefixes")
        found.append(step.select("pos", "prev", "gain"))
        again = step.where("more").select("pos", "prev", "a", "b")
        n = again.count()
        if not n:
            break
        open_ = again.join(few(side("a"), again, "a", n), "a").join(few(side("b"), again, "b", n), "b").withColumn("agree", agree)
    every = found[0]
    for part in found[1:]:
        every = every.union(part)
    return save(every.groupBy("pos", "prev").agg(F.sum("gain").alias("lcp")), "line-lcp")


def few(table: DataFrame, asked: DataFrame, key: str, n: int) -> DataFrame:
    """``table``, or if few rows ask for it only what they ask for, found where it lies."""
    return table.join(F.broadcast(asked.select(key).distinct()), key, "left_semi") if n <= BROADCAST_ROWS else table


def repeated_runs(located: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lines to delete: pos; longest runs: pos, run - the most lines from there on that also stand elsewhere)."""
    levels = suffix_ranks(located)
    array, ranks = neighbours(levels)
    lcp = common_prefixes(array, ranks)
    placed = array.select("part", "nth", "pos").join(lcp.select("pos", "lcp"), "pos", "left")
    placed = placed.select("part", "nth", "pos", F.when(F.coalesce("lcp", F.lit(0)) < min_lines, 1).otherwise(0).alias("cut"))
    intervals = running(placed.withColumnRenamed("part", "block"), ["block", "nth"], "cut", "line-cuts").select("pos", (F.col("before") + F.col("cut")).alias("interval"))
    intervals = save(intervals, "line-intervals")
    firsts = save(intervals.groupBy("interval").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select("interval", "first"), "line-firsts")
    later = intervals.join(firsts, "interval").where("pos <> first")
    gone = later.select(F.explode(F.sequence(F.col("pos"), F.col("pos") + (min_lines - 1))).alias("pos"))
    again = levels[0].where("pos <> first").select("pos")
    alone = located.where(F.col("words") >= min_words).select("pos").join(again, "pos", "left_semi")
    runs = lcp.select("pos", "lcp").union(lcp.select("prev", "lcp")).groupBy("pos").agg(F.max("lcp").alias("run"))
    return gone.union(alone).distinct(), runs


def dedup_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: doc_id, digest, n_lines, n_removed, removed (line numbers from 0), longest (the most lines in
    a row that also stand at another place of the corpus, blank ones not counted)."""
    placed = line_sequence(docs)
    located = save(positions(placed), "line-positions")
    gone, longest = repeated_runs(located, min_lines, min_words)
    lines = located.join(gone.withColumn("gone", F.lit(True)), "pos", "left").join(longest, "pos", "left")
    key = [F.col("doc_id") == F.col("_id"), F.col("digest") == F.col("_digest")]
    found = lines.where("gone or run is not null").groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.array_sort(F.collect_list(F.when(F.col("gone"), F.col("number")))).alias("removed"), F.max("run").alias("longest"))
    every = placed.select("doc_id", "digest", "n_lines").join(found, key[0] & key[1], "left").select(
        "doc_id", "digest", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", F.array().cast("array<int>")).alias("removed"), F.coalesce("longest", F.lit(0)).alias("longest"))
    return null_again(every, "doc_id")


def removed_lines(docs: DataFrame) -> DataFrame:
    """:func:`dedup_runs` with the line numbers as a string."""
    got = dedup_runs(docs)
    return got.select("doc_id", "n_lines", "n_removed", F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), "longest")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id and the text without the deleted lines."""
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone) if len(gone) else t or ""
                          for t, r in zip(texts, removed, strict=True) for gone in [set(r) if r is not None else set()]], dtype=object)

    digest = F.pandas_udf(lambda texts: pd.Series([text_key(t or "") for t in texts], dtype=object), "binary")
    found = dedup_runs(docs).select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "removed")
    keyed = docs.select("doc_id", "text").withColumn("digest", digest("text"))
    both = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return both.select("doc_id", F.pandas_udf(cut, "string")("text", "removed").alias("text"))


__all__ = ["dedup_lines", "dedup_runs", "removed_lines", "repeated_runs"]
