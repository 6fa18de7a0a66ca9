"""Filter interaction audit: what each of five filters removes in every order of the five.

A document's failures are five bits.  Given an order, it is removed at the first step whose filter it fails, and that step depends on
nothing but the bits: a table of 32 by 120, made once, holds it for every order.  ``mapInArrow`` reads a few bytes of each document
(its part, bits and labels), looks up its 120 steps and adds them up with ``np.bincount``; a task sends one row of partial sums for each part, and these
are summed by part and slot.

The bits of the first four filters are DataFrame functions over the whole text.  The fifth (E) asks whether a smaller doc_id has the identical text:
texts are grouped by sha256, and only those with several documents are joined back, as plain tables, so that adaptive execution
splits a text that a third of all rows share.

Defined results: null text is empty, null lang is the part ``''``; a null doc_id is larger than any other and has no labels; rows that
repeat a doc_id each count, and do not make each other fail E; a document with several label rows is good, or toxic, if one of them says so;
a document without labels is neither; a very long text is one row; an empty table gives no part and so no row; further columns
of any name are left alone.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_or_last, save, small, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
N = len(FILTERS)
# The limits of the filters.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"
HELD_PARTS = 256  # parts that a task adds up before it sends them on
# Slots of a part's sums: removals by order and step, then by filter: failing, failing no other, removed over all orders; then all documents.
FAILS, ONLY, ALL_ORDERS, TOTAL = (len(ORDERS) * N + i * N for i in range(4))


def first_failures() -> np.ndarray:
    """For each set of failures (bits) and each order the step, from 0, that removes; ``N`` where none does."""
    table = np.full((1 << N, len(ORDERS)), N, dtype=np.int64)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(N)):
            fails = (np.arange(1 << N) >> FILTERS.index(order[step])) & 1 == 1
            table[fails, o] = step
    return table


def failures(text: Column) -> Column:
    """The bits of the filters that look at a text alone."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    few = F.size(words) < MIN_WORDS
    dull = 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words)
    loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS_PERCENT * F.length(text)
    bits = [few, dull, loud, text.rlike(SYMBOLS)]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: part, fails (all five bits), label (1: good, 2: toxic, 3: both, 0: neither or unknown)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(id_or_last(), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failures(text).alias("fails"))
    rows = save(rows, "audit-documents")
    copies = save(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first"), "audit-copies")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 2).otherwise(0)).alias("toxic"))
    known = save(known.select("doc_id", (F.col("good") + F.col("toxic")).alias("label")).where("label > 0"), "audit-labels")
    both = rows.join(small(copies), "digest", "left").join(small(known), "doc_id", "left")
    again = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return both.select("part", (F.col("fails") + again).alias("fails"), F.coalesce("label", F.lit(0)).alias("label"))


def partial_sums(batches):
    """Rows (part, n, good, toxic) of a task's sums by slot from batches of (part, fails, label)."""
    steps, orders = first_failures(), np.arange(len(ORDERS)) * (N + 1)
    cells = len(ORDERS) * (N + 1)
    bits = (np.arange(1 << N)[:, None] >> np.arange(N)) & 1
    place = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])  # at which step of an order a filter is
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def flush():
        out = []
        for part, (removed, masks) in held.items():
            by_label = removed.reshape(4, len(ORDERS), N + 1)[:, :, :N]
            every, good, toxic = by_label.sum(axis=0), by_label[1] + by_label[3], by_label[2] + by_label[3]
            over_all = np.take_along_axis(every, place, axis=1).sum(axis=0)
            tail = [*(masks @ bits), *masks[1 << np.arange(N)], *over_all, masks.sum()]
            out.append((part, np.concatenate([every.ravel(), tail]).astype(np.int64), *(np.concatenate([x.ravel(), np.zeros(len(tail))]).astype(np.int64) for x in (good, toxic))))
        held.clear()
        arrays = [pa.array([r[0] for r in out], pa.string()), *(pa.array([r[i] for r in out], pa.list_(pa.int64())) for i in (1, 2, 3))]
        return pa.RecordBatch.from_arrays(arrays, names=["part", "n", "good", "toxic"])

    for batch in batches:
        codes, parts = pd.factorize(batch.column(0).to_pandas())
        fails, label = batch.column(1).to_numpy().astype(np.int64), batch.column(2).to_numpy().astype(np.int64)
        order = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[order], np.arange(len(parts) + 1))
        for i, part in enumerate(parts):
            own = order[bounds[i]:bounds[i + 1]]
            at = label[own, None] * cells + orders + steps[fails[own]]
            removed, masks = np.bincount(at.ravel(), minlength=4 * cells), np.bincount(fails[own], minlength=1 << N)
            before = held.get(part)
            held[part] = (removed, masks) if before is None else (before[0] + removed, before[1] + masks)
            if len(held) >= HELD_PARTS:
                yield flush()
    if held:
        yield flush()


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    rows = judged(docs, labels)
    with small_batches(docs.sparkSession):
        sums = save(rows.mapInArrow(partial_sums, "part string, n array<long>, good array<long>, toxic array<long>"), "audit-sums")
    slots = sums.select("part", F.posexplode(F.arrays_zip("n", "good", "toxic")).alias("slot", "s"))
    slots = slots.groupBy("part", "slot").agg(*[F.sum(f"s.{c}").alias(c) for c in ("n", "good", "toxic")])
    parts = slots.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "good", "toxic"))).alias("s"))
    order = F.get(F.array(*[F.lit(o) for o in ORDERS]), F.floor(F.col("at") / N).cast("int"))
    cells = parts.select("part", "s", F.explode(F.sequence(F.lit(0), F.lit(len(ORDERS) * N - 1))).alias("at")).select(
        "part", "s", "at", order.alias("filter_order"), (F.col("at") % N + 1).cast("int").alias("step"))
    cells = cells.withColumn("f", F.instr(F.lit(FILTERS), F.expr("substring(filter_order, step, 1)")) - 1)
    slot = lambda at, name="n": F.get("s", at)[name]
    so_far = F.aggregate(F.slice("s", F.col("at") - F.col("step") + 2, F.col("step")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return cells.select(
        "part", "filter_order", "step", (slot(F.lit(TOTAL)) - so_far).alias("kept"), slot(F.col("at")).alias("removed"),
        (slot(FAILS + F.col("f")) - slot(F.col("at"))).alias("redundant"), slot(ONLY + F.col("f")).alias("unique_fails"),
        slot(F.col("at"), "good").alias("good_lost"), slot(F.col("at"), "toxic").alias("toxic_lost"), slot(ALL_ORDERS + F.col("f")).alias("shapley"))


__all__ = ["audit", "first_failures", "judged", "partial_sums"]
