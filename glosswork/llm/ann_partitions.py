"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``MAX_SAMPLE`` vectors, smallest hashes of vec_id) a neighbour graph is
built and cut into balanced parts, as many as grow with the root of the table; a small network learns, from a vector alone, in which parts
its neighbours lie.  Every row is indexed under its most probable part.  A query goes to
its several most probable parts - as many as a held-out share of the sample needs for
``TARGET_RECALL``, and beyond these until they hold as many candidates as asked for - and is
reranked there by exact inner products in double precision.

Parts are packed into tiles of bounded size: small parts share one, a part that holds a third of all
rows is dealt into many by hash.  Every row of the index travels once, to its tile; a query travels to the tiles of its own parts only.
In a task a tile's rows come first and its queries stream past them, so that memory follows the tile, however many queries there are.
A query sees only the parts it probes, and gets the best of all these from each tile; the best of its tiles are merged.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without vec_id; of rows that repeat a vec_id the smallest vector counts; shorter vectors
are filled with zeros; candidates of one score go by vec_id; a query gets fewer rows than asked for only if the table holds no more;
a table too small to learn from (64 rows at the default arguments) is one part; an empty table gives an empty result; further columns of any name
are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import hash_sample, save

MAX_SAMPLE, GRAPH_NEIGHBOURS, HIDDEN = 6_000, 16, 96
LEARNED_FROM = 20  # sampled vectors a part, at least
TARGET_RECALL = 0.95
TILE_ROWS = 16_384
NEAREST, QUERY_EVERY = 20, 20


def neighbours(points: np.ndarray, queries: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Numbers of each query's k nearest points by inner product; ``own`` numbers are left out."""
    out = []
    for start in range(0, len(queries), 1024):
        score = queries[start:start + 1024] @ points.T
        if own is not None:
            score[np.arange(len(score)), own[start:start + 1024]] = -np.inf
        out.append(np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, :k])
    return np.concatenate(out)


def number_of_parts(rows: int, sampled: int) -> int:
    """About a sixth of the root of the table, as far as the sample can tell so many apart."""
    return int(max(2, min(round(rows**0.5 / 6), sampled // LEARNED_FROM)))


def balanced_parts(graph: np.ndarray, points: np.ndarray, parts: int, seed: int = 5, slack: float = 1.1) -> np.ndarray:
    """Cut a neighbour graph into parts of at most ``slack`` times the mean size.

    Starts from balanced nearest centres, then vertices move to the part of most of their neighbours
    while there is room.
    """
    rng, n = np.random.default_rng(seed), len(points)
    room = int(np.ceil(slack * n / parts))
    centres = points[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=np.int64)
    for _ in range(6):
        score = points @ centres.T
        part = np.full(n, -1)
        free = np.full(parts, room)
        for v in np.argsort(-score.max(axis=1)):
            for p in np.argsort(-score[v]):
                if free[p]:
                    part[v], free[p] = p, free[p] - 1
                    break
        for p in range(parts):
            own = points[part == p]
            if len(own):
                mean = own.mean(axis=0)
                centres[p] = mean / max(1e-12, np.linalg.norm(mean))
    heads = [[] for _ in range(n)]
    for v in range(n):
        for u in graph[v]:
            heads[v].append(int(u))
            heads[int(u)].append(v)
    size = np.bincount(part, minlength=parts)
    for _ in range(8):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[heads[v]], minlength=parts)
            here = part[v]
            votes[(size >= room) & (np.arange(parts) != here)] = -1
            there = int(votes.argmax())
            if votes[there] > votes[here]:
                part[v], moved = there, moved + 1
                size[here] -= 1
                size[there] += 1
        if moved < n // 200:
            break
    return part


class PartModel:
    """A network with one hidden layer from a vector to part probabilities."""

    def __init__(self, weights: list[np.ndarray], parts: int):
        self.weights, self.parts = weights, parts

    def scores(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(x @ a + b) @ c + d


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_model(points: np.ndarray, target: np.ndarray, seed: int = 7, rounds: int = 40) -> PartModel:
    """Cross-entropy against each vector's share of neighbours by part, with Adam."""
    rng, (n, parts) = np.random.default_rng(seed), target.shape
    weights = [rng.normal(0, 1.5 / np.sqrt(points.shape[1]), (points.shape[1], HIDDEN)) * np.sqrt(points.shape[1]) / 4, np.zeros(HIDDEN), rng.normal(0, 0.1, (HIDDEN, parts)), np.zeros(parts)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(rounds):
        order = rng.permutation(n)
        for start in range(0, n, 128):
            at = order[start:start + 128]
            x = points[at]
            h = np.tanh(x @ weights[0] + weights[1])
            z = h @ weights[2] + weights[3]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - target[at]) / len(at)
            back = (g @ weights[2].T) * (1 - h * h)
            step += 1
            for i, d in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                d = d + 1e-4 * weights[i]
                first[i] = 0.9 * first[i] + 0.1 * d
                second[i] = 0.999 * second[i] + 0.001 * d * d
                weights[i] = weights[i] - 0.004 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return PartModel(weights, parts)


def learn(sample: np.ndarray, parts: int, nearest: int = NEAREST, target: float = TARGET_RECALL) -> tuple[PartModel, int]:
    """A model and the number of parts to probe, from a bounded sample."""
    points, n = unit_rows(sample), len(sample)
    graph = neighbours(points, points, GRAPH_NEIGHBOURS, np.arange(n))
    part = balanced_parts(graph, points, parts)
    shares = np.stack([np.bincount(part[g], minlength=parts) for g in graph]) + (part[:, None] == np.arange(parts)) * 2.0
    shares /= shares.sum(axis=1, keepdims=True)
    fitting = np.arange(n) % 4 != 0
    model = fit_model(points[fitting], shares[fitting])
    held = np.flatnonzero(~fitting)
    score = model.scores(points)
    home = score.argmax(axis=1)
    true = neighbours(sample, sample[held], nearest, held)
    rank = np.argsort(np.argsort(-score[held], axis=1), axis=1)
    found = np.take_along_axis(rank, home[true], axis=1)
    recall = [(found < m).mean() for m in range(1, parts + 1)]
    return model, next((m for m, r in enumerate(recall, 1) if r >= target), parts)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vec) of the rows that take part, as doubles of one length."""
    vec = F.col("embedding").cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda x: x != 0))
    rows = save(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "ann-vectors")
    width = rows.agg(F.max(F.size("vec"))).first()[0] or 1
    short = rows.where(F.size("vec") < width).limit(1).count()
    return rows.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("vec")))) if short else rows


def best_in_tile(queries: np.ndarray, ids: np.ndarray, allowed: np.ndarray, points: np.ndarray, numbers: np.ndarray, part: np.ndarray, k: int):
    """(query, candidates, scores) of each query's k best among the parts it is allowed, exact, ties to the smaller vec_id."""
    for start in range(0, len(queries), 128):
        score = queries[start:start + 128] @ points.T
        score[~allowed[start:start + 128][:, part] | (ids[start:start + 128, None] == numbers[None, :])] = -np.inf
        if score.shape[1] > k:
            bound = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            bound = np.where(np.isfinite(bound), bound - 1e-9 * np.maximum(1.0, np.abs(bound)), -np.finfo(float).max)
        else:
            bound = np.full(len(score), -np.finfo(float).max)
        for i, row in enumerate(score):
            at = np.flatnonzero(row >= bound[i])
            exact = (points[at] * queries[start + i]).sum(axis=1)
            best = np.lexsort((numbers[at], -exact))[:k]
            yield ids[start + i], numbers[at[best]], exact[best]


def shelve(counts: dict[int, int], size: int = TILE_ROWS) -> dict[int, tuple[int, int]]:
    """part -> (shelf, columns): small parts share a shelf of up to ``size`` rows, larger ones have several columns of their own."""
    out, shelf, room = {}, 0, 0
    for part, n in sorted(counts.items(), key=lambda c: (-c[1], c[0])):
        if n >= size:
            shelf, out[part], room = shelf + 1, (shelf, -(-n // size)), 0
        else:
            if n > room:
                shelf, room = shelf + 1, size
            out[part], room = (shelf - 1, 1), room - n
    return out


def nearest_vectors(embeddings: DataFrame, nearest: int = NEAREST, query_every: int = QUERY_EVERY,
                    parts: int | None = None, probes: int | None = None) -> DataFrame:
    """For each row whose vec_id ``query_every`` divides: query_id, rank, vec_id, score of its nearest, and how many rows were scored for it."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    n = rows.count()
    sample = hash_sample(rows, F.xxhash64("vec_id"), MAX_SAMPLE, n, "vec_id").toPandas()
    parts = parts or number_of_parts(n, len(sample))
    if len(sample) > max(4 * GRAPH_NEIGHBOURS, 4 * parts, nearest + 1):
        model, learned = learn(np.stack(sample["vec"].to_numpy()).astype(float), parts, nearest)
        probes = probes or learned
    else:
        model, parts, probes = None, 1, 1
    shipped = spark.sparkContext.broadcast(model)

    def order(vecs: pd.Series) -> np.ndarray:
        if shipped.value is None or not len(vecs):
            return np.zeros((len(vecs), 1), dtype=np.int32)
        score = shipped.value.scores(unit_rows(np.stack(vecs.to_numpy()).astype(float)))
        return np.argsort(-score, axis=1, kind="stable").astype(np.int32)

    home = F.pandas_udf(lambda v: pd.Series(order(v)[:, 0]), "int")
    index = save(rows.withColumn("part", home("vec")), "ann-index")
    # As many counts come to the driver as there are parts, at most MAX_SAMPLE / LEARNED_FROM.
    counts = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    places = shelve(counts)
    size = np.array([counts.get(p, 0) for p in range(parts)])

    def route(vecs: pd.Series) -> pd.DataFrame:
        # The query itself may be one of the rows and is no candidate.
        by = order(vecs)
        within = size[by].cumsum(axis=1)
        need = np.minimum(np.maximum(probes, (within - 1 < nearest).sum(axis=1) + 1), by.shape[1])
        return pd.DataFrame({"parts": [own[:m] for own, m in zip(by, need, strict=True)], "scored": np.take_along_axis(within, need[:, None] - 1, axis=1)[:, 0] if len(by) else []})

    if not places:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("scored")).limit(0)
    shelf_of = F.create_map(*[F.lit(x) for p, (shelf, _) in sorted(places.items()) for x in (p, shelf)])
    columns_of = F.create_map(*[F.lit(x) for shelf, columns in sorted(dict(places.values()).items()) for x in (shelf, columns)])
    shelves = F.filter(F.transform("to.parts", lambda p: F.element_at(shelf_of, p)), lambda x: x.isNotNull())
    asked = rows.where(F.col("vec_id") % query_every == 0).withColumn("to", F.pandas_udf(route, "parts array<int>, scored long")("vec"))
    asked = asked.select("vec_id", "vec", F.col("to.parts").alias("probed"), F.col("to.scored").alias("scored"), F.explode(F.array_distinct(shelves)).alias("shelf"))
    every_column = F.explode(F.sequence(F.lit(0), F.element_at(columns_of, F.col("shelf")) - 1))
    right = asked.select("shelf", every_column.alias("column"), F.lit(True).alias("asks"), "vec_id", "vec", F.lit(-1).alias("part"), "probed", "scored")
    placed = index.withColumn("shelf", F.element_at(shelf_of, F.col("part")))
    own_column = F.pmod(F.xxhash64("vec_id"), F.element_at(columns_of, F.col("shelf"))).cast("int")
    left = placed.select("shelf", own_column.alias("column"), F.lit(False).alias("asks"), "vec_id", "vec", "part", F.lit(None).cast("array<int>").alias("probed"), F.lit(0).cast("long").alias("scored"))

    def search(batches):
        here, held = None, []
        for batch in batches:
            at = batch[["shelf", "column", "asks"]].to_numpy().astype(np.int64)
            ends = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(batch)]
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                part = batch.iloc[a:b]
                if tuple(at[a, :2]) != here:
                    here, held, tile = tuple(at[a, :2]), [], None
                if not at[a, 2]:
                    held.append((np.stack(part["vec"].to_numpy()), part["vec_id"].to_numpy(), part["part"].to_numpy()))
                elif held:
                    tile = tile or tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    yield answers(part, *tile)

    def answers(queries, points, numbers, part_of):
        allowed = np.zeros((len(queries), parts), dtype=bool)
        for i, own in enumerate(queries["probed"]):
            allowed[i, own] = True
        got = list(best_in_tile(np.stack(queries["vec"].to_numpy()), queries["vec_id"].to_numpy(), allowed, points, numbers, part_of, nearest))
        sizes = [len(v) for _, v, _ in got]
        return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in got], sizes), "vec_id": np.concatenate([v for _, v, _ in got]),
                             "score": np.concatenate([s for _, _, s in got]), "scored": np.repeat(queries["scored"].to_numpy(), sizes)})

    key = ["shelf", "column"]
    dealt = save(right, "ann-queries").union(left).repartition(*key).sortWithinPartitions(*key, "asks", "vec_id")
    found = dealt.mapInPandas(search, "query_id long, vec_id long, score double, scored long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score", "scored")
