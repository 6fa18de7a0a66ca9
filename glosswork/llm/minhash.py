"""MinHash near-dedup with DartMinHash signatures.

A document is the weighted set of its five-word shingles, a shingle's weight being its
count.  Each unit of an element's weight is a strip on which hashed darts land by a
Poisson process along the rank axis; all darts with rank up to theta = t / total weight
are thrown, about t = k ln k + 2k of them however long the text, each goes to one of k
coordinates, and every coordinate keeps its earliest dart.  Two documents agree on a
coordinate with the probability of their weighted Jaccard similarity.  Documents that
leave a coordinate empty throw again with twice the theta.

Bands of the signature give buckets.  Texts with equal word sequences are one
representative first (by partial aggregation).  In a bucket every member is compared with its smallest member;
that settles buckets of near copies, however hot.  Buckets whose members still are of several classes (mixed
buckets) are dealt into tiles of bounded size, to which the members' whole shingle sets are brought.  A tile verifies
there every pair of members of different classes whose signatures agree in ``LEAST_AGREEMENT`` of the
coordinates (a pair at the threshold stays below that with a probability of about 1e-5), in the first band that the two
share, so that no pair is verified twice.  Links are joined within the tile as they are found, likeliest pairs first; only a
link that joins two trees leaves it, so that a tile of m members gives m - 1 rows at most and pairs that fail give none.
No bucket is capped, and pairs within a class are not needed.  Every link is verified by the exact weighted Jaccard
similarity of whole texts.  The forests of all tiles are closed into classes.

Words are runs of ASCII letters, digits, ``_`` and of all characters beyond ASCII, in
lower case.  Defined results: a text of one to four words has one shingle, all of it; a
text without words is in a class only with identical texts (null counts as empty); rows that repeat a
doc_id share a class, even with different texts; a null doc_id has class null; ties of similarity do not matter, as a class
is named by its smallest doc_id; a very long text is hashed in pieces of ``SLICE`` bytes, its shingles take some 100 bytes a word
of memory; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows
from ._common import build_filter, components, file_count, mix64, save

WORDS = 5
SIMILARITY = 0.8
COORDINATES, ROWS = 125, 5  # 25 bands of 5
LEAST_AGREEMENT = 0.65
TILE_ROWS, TILE_KEYS = 256, 500_000  # of each side of a tile: rows, shingles
VERIFY_AT_ONCE = 256  # pairs verified before classes are looked at anew, times 4 each turn
SLICE = 1_000_000  # characters handled at once
STRIPS = 250_000  # strips that throw their darts at once

WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_":
    WORD_BYTES[_c] = True
GOLD = np.uint64(0x9E3779B97F4A7C15)


def slices(texts: list[str]):
    """Runs of consecutive texts of about SLICE characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) + 1
        if size >= SLICE:
            yield start, texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every word of ``texts``, in order."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
    raw = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    hashes, places, at = [], [], 0
    while at < len(raw):
        end = at + SLICE
        while end < len(raw):  # on to the end of a word
            gap = np.flatnonzero(~WORD_BYTES[raw[end:end + 4096]])
            if len(gap):
                end += int(gap[0]) + 1
                break
            end += 4096
        hashed, first = piece_hashes(raw[at:end])
        hashes.append(hashed)
        places.append(first + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(starts, np.concatenate(places), side="right") - 1


def piece_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every word of some bytes."""
    inside = WORD_BYTES[raw]
    before = np.concatenate([[False], inside[:-1]])
    first = np.flatnonzero(inside & ~before)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(inside)
    length = np.diff(np.append(np.searchsorted(at, first), len(at)))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[1], np.full(int(length.max()) - 1, 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)
        offset = at - np.repeat(first, length)
        hashed = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * power[offset], np.cumsum(length) - length)
    return mix64(hashed + length.astype(np.uint64)), first


def shingles(words: np.ndarray, doc: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of every shingle; a document of fewer than ``n`` words has one."""
    if not len(words):
        return words, doc
    salt = mix64(np.arange(1, n + 1, dtype=np.uint64) * GOLD) | np.uint64(1)
    out, owner = [], []
    with np.errstate(over="ignore"):
        if len(words) >= n:
            whole = doc[n - 1:] == doc[:len(doc) - n + 1]
            total = sum((words[j:len(words) - n + 1 + j] * salt[j] for j in range(1, n)), words[:len(words) - n + 1] * salt[0])
            out.append(mix64(total[whole]))
            owner.append(doc[n - 1:][whole])
        numbers, first, count = np.unique(doc, return_index=True, return_counts=True)
        for k in np.flatnonzero(count < n):
            own = words[first[k]:first[k] + count[k]]
            out.append(mix64(np.array([(own * salt[:count[k]]).sum() + np.uint64(count[k])], dtype=np.uint64)))
            owner.append(numbers[k:k + 1])
    return np.concatenate(out), np.concatenate(owner)


def weighted_set(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, shingle, count), sorted by both."""
    h, doc = shingles(*word_hashes(texts))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h))).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def dart_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, k: int = COORDINATES) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of weighted sets: (document numbers, array of k earliest darts each).

    Strips are units of weight; the last strip of an element may be narrower, its darts then
    have to land within the width.
    """
    numbers, place = np.unique(doc, return_inverse=True)
    total = np.bincount(place, weight) if len(place) else np.zeros(0)
    signature = np.full((len(numbers), k), np.iinfo(np.uint64).max, dtype=np.uint64)
    units = np.ceil(weight).astype(np.int64)
    ends = np.cumsum(units)
    darts, todo = k * np.log(max(2, k)) + 2 * k, np.arange(len(numbers))
    while len(todo):
        theta = np.zeros(len(numbers))
        theta[todo] = darts / np.maximum(total[todo], 1e-12)
        for start in range(0, int(ends[-1]) if len(ends) else 0, STRIPS):
            strip = np.arange(start, min(start + STRIPS, int(ends[-1])))
            of = np.searchsorted(ends, strip, side="right")
            of, strip = of[theta[place[of]] > 0], strip[theta[place[of]] > 0]
            if len(of):
                nth = strip - (ends[of] - units[of])
                with np.errstate(over="ignore"):
                    seed = mix64(element[of] + (nth.astype(np.uint64) + np.uint64(1)) * GOLD)
                throw(signature, seed, np.minimum(1.0, weight[of] - nth), place[of], theta)
        todo = todo[(signature[todo] == np.iinfo(np.uint64).max).any(axis=1)]
        darts *= 2
    return numbers, signature


def throw(signature: np.ndarray, seed: np.ndarray, width: np.ndarray, owner: np.ndarray, theta: np.ndarray) -> None:
    """Throw the darts of some strips, each up to its owner's rank ``theta``; coordinates keep their earliest."""
    k = np.uint64(signature.shape[1])
    alive, rank, turn = np.arange(len(seed)), np.zeros(len(seed)), 0
    while len(alive):
        with np.errstate(over="ignore"):
            gap = mix64(seed[alive] + np.uint64(2 * turn + 1) * np.uint64(0xD1B54A32D192ED03))
            dart = mix64(seed[alive] + np.uint64(2 * turn + 2) * np.uint64(0x8CB92BA72F3D8DD7))
        rank = rank - np.log(unit(gap))
        near = rank <= theta[owner[alive]]
        alive, rank, dart = alive[near], rank[near], dart[near]
        hit = np.ones(len(alive), bool) if (width[alive] >= 1).all() else unit(mix64(dart ^ GOLD)) <= width[alive]
        packed = (rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart[hit] >> np.uint64(32))
        np.minimum.at(signature, (owner[alive[hit]], (dart[hit] % k).astype(np.int64)), packed)
        turn += 1


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    bands = signature.reshape(len(signature), -1, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(mix64(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * GOLD), bands.shape[:2]).copy()
        for j in range(rows):
            key = mix64(key * np.uint64(0x100000001B3) + bands[:, :, j])
    return key


def shingle_keys(texts: list[str]) -> list[np.ndarray]:
    """The shingles of each text as sorted 64-bit keys; the n-th copy of a shingle is a key of its own, so
    that weighted sets become plain ones of the same similarity."""
    doc, h, count = weighted_set(texts)
    units = count.astype(np.int64)
    nth = np.arange(units.sum()) - np.repeat(np.cumsum(units) - units, units)
    doc, key = np.repeat(doc, units), np.repeat(h, units)
    with np.errstate(over="ignore"):
        key = np.where(nth > 0, mix64(key + nth.astype(np.uint64) * GOLD), key)
    key = key[np.lexsort((key, doc))]
    return np.split(key, np.searchsorted(doc, np.arange(1, len(texts))))


def similarities(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact similarity of pairs of :func:`shingle_keys`, many at once."""
    n = len(left)
    sizes = np.array([len(x) for x in (*left, *right)], dtype=np.int64)
    pair, key = np.repeat(np.tile(np.arange(n), 2), sizes), np.concatenate([*left, *right, np.zeros(0, np.uint64)])
    order = np.lexsort((key, pair))
    pair, key = pair[order], key[order]
    both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (key[1:] == key[:-1])], minlength=n)
    total = sizes[:n] + sizes[n:]
    return np.divide(both, total - both, out=np.zeros(n), where=total > both)


def similarity(a: str, b: str) -> float:
    """Exact weighted Jaccard similarity of two texts' shingles."""
    left, right = shingle_keys([a or "", b or ""])
    return float(similarities([left], [right])[0])


def marks_of(signature: np.ndarray) -> np.ndarray:
    """16 bits a coordinate, all that buckets and estimates are made from."""
    return (mix64(signature) & np.uint64(0xFFFF)).astype("<u2")


def sketch(docs: DataFrame, k: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """doc_id, same (digest of the word sequence), bands (keys) and marks (16 bits a coordinate) of every row."""

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for start, part in slices(texts):
                words, doc = word_hashes(part)
                first = np.searchsorted(doc, np.arange(len(part) + 1))
                bands, marks = [None] * len(part), [None] * len(part)
                numbers, signature = dart_minhash(*weighted_set(part), k)
                short = marks_of(signature)
                for number, keys, own in zip(numbers, band_keys(short.astype(np.uint64), rows).view(np.int64), short, strict=True):
                    bands[number], marks[number] = keys, own.tobytes()
                same = [hashlib.blake2b(words[a:b].tobytes() if b > a else b"text:" + t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                        for a, b, t in zip(first, first[1:], part, strict=False)]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:start + len(part)].to_numpy(), "same": same, "bands": bands, "marks": marks})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInPandas(run, "doc_id long, same binary, bands array<long>, marks binary")


def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of coordinates on which two signatures agree."""
    if not len(a):
        return pd.Series([], dtype=float)
    left, right = (np.frombuffer(b"".join(x), dtype="<u2").reshape(len(x), -1) for x in (a, b))
    return pd.Series((left == right).mean(axis=1))


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough to be verified."""
    share = F.pandas_udf(agreement, "double")
    both = pairs.join(marks.select(F.col("doc_id").alias("b"), F.col("marks").alias("b_marks")), "b").join(marks.select(F.col("doc_id").alias("a"), F.col("marks").alias("a_marks")), "a")
    return both.where(share("a_marks", "b_marks") >= LEAST_AGREEMENT).select("a", "b")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, keys) of the documents in ``wanted`` (and a few more that its filter lets pass)."""
    passing = docs.sparkSession.sparkContext.broadcast(build_filter(wanted))

    def run(batches):
        for batch in batches:
            batch = batch[passing.value.test(batch["doc_id"].to_numpy(dtype=np.int64).view(np.uint64))]
            for start, part in slices(list(batch["text"])):
                keys = shingle_keys(part)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[start:start + len(part)].to_numpy(), "n": [len(x) for x in keys], "keys": [x.tobytes() for x in keys]})

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = save(some.where("doc_id is not null").mapInPandas(run, "doc_id long, n long, keys binary"), "near-sets")
    passing.destroy()
    return out


def verify(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts reach the similarity."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("b_keys")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("a_keys")), "a").select("a", "b", "a_keys", "b_keys")

    def run(batches):
        for batch in batches:
            ids = batch[["a", "b"]].to_numpy()
            a, b = ([np.frombuffer(x, dtype=np.uint64) for x in batch[c]] for c in ("a_keys", "b_keys"))
            turn = np.cumsum([len(x) + len(y) for x, y in zip(a, b, strict=True)]) // TILE_KEYS
            ok = [similarities([a[i] for i in at], [b[i] for i in at]) >= least for t in np.unique(turn) for at in [np.flatnonzero(turn == t)]]
            got = ids[np.concatenate([np.zeros(0, bool), *ok])] if len(ids) else ids
            yield pd.DataFrame({"a": got[:, 0], "b": got[:, 1]}).astype("int64")

    return both.mapInPandas(run, "a long, b long")


class Tile:
    """Members of one bucket, side by side: those that ask and those that are asked."""

    def __init__(self, ids, classes, other, marks, keys, rows: int):
        self.ids, self.other, self.marks = ids, other, marks
        self.label = np.unique(classes, return_inverse=True)[1]
        self.bands = band_keys(marks.astype(np.uint64), rows)
        self.size = np.array([len(x) for x in keys], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.code = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)[1].astype(np.int32)
        self.flag = np.zeros(int(self.code.max(initial=0)) + 1, dtype=bool)

    def candidates(self, asks: np.ndarray, asked: np.ndarray, band: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of different classes that first meet in this band and agree in ``least`` coordinates, likeliest first."""
        meet = self.label[asks][:, None] != self.label[asked][None, :]
        # Two members that both differ from their bucket's first class meet once, the smaller asks.
        meet &= ~self.other[asked][None, :] | (self.ids[asks][:, None] < self.ids[asked][None, :])
        for earlier in range(band):
            meet &= self.bands[asks, earlier][:, None] != self.bands[asked, earlier][None, :]
        q, m = (side[at] for side, at in zip((asks, asked), np.nonzero(meet), strict=True))
        agree = np.concatenate([np.zeros(0, np.int64), *((self.marks[q[i:i + 65_536]] == self.marks[m[i:i + 65_536]]).sum(axis=1) for i in range(0, len(q), 65_536))])
        order = np.flatnonzero(agree >= least)
        order = order[np.lexsort((m[order], q[order], -agree[order]))]
        return q[order], m[order]

    def similar(self, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Exact similarities of pairs of members."""
        out = np.zeros(len(q))
        order = np.argsort(q, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(q[order])) + 1):
            own, there = q[at[0]], m[at]
            mine = self.code[self.start[own]:self.start[own] + self.size[own]]
            self.flag[mine] = True
            size = self.size[there]
            begin = np.cumsum(size) - size
            place = np.arange(size.sum()) + np.repeat(self.start[there] - begin, size)
            both = np.add.reduceat(self.flag[self.code[place]].astype(np.int64), begin)
            self.flag[mine] = False
            out[at] = both / (self.size[own] + size - both)
        return out

    def links(self, asks: np.ndarray, asked: np.ndarray, band: int, least_marks: int, least: float) -> list[tuple[int, int]]:
        """Verified links that join two classes, at most members - 1 of them."""
        out = []
        for start in range(0, len(asks), 128):
            q, m = self.candidates(asks[start:start + 128], asked, band, least_marks)
            most = VERIFY_AT_ONCE
            while len(q):
                open_ = self.label[q] != self.label[m]
                q, m = q[open_], m[open_]
                now_q, now_m, q, m = q[:most], m[:most], q[most:], m[most:]
                if len(now_q):
                    ok = self.similar(now_q, now_m) >= least
                    for x, y in zip(now_q[ok], now_m[ok], strict=True):
                        if self.label[x] != self.label[y]:
                            self.label[self.label == self.label[y]] = self.label[x]
                            out.append((min(self.ids[x], self.ids[y]), max(self.ids[x], self.ids[y])))
                most *= 4
        return out


def tiles(mixed: DataFrame, most: int) -> DataFrame:
    """Members of mixed buckets dealt into tiles: bucket, band, line, column, asks, asked, doc_id, class_id, other.

    A bucket that fits into one tile travels once; the members of a larger one travel once for each line or column of tiles.
    """
    side = lambda n, keys: F.greatest(F.ceil(n / TILE_ROWS), F.ceil(keys / TILE_KEYS)).cast("int")
    sizes = mixed.groupBy("bucket").agg(F.sum(F.col("other").cast("long")).alias("q"), F.sum(F.when(F.col("other"), F.col("n")).otherwise(0)).alias("q_keys"), F.count("*").alias("m"), F.sum("n").alias("m_keys"))
    sizes = save(sizes.select("bucket", side(F.col("q"), F.col("q_keys")).alias("lines"), side(F.col("m"), F.col("m_keys")).alias("columns")), "near-sizes", most)
    number = lambda size: F.pmod(F.xxhash64("doc_id"), F.col(size)).cast("int")
    spread = lambda size: F.explode(F.sequence(F.lit(0), F.col(size) - 1))
    sized = mixed.join(sizes, "bucket")
    one = (F.col("lines") == 1) & (F.col("columns") == 1)
    own = ["doc_id", "class_id", "other"]
    small = sized.where(one).select("bucket", "band", F.lit(0).alias("line"), F.lit(0).alias("column"), F.col("other").alias("asks"), F.lit(True).alias("asked"), *own)
    asking = sized.where(~one & F.col("other")).select("bucket", "band", number("lines").alias("line"), spread("columns").alias("column"), F.lit(True).alias("asks"), F.lit(False).alias("asked"), *own)
    asked = sized.where(~one).select("bucket", "band", spread("lines").alias("line"), number("columns").alias("column"), F.lit(False).alias("asks"), F.lit(True).alias("asked"), *own)
    return small.union(asking).union(asked)


def tile_links(dealt: DataFrame, marks: DataFrame, sets: DataFrame, least: float, k: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """The forest links (a, b) of all tiles."""
    key, least_marks = ["bucket", "line", "column"], int(np.ceil(LEAST_AGREEMENT * k))
    full = dealt.join(marks, "doc_id").join(sets.select("doc_id", "keys"), "doc_id")

    def found(part: pd.DataFrame) -> list[tuple[int, int]]:
        asks, asked = (part[c].to_numpy(dtype=bool) for c in ("asks", "asked"))
        if not asks.any() or not asked.any():
            return []
        own = np.frombuffer(b"".join(part["marks"]), dtype="<u2").reshape(len(part), -1)
        tile = Tile(part["doc_id"].to_numpy(), part["class_id"].to_numpy(), part["other"].to_numpy(dtype=bool), own, [np.frombuffer(x, dtype=np.uint64) for x in part["keys"]], rows)
        return tile.links(np.flatnonzero(asks), np.flatnonzero(asked), int(part["band"].iloc[0]), least_marks, least)

    def run(batches):
        rest = []
        for batch in batches:
            if not len(batch):
                continue
            at = batch[key].to_numpy()
            ends = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1), len(batch)]
            for a, b in zip(ends, ends[1:], strict=False):
                if rest and tuple(rest[-1][key].iloc[0]) != tuple(at[a]):
                    yield frame(found(pd.concat(rest, ignore_index=True)))
                    rest = []
                rest.append(batch.iloc[a:b])
        if rest:
            yield frame(found(pd.concat(rest, ignore_index=True)))

    def frame(links):
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return full.repartition(*key).sortWithinPartitions(*key).mapInPandas(run, "a long, b long")


def near_links(reps: DataFrame, docs: DataFrame, least: float = SIMILARITY, k: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """Verified links (a, b) between the representatives (doc_id, bands, marks) that hold all their classes together."""
    marks = reps.where("bands is not null").select("doc_id", "marks")
    most = reps.count() * (k // rows)  # rows of all buckets
    buckets = reps.select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    crowded = save(buckets.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1").select("bucket", "a"), "near-buckets", most)
    members = save(buckets.join(crowded, "bucket"), "near-members", most)
    sets = shingle_sets(docs, save(members.select("doc_id").distinct(), "near-ids", most))
    spokes = members.where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    pairs = save(likely(spokes, marks).repartition(file_count(most)), "near-likely")  # not coalesced, see packed
    stars = save(verify(pairs, sets, least), "near-stars")
    classes = save(components(stars), "near-so-far", most).withColumnRenamed("id", "doc_id")
    known = members.join(classes, "doc_id", "left").select("bucket", "band", "doc_id", "a", F.coalesce("class_id", "doc_id").alias("class_id"))
    first = save(known.where("doc_id = a").select("bucket", F.col("class_id").alias("first_class")).distinct(), "near-first", most)
    other = save(known.join(first, "bucket").select("bucket", "band", "doc_id", "class_id", (F.col("class_id") != F.col("first_class")).alias("other")), "near-known", most)
    kinds = save(other.where("other").select("bucket").distinct(), "near-mixed", most)
    if not kinds.limit(1).count():
        return stars
    mixed = save(other.join(kinds, "bucket").join(sets.select("doc_id", "n"), "doc_id"), "near-mixed-members", most)
    dealt = save(tiles(mixed, most), "near-tiles")
    return stars.union(save(tile_links(dealt, marks, sets, least, k, rows), "near-forests"))


def near_classes(docs: DataFrame, least: float = SIMILARITY, k: int = COORDINATES, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), kept."""
    sketches = save(sketch(docs, k, rows), "near-sketch")
    owned = sketches.groupBy("same").agg(F.min(F.struct("doc_id", "bands", "marks")).alias("r"))
    reps = save(owned.select("same", "r.*"), "near-reps")
    links = near_links(reps, docs, least, k, rows)
    # Different texts of one doc_id: their representatives are linked, as the rows share a class.
    if sketches.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rep = reps.select("same", F.col("doc_id").alias("b"))
        links = links.union(sketches.join(rep, "same").groupBy("doc_id").agg(F.min("b").alias("a"), F.collect_set("b").alias("b")).select("a", F.explode("b").alias("b")))
    found = save(components(links), "near-classes")
    named = save(reps.select("same", F.col("doc_id").alias("id")).join(found, "id", "left").select("same", F.coalesce("class_id", "id").alias("class_id")), "near-named")
    known = sketches.select("doc_id", "same").join(named, "same").select("doc_id", "class_id")
    nameless = docs.where("doc_id is null").select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("class_id"))
    return known.union(nameless).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one_each(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns, of any names; rows without doc_id stay.

    Where ids repeat, documents are told apart by doc_id and text, numbered in this order; of rows that repeat both the one with the smallest hash stays.
    """
    text = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    # A row travels as one struct beside its keys, so that no column's name can clash.
    rows = docs.where("doc_id is not null").select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("sha"))
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        gone = near_classes(docs).where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone"))
        one = rows.join(gone, rows["id"] == gone["gone"], "left_anti")
    else:
        numbers = save(number_rows(rows.select("id", "sha").distinct(), ["id", "sha"], name="no"), "near-numbers")
        rows = save(rows.join(numbers, ["id", "sha"]), "near-numbered")
        gone = near_classes(rows.select(F.col("no").alias("doc_id"), F.col("row")["text"].alias("text"))).where("not kept").select(F.col("doc_id").alias("gone")).distinct()
        left = rows.join(gone, rows["no"] == gone["gone"], "left_anti")
        tie = F.xxhash64(*[F.col("row")[name] for name, kind in docs.dtypes if "map<" not in kind])
        one = left.groupBy("no").agg(F.min_by("row", tie).alias("row"))
    return one.select("row.*").union(docs.where("doc_id is null"))
