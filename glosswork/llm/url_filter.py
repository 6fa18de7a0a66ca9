"""URL filters by a Bloom filter cascade.

The keys are rules: a host followed by a path prefix (``net/``, ``example.net/en/``).
A URL can only meet a rule through one of its own candidate keys: each suffix of its
host at a dot, followed by each prefix of its path that has the length of some rule's
path.  All candidates of the corpus form the complete key universe.  Level 1 of a
cascade holds the listed keys, level 2 the universe keys that level 1 wrongly accepts,
level 3 the listed keys that level 2 wrongly accepts, and so on until nothing is
wrongly accepted; the parity of the level at which a key is first refused then is its
exact membership.  Judging a URL needs no join: the cascade is a few bit arrays whose
size follows the rule list (level 1 takes about log2(universe / rules) bits a rule), never the corpus; the list and the keys that
level 1 wrongly accepts, about as many, are all that the driver holds.

Defined results: null URLs and URLs without ``://`` have empty host and path, meet no
rule and get the default verdict.  Of several rules that fit, the longest (host plus
path) wins; between equally long ones the longer host, then ``block``.  A rule listed
twice counts once, as ``block`` if either says so.  Repeated rows give repeated
results, an empty table an empty result; a very long url is judged whole; a rule whose path does not start with ``/`` fits no url with a path;
further columns of any name are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mix64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (verdict, host, path) of the rules that the registered query applies.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys by which a URL could meet a rule whose path has one of ``lengths``."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]),
        lambda p: p.isNotNull(),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def key_hash(key: Column, which: int) -> Column:
    return F.xxhash64(key, F.lit(which))


class Cascade:
    """Bloom filters that alternate between listed keys and wrongly accepted ones.

    Keys are pairs of 64-bit hashes, so that two keys would have to agree in 128 bits to be confused.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []
        self.bits: list[int] = []
        self.hashes: list[int] = []

    @staticmethod
    def positions(a: np.ndarray, b: np.ndarray, level: int, hashes: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
            x, y = mix64(a ^ salt), mix64(b + salt) | np.uint64(1)
            return (x[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * y[:, None]) % np.uint64(bits)

    def add_level(self, a: np.ndarray, b: np.ndarray, rate: float) -> None:
        hashes = max(1, round(-np.log2(rate)))
        bits = max(64, int(np.ceil(1.4427 * hashes * max(1, len(a)))))
        level = np.zeros(-(-bits // 8), dtype=np.uint8)
        at = np.unique(self.positions(a, b, len(self.levels), hashes, bits).ravel())
        np.bitwise_or.at(level, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        self.levels.append(level)
        self.bits.append(bits)
        self.hashes.append(hashes)

    def accepted(self, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        at = self.positions(a, b, level, self.hashes[level], self.bits[level])
        return ((self.levels[level][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1)).all(axis=1)

    def depth(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many levels in a row accept each key."""
        out, open_ = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        for level in range(len(self.levels)):
            open_ = open_[self.accepted(a[open_], b[open_], level)]
            out[open_] += 1
        return out

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact for every key of the universe and for every listed key."""
        return self.depth(a, b) % 2 == 1


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """A cascade for ``listed`` keys over the keys of ``universe``; both have one string column, key.

    The driver holds hashes of the listed keys and of the keys that a level wrongly
    accepts: by the rate chosen for level 1 these are about as many as the listed ones.
    """
    spark = universe.sparkSession
    hashed = universe.select(key_hash(F.col("key"), 0).alias("a"), key_hash(F.col("key"), 1).alias("b"))

    def collected(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = df.toPandas()
        return tuple(got[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("a", "b"))

    listed_a, listed_b = collected(listed.select(key_hash(F.col("key"), 0).alias("a"), key_hash(F.col("key"), 1).alias("b")).distinct())
    cascade = Cascade()
    if not len(listed_a):
        return cascade
    size = universe.agg(F.approx_count_distinct("key")).first()[0] or 1
    first_rate = min(0.5, max(1e-9, len(listed_a) / (1.4142 * size)))
    cascade.add_level(listed_a, listed_b, first_rate)
    shipped = spark.sparkContext.broadcast((cascade, listed_a, listed_b))

    def wrong(batches):
        filters, own_a, own_b = shipped.value
        own = set(zip(own_a.tolist(), own_b.tolist(), strict=True))
        for batch in batches:
            a, b = (batch[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("a", "b"))
            hit = filters.accepted(a, b, 0)
            pairs = {p for p in zip(a[hit].tolist(), b[hit].tolist(), strict=True)} - own
            if pairs:
                got = np.array(sorted(pairs), dtype=np.uint64).view(np.int64)
                yield pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    other_a, other_b = collected(hashed.mapInPandas(wrong, "a long, b long").distinct())
    shipped.destroy()
    inside, outside = (listed_a, listed_b), (other_a, other_b)
    while len(outside[0]):
        if len(cascade.levels) > 64:
            raise ValueError("two keys agree in 128 bits; no cascade can separate them")
        level = len(cascade.levels)
        cascade.add_level(*outside, 0.5)
        kept = cascade.accepted(*inside, level)
        inside, outside = outside, (inside[0][kept], inside[1][kept])
    return cascade


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, default: str = "allow",
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL; returns id, host, path, rule (or null) and verdict, see the module's text."""
    rules = RULES if rules is None else rules
    spark = pages.sparkSession
    blocked = {host + path for verdict, host, path in rules if verdict == "block"}
    allowed = {host + path for verdict, host, path in rules if verdict != "block"} - blocked
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    parts = pages.select(F.col(id_col), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("key"))
    listed = lambda keys: spark.createDataFrame([(k,) for k in sorted(keys)], "key string")
    cascades = spark.sparkContext.broadcast((build_cascade(universe, listed(blocked)), build_cascade(universe, listed(allowed))))

    def judge(a: pd.Series, b: pd.Series) -> pd.Series:
        sizes = a.map(len).to_numpy()
        flat = [np.concatenate([np.asarray(x, dtype=np.int64) for x in c] or [np.zeros(0, np.int64)]).view(np.uint64) for c in (a, b)]
        block, allow = cascades.value
        found = np.where(block.contains(*flat), 2, np.where(allow.contains(*flat), 1, 0)).astype(np.int32)
        return pd.Series(np.split(found, np.cumsum(sizes)[:-1])) if len(sizes) else pd.Series([], dtype=object)

    member = F.pandas_udf(judge, "array<int>")
    judged = keyed.withColumn("found", member(F.transform("keys", lambda k: key_hash(k, 0)), F.transform("keys", lambda k: key_hash(k, 1))))
    # A host holds no "/", so a key's path begins at its first.
    hits = F.filter(F.arrays_zip("keys", "found"), lambda x: x["found"] > 0)
    order = lambda x: F.struct(
        F.length(x["keys"]).alias("n"),
        F.length(F.substring_index(x["keys"], "/", 1)).alias("h"),
        x["found"].alias("found"), x["keys"].alias("key"))
    best = F.array_max(F.transform(hits, order))
    return judged.withColumn("best", best).select(
        id_col, "host", "path", F.col("best.key").alias("rule"),
        F.when(F.col("best.found") == 2, "block").when(F.col("best.found") == 1, "allow").otherwise(default).alias("verdict"))
