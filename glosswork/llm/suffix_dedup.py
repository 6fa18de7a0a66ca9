"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id.

Spark deals the corpus's strings out so that equal ones meet, tasks sort them as suffixes, and what they find goes back to the documents:

1. The key of a string is the least hash of its ``GRAM``-byte parts.  Strings that follow one another mostly share a key; such a
   row of strings is one *piece* of text, cut out once.  Keys are counted by documents; only pieces whose key stands in several
   documents go on.  Up to ``FILTER_KEYS`` counted keys are a broadcast filter (what passes it without need costs time and changes
   nothing); more of them meet the pieces' places in a shuffle join.
2. Equal pieces are aggregated before they travel, whatever number of documents hold them, with the smallest doc_id.
3. Distinct pieces meet by key, in blocks of some MB, each a text of its own.  Its suffix array is made by **two-stage sorting**: only
   suffixes smaller than their successors are sorted directly (to ``LENGTH`` bytes); a scan over the buckets of first bytes, smallest first, induces
   all others from the suffix behind them.  Then the common prefixes of neighbours are computed; neighbours that share ``LENGTH`` bytes are one
   string, and the smallest doc_id of its pieces decides.
4. A piece's verdict is the smallest doc_id and, for that document itself, a bit for each string that stands in a still smaller one.
   It is joined back to the piece's places, and each document's covered bytes are cut.

A key with more than ``MOST_PIECES`` distinct pieces (a very frequent phrase in ever new surroundings) is not brought into one
task: its strings are aggregated one by one, each by itself.  The joins back to places have plain tables on both sides, so that
adaptive execution splits a hot piece.

Defined results: null text is empty; a null doc_id is larger than any other; documents of one doc_id do not count against each other; rows that
repeat doc_id and text get the same result each; matches never cross documents; a text shorter than ``LENGTH`` loses nothing; a very long text is
cut in stretches of ``STRETCH`` bytes that overlap, with equal results; an empty table gives an empty result; only doc_id and text
are read, further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import build_filter, drop_saved, id_or_last, mix64, null_again, save, small

LENGTH = 50
MAX_RUN = 62  # strings of a piece; their verdicts are bits of a long
STRETCH, BLOCK_BYTES = 1 << 20, 2 << 20
FILTER_KEYS = 1 << 23  # at 8 bits a key and more
MOST_PIECES = 4_000
ROLL = 0x9E3779B97F4A7C15


def gram(length: int) -> int:
    """Bytes of the parts whose hashes make the key."""
    return max(1, length * 2 // 5)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the ``k`` bytes from each place on, from hashes of 1, 2, 4, ... bytes."""
    n, held, done, size = len(data), None, 0, 1
    power = data.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if k & size:
                count = n - (done + size) + 1
                held = power[done:] if held is None else held[:count] * np.uint64(pow(ROLL, size, 1 << 64)) + power[done:done + count]
                done += size
            if 2 * size > k:
                return mix64(held)
            count = n - 2 * size + 1
            power = power[:count] * np.uint64(pow(ROLL, size, 1 << 64)) + power[size:size + count]
            size *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours."""
    size, out = 1, x
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(x) - width + 1
    return np.minimum(out[:n], out[width - size:width - size + n]) if size < width else out[:n]


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """Pieces of the documents that lie at ``offsets`` of ``data``, by stretches: (first string, number of strings, key) as arrays."""
    k = gram(length)
    total = int(offsets[-1])
    for a in range(int(offsets[0]), total - length + 1, STRETCH):
        b = min(total, a + STRETCH + length - 1)  # the strings that start in this stretch
        key = sliding_min(gram_hashes(data[a:b], k), length - k + 1)
        inside = np.zeros(len(key) + 1, dtype=np.int32)
        own = slice(max(0, int(np.searchsorted(offsets, a, "right")) - 1), int(np.searchsorted(offsets, b, "left")))
        first, last = np.clip(offsets[:-1][own] - a, 0, len(key)), np.clip(offsets[1:][own] - a - length + 1, 0, len(key))
        whole = last > first
        np.add.at(inside, first[whole], 1)
        np.add.at(inside, last[whole], -1)
        valid = np.cumsum(inside[:-1]) > 0
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (key[1:] != key[:-1])
        ends = valid.copy()
        ends[:-1] &= ~valid[1:] | fresh[1:]
        start, stop = np.flatnonzero(fresh), np.flatnonzero(ends) + 1
        if len(start) and (stop - start).max() > MAX_RUN:  # one key over many strings, as of a run of one byte
            parts = -(-(stop - start) // MAX_RUN)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, stop = np.repeat(start, parts) + nth * MAX_RUN, np.repeat(stop, parts)
            stop = np.minimum(stop, start + MAX_RUN)
        if len(start):
            yield start + a, stop - start, key[start]


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without nulls, not copied."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, held = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8), offsets


def elements(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of a column of lists of structs (null: empty) the row of each element, and the elements' fields."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return np.repeat(np.arange(len(column)), sizes), [field.to_numpy() for field in column.flatten().flatten()]


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The parts of ``data`` as one binary column."""
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append([0], ends).astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes())])


# The suffix array of one block.
def depths(length: int) -> list[int]:
    """Where to read words of 8 bytes, so that together they are ``length`` bytes."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as a number that sorts like them; zeros behind the end."""
    raw = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data),), dtype=">u8", buffer=raw.tobytes(), strides=(1,)).astype(np.uint64)


def sort_directly(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """``places`` in the order of their first ``length`` bytes; each further word is looked at only within ties."""
    at = [words[np.minimum(places, len(words) - 1)]]
    order = np.argsort(at[0], kind="stable")
    places = places[order]
    tied = np.append(False, np.diff(at[0][order]) == 0)
    for depth in depths(length)[1:]:
        if not tied.any():
            break
        active = np.flatnonzero(tied | np.append(tied[1:], False))
        group, key = np.cumsum(~tied[active]), words[np.minimum(places[active] + depth, len(words) - 1)]
        order = np.lexsort((key, group))
        places[active] = places[active][order]
        key = key[order]
        tied[active] &= np.append(False, key[1:] == key[:-1])
    return places


def suffix_order(codes: np.ndarray, words: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """The wanted places of ``codes`` (bytes + 1, a 0 behind each piece) by their suffixes, exact to ``length`` bytes within a piece.

    ``wanted`` is marked on: a suffix larger than its successor is induced from it, so all successors up to a smaller one are made too.
    """
    n = len(codes)
    last_equal = np.where(np.append(codes[1:] != codes[:-1], True), np.arange(n), n)
    change = np.minimum.accumulate(last_equal[::-1])[::-1]  # where the run of equal bytes ends
    ahead = np.append(codes, 0)[np.minimum(change + 1, n)]
    rises = (codes < ahead) & (codes > 0)  # smaller than its successor
    stops = np.where(rises | (codes == 0), np.arange(n), n - 1)
    stop = np.minimum.accumulate(stops[::-1])[::-1]
    made = np.cumsum(wanted - np.bincount(stop[wanted] + 1, minlength=n + 1)[:n]) > 0
    direct = sort_directly(np.flatnonzero(made & rises), words, length)
    induced = made & ~rises & (codes > 0)
    bounds = np.searchsorted(codes[direct], np.arange(258))
    waiting: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []

    def induce(placed: np.ndarray, own: int) -> np.ndarray:
        """What stands before ``placed`` waits in the bucket of its byte, in this order; of bucket ``own`` it is returned."""
        before = placed - 1
        before = before[(before >= 0) & induced[before]]
        byte = codes[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        cut = np.flatnonzero(np.diff(byte)) + 1
        same = before[:0]
        for group in np.split(before, cut) if len(before) else []:
            at = int(codes[group[0]])
            if at == own:
                same = group
            else:
                waiting[at].append(group)
        return same

    induce(np.flatnonzero(made & (codes == 0)), 0)
    for byte in range(1, 257):
        now = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        while len(now):
            out.append(now)
            now = induce(now, byte)
        smaller = direct[bounds[byte]:bounds[byte + 1]]
        if len(smaller):
            out.append(smaller)
            induce(smaller, byte)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def common_prefixes(order: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """How many of their first ``length`` bytes each place of ``order`` shares with the one before it; 0 for the first."""
    shared = np.zeros(len(order), dtype=np.int64)
    open_ = np.arange(1, len(order))
    edges = np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)
    for depth in depths(length):
        if not len(open_):
            break
        last = len(words) - 1
        x = words[np.minimum(order[open_] + depth, last)] ^ words[np.minimum(order[open_ - 1] + depth, last)]
        shared[open_] = depth + 8 - np.searchsorted(edges, x, "right")
        open_ = open_[x == 0]
    return shared


def judge_block(texts: list[bytes], least: np.ndarray, length: int) -> np.ndarray:
    """For each piece the bits of its strings that stand in a document smaller than ``least``, the smallest of its own."""
    size = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    start = np.cumsum(size + 1) - size - 1
    codes = data.astype(np.int16) + 1
    codes[start + size] = 0
    words = words_at(data)
    owner_of = np.repeat(np.arange(len(texts)), size + 1)
    strings = np.arange(len(data)) <= (start + size - length)[owner_of]
    order = suffix_order(codes, words, strings, length)
    order = order[strings[order]]
    fresh = common_prefixes(order, words, length) < length
    groups = np.flatnonzero(fresh)
    piece = owner_of[order]
    least_of = np.repeat(np.minimum.reduceat(least[piece], groups), np.diff(np.append(groups, len(order))))
    gone = np.sort(order[least_of < least[piece]])
    bits = np.zeros(len(texts), dtype=np.int64)
    if len(gone):
        owner = owner_of[gone]
        head = np.flatnonzero(np.diff(owner, prepend=-1))
        bits[owner[head]] = np.bitwise_or.reduceat(np.int64(1) << (gone - start[owner]), head)
    return bits


def text_of(docs: DataFrame) -> DataFrame:
    """doc_id (null as the largest), hash (tells texts of one doc_id apart) and text of every row."""
    rows = docs.select(id_or_last(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("hash"), "text")


def names(piece: Column) -> list[Column]:
    """128 bits that stand for a piece where its text need not travel."""
    return [F.xxhash64(piece).alias("f1"), F.xxhash64(F.lit(1), piece).alias("f2")]


def shared_keys(texts: DataFrame, length: int) -> DataFrame:
    """Keys that may stand in several documents: in two of one stretch, or in two stretches."""
    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = binary_column(batch.column(1))
            for start, _, key in pieces(data, offsets, length):
                doc = ids[np.searchsorted(offsets, start, "right") - 1]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                tail = np.append(head[1:], len(key)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(key[head].view(np.int64)), pa.array(np.where(doc[head] == doc[tail], 1, 2).astype(np.int64))], names=["key", "n"])

    found = texts.where(F.octet_length("text") >= length).select("doc_id", "text").mapInArrow(count, "key long, n long")
    return save(found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "suffix-keys")


CUT = "doc_id long, hash long, at long, strings int, key long"


def cut_pieces(texts: DataFrame, length: int) -> DataFrame:
    """Every place of a piece whose key may stand in several documents: doc_id, hash, at, strings, key, piece."""
    keys = shared_keys(texts, length)
    texts = texts.where(F.octet_length("text") >= length)
    if keys.count() > FILTER_KEYS:
        cuts = save(cut_joined(texts, keys, length), "suffix-cuts", codec="zstd")
    else:
        shared = texts.sparkSession.sparkContext.broadcast(build_filter(keys, 8 * FILTER_KEYS))

        def cut(batches):
            for ids, hashes, data, doc, at, start, strings, key in placed(batches, length):
                hit = shared.value.test(key)
                for a in range(0, int(hit.sum()), 20_000):
                    own = np.flatnonzero(hit)[a:a + 20_000]
                    columns = [ids[doc[own]], hashes[doc[own]], at[own], strings[own].astype(np.int32), key[own].view(np.int64)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), slices(data, start[own], strings[own] + length - 1)], names=["doc_id", "hash", "at", "strings", "key", "piece"])

        cuts = save(texts.mapInArrow(cut, f"{CUT}, piece binary"), "suffix-cuts", codec="zstd")
        shared.destroy()
    drop_saved(keys)
    return cuts


def placed(batches, length: int):
    """By stretches of batches (doc_id, hash, text): ids, hashes, bytes, and of the pieces row, place in the document and in the bytes, strings, key."""
    for batch in batches:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data, offsets = binary_column(batch.column(2))
        for start, strings, key in pieces(data, offsets, length):
            doc = np.searchsorted(offsets, start, "right") - 1
            yield ids, hashes, data, doc, start - offsets[doc], start, strings, key


def cut_joined(texts: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """The pieces with one of ``keys``, by a join of their places, of which then those of a document are cut from its text."""
    def places(batches):
        for ids, hashes, _, doc, at, _, strings, key in placed(batches, length):
            yield pa.RecordBatch.from_arrays([*map(pa.array, (ids[doc], hashes[doc], at, strings.astype(np.int32), key.view(np.int64)))], names=["doc_id", "hash", "at", "strings", "key"])

    def cut(batches):
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = binary_column(batch.column(2))
            doc, (at, strings, key) = elements(batch.column(3))
            for a in range(0, len(doc), 20_000):
                own = slice(a, a + 20_000)
                columns = [ids[doc[own]], hashes[doc[own]], at[own], strings[own], key[own]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), slices(data, offsets[doc[own]] + at[own], strings[own] + length - 1)], names=["doc_id", "hash", "at", "strings", "key", "piece"])

    found = texts.mapInArrow(places, CUT).join(keys, "key", "left_semi")
    found = save(found.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("at", "strings", "key")).alias("own")), "suffix-places")
    return texts.join(found, ["doc_id", "hash"]).select("doc_id", "hash", "text", "own").mapInArrow(cut, f"{CUT}, piece binary")


def judge(distinct: DataFrame, length: int) -> DataFrame:
    """(f1, f2, low, bits) of the pieces (key, piece, low, high) that take bytes from any document."""
    def blocks(batches):
        held, size = [], 0

        def flush(rows):
            if len(rows):
                least = rows["low"].to_numpy(dtype=np.int64)
                rows = rows.assign(bits=judge_block(rows["piece"].tolist(), least, length))
                yield rows.loc[(rows["bits"] != 0) | (rows["high"] > rows["low"]), ["f1", "f2", "low", "bits"]]

        for batch in batches:
            held.append(batch)
            size += sum(map(len, batch["piece"]))
            if size > BLOCK_BYTES:  # a block ends where a key does
                rows = pd.concat(held, ignore_index=True)
                done = int(np.searchsorted(rows["key"].to_numpy(), rows["key"].iloc[-1]))
                yield from flush(rows.iloc[:done].reset_index(drop=True))
                held = [rows.iloc[done:].reset_index(drop=True)]
                size = sum(map(len, held[0]["piece"]))
        if held:
            yield from flush(pd.concat(held, ignore_index=True))

    rows = distinct.repartition("key").sortWithinPartitions("key")
    return rows.mapInPandas(blocks, "f1 long, f2 long, low long, bits long")


def judge_alone(distinct: DataFrame, length: int) -> DataFrame:
    """As :func:`judge` for keys with very many pieces: each string by itself, equal ones aggregated before they meet."""
    at = F.sequence(F.lit(0), F.octet_length("piece") - length)
    strings = distinct.select("f1", "f2", "low", "high", F.explode(at).alias("at"), "piece").select(
        "f1", "f2", "low", "high", "at", F.expr(f"substring(piece, at + 1, {length})").alias("string"))
    strings = save(strings, "suffix-strings")
    least = save(strings.groupBy("string").agg(F.min("low").alias("least")), "suffix-least")
    gone = F.when(F.col("least") < F.col("low"), F.expr("shiftleft(1L, at)")).otherwise(F.lit(0).cast("long"))
    judged = strings.join(least, "string").groupBy("f1", "f2").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or(gone).alias("bits"))
    return judged.where("bits <> 0 or high > low").select("f1", "f2", "low", "bits")


def covered(cuts: DataFrame, length: int, most_pieces: int) -> DataFrame:
    """(doc_id, hash, cover): for each document that loses bytes its pieces as (at, strings, bits)."""
    distinct = cuts.groupBy("key", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    distinct = save(distinct.select("key", "piece", "low", "high", *names(F.col("piece"))), "suffix-pieces")
    hot = save(distinct.groupBy("key").count().where(F.col("count") > most_pieces).select("key"), "suffix-hot")
    if hot.limit(1).count():
        judged = [save(judge(distinct.join(small(hot), "key", "left_anti"), length), "suffix-judged"), save(judge_alone(distinct.join(small(hot), "key", "left_semi"), length), "suffix-alone")]
        found = judged[0].union(judged[1])
    else:
        judged = [save(judge(distinct, length), "suffix-judged")]
        found = judged[0]
    drop_saved(distinct)
    places = cuts.select("doc_id", "hash", "at", "strings", *names(F.col("piece"))).join(found, ["f1", "f2"])
    all_bits = F.expr("shiftleft(1L, strings) - 1")
    places = places.select("doc_id", "hash", "at", "strings", F.when(F.col("doc_id") > F.col("low"), all_bits).otherwise(F.col("bits")).alias("bits")).where("bits <> 0")
    out = save(places.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("at", "strings", "bits")).alias("cover")), "suffix-cover")
    for table in judged:
        drop_saved(table)
    return out


def removed_mask(size: int, at: np.ndarray, strings: np.ndarray, bits: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes are covered by the strings that the pieces' bits mark, of pieces that begin at ``at``."""
    starts = np.zeros(size, dtype=bool)
    for i in range(int(strings.max()) if len(strings) else 0):
        starts[at[(bits >> i) & 1 == 1] + i] = True
    ends = np.zeros(size, dtype=bool)
    ends[length:] = starts[:max(0, size - length)]
    return np.cumsum(starts.view(np.int8) - ends.view(np.int8), dtype=np.int32) > 0


def remove_repeats(docs: DataFrame, length: int = LENGTH, most_pieces: int = MOST_PIECES, with_spans: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the bytes that stay) and
    spans (removed ones as start and end)."""
    texts = text_of(docs)
    cuts = cut_pieces(texts, length)
    cover = covered(cuts, length, most_pieces)
    drop_saved(cuts)

    def cut(batches):
        for batch in batches:
            data, offsets = binary_column(batch.column(1))
            data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
            doc, (at, strings, bits) = elements(batch.column(2))
            gone = removed_mask(len(data), offsets[doc] + at, strings, bits, length)
            # A run ends with its document.
            edge = np.zeros(len(data) + 1, dtype=bool)
            edge[offsets] = True
            starts, ends = gone & (edge[:-1] | ~np.append(False, gone[:-1])), gone & (edge[1:] | ~np.append(gone[1:], False))
            spans, lost = (np.append(0, np.cumsum(x))[offsets] for x in (starts, gone))
            kept, at_kept = data[~gone].tobytes(), offsets - lost
            digests = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at_kept[:-1], at_kept[1:])]
            out = [batch.column(0), *(pa.array(np.diff(x)) for x in (offsets, lost, spans)), pa.array(digests, pa.string())]
            if with_spans:
                out.append(pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at_kept.astype(np.int32).tobytes()), pa.py_buffer(kept)]))
                base = np.repeat(offsets[:-1], np.diff(spans))
                places = [pa.array(np.flatnonzero(starts) - base), pa.array(np.flatnonzero(ends) + 1 - base)]
                out.append(pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.StructArray.from_arrays(places, ["start", "end"])))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"][:len(out)])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<start:long,end:long>>" if with_spans else "")
    rows = texts.join(cover, ["doc_id", "hash"], "left").select("doc_id", "text", "cover").mapInArrow(cut, schema)
    return null_again(save(rows, "suffix-kept"), "doc_id")


def repeats_removed(docs: DataFrame) -> DataFrame:
    """:func:`remove_repeats` without the bytes themselves."""
    return remove_repeats(docs, with_spans=False)


__all__ = ["common_prefixes", "remove_repeats", "repeats_removed", "suffix_order"]
