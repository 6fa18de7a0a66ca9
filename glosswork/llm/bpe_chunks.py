"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the characters cuts every text into chunks; equal passages give
equal chunks wherever they stand.  Chunks that the corpus holds more than once are
found by counting their hashes, encoded once each, and joined back to their documents;
all other chunks are encoded where they stand.  Chunk encodings do not simply join,
since a cut may fall within a pre-token.  Each join is repaired: from the last pre-token boundary
that the cut cannot reach, the text is re-encoded over the cut, ever further, until a
boundary of the re-encoding agrees with one of the next chunk; from there on both
read the same characters from the same state, so the ids are those of the whole text.

Encoding is that of the byte-level vocabulary file (a parameter), run by the rank
encoder of the same merges; the file's special strings are cut out first, as its own library does.

Defined results: null text counts as empty and gives no tokens; null ids stay null, repeated rows give
repeated results; of special strings that start at one place the longest counts; a very long text is encoded chunk by chunk and its joins repaired
in one task; an empty table gives an empty result; only doc_id and text are read, further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import json
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import build_filter, id_or_last, mix64, null_again, save

VOCABULARY = "byte_bpe_50k.json"
WINDOW = 32  # characters that the rolling hash sees
CUT_BITS = 9  # a cut every 512 characters on average
SHORTEST = 64  # shorter chunks are encoded where they stand
REACH = 4  # how far before its end a chunk's last pre-tokens may depend on what follows
#: Byte-level pre-tokens, as the vocabulary was made with (fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Vocabulary(NamedTuple):
    """What a vocabulary file says: ids of byte strings in the order of their merges, and of special strings."""

    ranks: dict[bytes, int]
    special: dict[str, int]

    @property
    def width(self) -> str:
        """The type in which ids of chunks travel."""
        return "<u2" if max([0, *self.ranks.values()]) < 1 << 16 else "<u4"


def read_vocabulary(path: str) -> Vocabulary:
    """A byte-level BPE file of the tokenizers library, whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, before = whole["model"], whole["pre_tokenizer"] or {}
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space") or whole["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
    # The format shows a byte as itself if it is a visible character of Latin-1, else as the next character from U+0100 on.
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in shown]
    of = {c: b for b, c in shown.items()} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in whole["added_tokens"]}
    ranks = {bytes(of[c] for c in token): number for token, number in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if merged != sorted(merged) or merged and merged[0] < len(of):
        raise ValueError(f"the ids of {path} do not follow the order of its merges")
    return Vocabulary(ranks, special)


class Codec:
    """The encoder and decoder that a task holds."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        import tiktoken

        self.vocabulary = vocabulary
        self.encoding = tiktoken.Encoding("corpus", pat_str=PRE_TOKEN, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.pre_tokens = regex.compile(PRE_TOKEN)
        self.special_ids, self.width = vocabulary.special, vocabulary.width
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.special_ids, key=lambda x: (-len(x), x)))) or r"(?!)")
        self.bytes_of = self.encoding.decode_bytes
        self.special_bytes = {i: s.encode() for s, i in self.special_ids.items()}

    def decode(self, ids: list[int]) -> str:
        if not self.special_bytes.keys() & set(ids):
            return self.bytes_of(ids).decode("utf-8", "replace")
        parts, run = [], []
        for i in ids:
            if i in self.special_bytes:
                parts += [self.bytes_of(run), self.special_bytes[i]]
                run = []
            else:
                run.append(i)
        return b"".join([*parts, self.bytes_of(run)]).decode("utf-8", "replace")


CODECS: dict[int, Codec] = {}


def codec(shipped) -> Codec:
    """The codec of a broadcast vocabulary; a worker holds one at a time."""
    vocabulary = shipped.value
    if id(vocabulary) not in CODECS:
        CODECS.clear()
        CODECS[id(vocabulary)] = Codec(vocabulary)
    return CODECS[id(vocabulary)]


def cuts(text: str) -> list[int]:
    """Where the rolling hash cuts ``text``: after a window whose hash ends in zeros; 0 and the end included."""
    if len(text) <= WINDOW:
        return [0, len(text)] if text else [0]
    h = mix64(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)).astype(np.uint32)
    span = 1
    while span < WINDOW:  # h[i] covers the 2 * span characters up to i, each weighted by a power of an odd number
        with np.errstate(over="ignore"):
            h[span:] += h[:-span].copy() * np.uint32(pow(0x9E3779B1, span, 1 << 32))
        span *= 2
    at = np.flatnonzero((h[WINDOW - 1:] >> np.uint32(32 - CUT_BITS)) == 0) + WINDOW
    return [0, *(int(i) for i in at if i < len(text)), len(text)]


def chunk_key(chunk: str) -> tuple[int, int]:
    """128 bits of a chunk's content, as two signed words."""
    raw = hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def pieces(text: str, c: Codec) -> list[tuple[int, int, int | None]]:
    """Ordinary stretches (start, end, None) and special strings (start, end, id) of ``text``, in order."""
    if not any(s in text for s in c.special_ids):
        return [(0, len(text), None)]
    out, at = [], 0
    for m in c.special.finditer(text):
        out += [(at, m.start(), None), (*m.span(), c.special_ids[m.group()])]
        at = m.end()
    return [*out, (at, len(text), None)]


def anchor(text: str, low: int, high: int) -> int:
    """The last place in [low, high) that is a pre-token boundary whatever surrounds it: a lone
    space between a visible character and a letter; ``low`` if there is none."""
    at = text.rfind(" ", low + 1, max(low, high - 1))
    while at > low:
        if not text[at - 1].isspace() and text[at + 1].isalpha():
            return at
        at = text.rfind(" ", low + 1, at)
    return low


def join_chunks(text: str, known: dict[int, tuple[int, list[int]]], c: Codec) -> list[int]:
    """The ids of ``text``, given {start: (end, ids)} for chunks that were encoded elsewhere.

    ``head`` is a true pre-token boundary before which all ids are out.  Boundaries are only used
    after visible characters, since a run of white space may be split by what follows it.
    """
    out: list[int] = []
    head = 0
    for start, (end, ids) in sorted(known.items()):
        chunk = text[start:end]
        reach = end if end == len(text) else end - REACH
        own = [x for m in c.pre_tokens.finditer(chunk) if (x := start + m.end()) <= reach and not text[x - 1].isspace()]
        if not own or own[-1] <= head:
            continue
        last, meet = own[-1], start if head == start else None
        if meet is None:  # re-encode over the cut until both agree on a boundary
            agreed = set(own)
            for m in c.pre_tokens.finditer(text, anchor(text, head, start)):
                if m.end() in agreed:
                    meet = m.end()
                if meet is not None or m.end() > last:
                    break
        if meet is None or meet >= last:
            continue
        if meet > head:
            out += c.encode(text[head:meet])
        skip = len(c.encode(text[start:meet])) if meet > start else 0
        rest = len(c.encode(text[last:end])) if last < end else 0
        out += ids[skip:len(ids) - rest]
        head = last
    return out + (c.encode(text[head:]) if head < len(text) else [])


def encode_text(text: str, known: dict[int, tuple[int, list[int]]], c: Codec) -> list[int]:
    out: list[int] = []
    for start, end, special in pieces(text, c):
        if special is not None:
            out.append(special)
        elif end > start:
            inside = {s - start: (e - start, ids) for s, (e, ids) in known.items() if start <= s < end}
            out += join_chunks(text[start:end], inside, c) if inside else c.encode(text[start:end])
    return out


def chunks_of(text: str, c: Codec) -> list[tuple[int, int]]:
    """Spans of the chunks worth sharing."""
    return [(start + a, start + b) for start, end, special in pieces(text, c) if special is None
            for bounds in [cuts(text[start:end])] for a, b in zip(bounds, bounds[1:]) if b - a >= SHORTEST]


def digests(ids: list[int], c: Codec) -> tuple[int, str, str]:
    decoded = c.decode(ids).encode("utf-8", "surrogatepass")
    return len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def vocabulary_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if asked for)."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(read_vocabulary(vocabulary or vocabulary_file()))
    texts = docs.select(id_or_last(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches):
        c = codec(words)
        for batch in batches:
            found: dict[int, int] = {}
            for text in batch["text"]:
                for a, b in chunks_of(text, c):
                    key = chunk_key(text[a:b])[0]
                    found[key] = found.get(key, 0) + 1
            yield pd.DataFrame({"key": list(found.keys()), "n": list(found.values())}, dtype="int64")

    counts = texts.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(build_filter(save(counts.where("n > 1").select("key"), "bpe-shared")))
    final = "n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"

    def first_pass(batches):
        from pyspark import TaskContext

        c, row = codec(words), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                spans = chunks_of(text, c)
                keys = [chunk_key(text[a:b]) for a, b in spans]
                hit = shared.value.test(np.array([k for k, _ in keys], dtype=np.int64).view(np.uint64))
                marks = [(a, b, *k) for (a, b), k, h in zip(spans, keys, hit, strict=True) if h]
                if marks:
                    out.append((row, doc_id, text, marks, None, None, None, None))
                else:
                    ids = encode_text(text, {}, c)
                    out.append((row, doc_id, None, None, *digests(ids, c), ids if with_ids else None))
                row += 1
            got = pd.DataFrame(out, columns=["row", "doc_id", "text", "marks", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])
            yield got.astype({"n_tokens": "Int64"})

    marks = "array<struct<start:int,end:int,k1:long,k2:long>>"
    rows = save(texts.mapInPandas(first_pass, f"row long, doc_id long, text string, marks {marks}, {final}"), "bpe-rows")
    shared.destroy()
    open_rows = rows.where("text is not null").select("row", "doc_id", "text", "marks")

    def contents(batches):
        for batch in batches:
            found = {}
            for text, own in zip(batch["text"], batch["marks"], strict=True):
                found.update(((m["k1"], m["k2"]), text[m["start"]:m["end"]]) for m in own)
            yield pd.DataFrame([(*k, t) for k, t in found.items()], columns=["k1", "k2", "chunk"])

    def encode_chunks(batches):
        c = codec(words)
        for batch in batches:
            yield pd.DataFrame({"k1": batch["k1"], "k2": batch["k2"], "code": [np.asarray(c.encode(x), dtype="<u4").astype(c.width).tobytes() for x in batch["chunk"]]})

    once = open_rows.select("text", "marks").mapInPandas(contents, "k1 long, k2 long, chunk string").groupBy("k1", "k2").agg(F.min("chunk").alias("chunk"))
    codes = save(once.mapInPandas(encode_chunks, "k1 long, k2 long, code binary"), "bpe-codes")
    uses = open_rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    located = uses.join(codes, ["k1", "k2"]).groupBy("row").agg(F.collect_list(F.struct("start", "end", "code")).alias("known"))

    def assemble(batches):
        c = codec(words)
        for batch in batches:
            out = []
            for doc_id, text, own in zip(batch["doc_id"], batch["text"], batch["known"], strict=True):
                known = {m["start"]: (m["end"], np.frombuffer(m["code"], dtype=c.width).tolist()) for m in own}
                ids = encode_text(text, known, c)
                out.append((doc_id, *digests(ids, c), ids if with_ids else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    assembled = open_rows.select("row", "doc_id", "text").join(located, "row").select("doc_id", "text", "known").mapInPandas(assemble, f"doc_id long, {final}")
    assembled = save(assembled, "bpe-joined")
    words.destroy()
    every = rows.where("text is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").union(assembled)
    every = null_again(every, "doc_id")
    return every if with_ids else every.drop("ids")
