"""Personal data by patterns and by what terms disclose.

Patterns find the protected entities: e-mail addresses, IP addresses, card and phone
numbers, and keys (long runs of mixed letters and digits, as of access tokens).  Terms that occur in the same texts as an
entity may give it away as well.  How strongly is
estimated over the whole corpus, in one unit, the distinct text (copies of a text count
once in every number): with n(t, e) texts that hold term t and entity e, n(t) texts that hold t, n(e)
texts that hold e and N texts, a term's disclosure is the share of the entity's information content that
the term reveals, PMI(t, e) / IC(e) = 1 + log(n(t, e) / n(t)) / log(N / n(e)).  Every word
of a text is a term, wherever in it the entity stands.

An entity e is a value (one address) and, as most values stand in one text only, its class as well (any e-mail address): a term
is judged by the largest of its disclosures, so that values too rare to estimate from back off to their class.
Estimates count if they have support - at least ``SUPPORT`` texts hold both - and evidence: n(t, e) * PMI(t, e) of at least
ln(N / ``CHANCE``), so that by chance alone a corpus of any size is expected to give less than ``CHANCE`` terms for each N tried.
Terms are generalised from ``GENERALISE`` on and removed from ``REMOVE`` on, wherever they
occur.

Only values in ``SUPPORT`` texts can be paired with terms; pairs are
counted within a task before they travel.  The texts that hold t and any entity are no more than
n(t); pairs whose disclosure by this number is below ``GENERALISE`` are below it by n(t) as well and go.
The counts n(t) of the other terms are taken in one more pass over all texts, through a filter of
bounded size and an exact join.

Defined results: null text counts as empty and has no spans; term spans never overlap
pattern spans; rows are judged and sanitised singly, by a row number, so that null and repeated ids do not mix; of spans with one start the
kind listed first comes first; an entity that all documents hold has no
information to reveal; a very long text is searched whole, its words in pieces; an empty table gives an empty result; only doc_id and text
are read, further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import build_filter, id_or_last, null_again, save, small_join
from .minhash import slices, word_hashes

KINDS = ["email", "ip", "card", "phone"]
CLASSES = [*KINDS, "key"]
TERM_RANK = len(CLASSES)
SUPPORT, GENERALISE, REMOVE, CHANCE = 3, 0.9, 0.98, 0.01
PAIRS_AT_ONCE = 1_000_000  # (entity, term) pairs of a task held in memory

# Fixed patterns.  An address starts at the first of the characters that lead to its "@";
# looking for the "@" first keeps long runs linear.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KEY = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}(?![A-Za-z0-9])")
KEY_MIX = 4  # letters and digits that a key has at least of each
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all pattern matches, by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))] if "." in text else []
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


def key_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of keys."""
    if not DIGIT.search(text):
        return []
    found = [(m.start(), len(KINDS), m.end(), len(DIGIT.findall(m.group()))) for m in KEY.finditer(text)]
    return [(a, k, b) for a, k, b, digits in found if KEY_MIX <= digits <= b - a - KEY_MIX]


def entity_key(kind: int, value: str) -> int:
    """A value's key; 0 stands for any entity, -1 - kind for the class."""
    plain = value.lower() if kind in (0, len(KINDS)) else "".join(c for c in value if c.isdigit() or c == ".")
    return int.from_bytes(hashlib.blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little") >> 1 or 1


def entities_of(text: str, spans: list[tuple[int, int, int]]) -> list[int]:
    """The values and classes that a text holds."""
    return sorted({entity_key(kind, text[start:end]) for start, kind, end in spans} | {-1 - kind for _, kind, _ in spans})


def term_keys(terms: list[str]) -> list[int]:
    """Keys of single words, as :func:`word_hashes` gives them."""
    if not terms:
        return []
    keys, doc = word_hashes(terms)
    first = np.searchsorted(doc, np.arange(len(terms)))
    return keys.view(np.int64)[first].tolist()


def free_words(text: str, spans: list[tuple[int, int, int]]) -> list[re.Match]:
    """The words of ``text`` that overlap none of ``spans`` (sorted by start)."""
    out, at, end = [], 0, 0
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            end, at = max(end, spans[at][2]), at + 1
        if end <= m.start():
            out.append(m)
    return out


class Distinct:
    """Every text once, for several passes: texts whose hash occurs once where they stand, the others from a table of distinct texts.

    :meth:`fresh` drops from a batch the rows that the table holds, so that a pass needs no further Python stage before its own.
    """

    def __init__(self, texts: DataFrame):
        key = F.xxhash64("text")
        repeated = save(texts.select(key.alias("key")).groupBy("key").count().where("count > 1").select("key"), "pii-repeated")
        self.again = texts.sparkSession.sparkContext.broadcast(build_filter(repeated))
        again = self.again

        def copies(batches):
            for batch in batches:
                yield batch.loc[again.value.test(batch["key"].to_numpy(dtype=np.int64).view(np.uint64)), ["text"]]

        keyed = texts.select("text", key.alias("key"))
        once = save(keyed.mapInPandas(copies, "text string").distinct(), "pii-copies")
        self.rows = keyed.select("text", "key", F.lit(True).alias("own")).union(once.select("text", F.lit(0).cast("long"), F.lit(False)))

    def passing(self, work, schema: str) -> DataFrame:
        """``work`` (from lists of distinct texts to frames) over all of them."""
        again = self.again

        def run(batches):
            def fresh():
                for batch in batches:
                    seen = again.value.test(batch["key"].to_numpy(dtype=np.int64).view(np.uint64))
                    yield batch["text"][~(seen & batch["own"].to_numpy(dtype=bool))].tolist()

            yield from work(fresh())

        return self.rows.mapInPandas(run, schema)


def disclosures(texts: DataFrame) -> DataFrame:
    """Terms that disclose an entity: term (key), level (the largest disclosure)."""
    spark = texts.sparkSession
    distinct = Distinct(texts)

    def hold(batches):
        for texts_ in batches:
            found = [e for text in texts_ for e in entities_of(text, pattern_spans(text) + key_spans(text))]
            keys, n = np.unique(np.array(found, dtype=np.int64), return_counts=True)
            yield pd.DataFrame({"entity": [0, *keys.tolist()], "n": [len(texts_), *n.tolist()]})

    held = save(distinct.passing(hold, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("n_entity")), "pii-entities")
    n_texts = held.where("entity = 0").agg(F.sum("n_entity")).first()[0] or 0
    entities = save(held.where((F.col("entity") != 0) & (F.col("n_entity") >= SUPPORT)), "pii-recurring")
    recurring = spark.sparkContext.broadcast(build_filter(entities.select("entity")))

    def pair(batches):
        def flush():
            both, n = np.unique(np.concatenate(parts, axis=1), axis=1, return_counts=True)
            parts.clear()
            return pd.DataFrame({"entity": both[0], "term": both[1], "n": n.astype(np.int64)})

        parts, size = [], 0
        for texts_ in batches:
            for text in texts_:
                spans = sorted(pattern_spans(text) + key_spans(text))
                own = np.array(entities_of(text, spans), dtype=np.int64)
                own = own[recurring.value.test(own.view(np.uint64))]
                if not len(own):
                    continue
                terms = np.array(term_keys(sorted({m.group().lower() for m in free_words(text, spans)})), dtype=np.int64)
                own = np.append(own, 0)
                step = max(1, PAIRS_AT_ONCE // max(1, len(terms)))
                for start in range(0, len(own), step):
                    some = own[start:start + step]
                    parts.append(np.stack([np.repeat(some, len(terms)), np.tile(terms, len(some))]))
                    size += parts[-1].shape[1]
                    if size >= PAIRS_AT_ONCE:
                        yield flush()
                        size = 0
        if parts:
            yield flush()

    def pmi(n_term: str) -> Column:
        return F.log(F.col("n_both") / F.least(F.col(n_term), F.lit(n_texts)) * F.lit(float(n_texts)) / F.col("n_entity"))

    def disclosure(n_term: str) -> Column:
        information = F.log(F.lit(float(n_texts)) / F.col("n_entity"))
        return F.when(information > 0, 1 + F.log(F.least(F.lit(1.0), F.col("n_both") / F.col(n_term))) / information).otherwise(0.0)

    paired = distinct.passing(pair, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    paired = save(paired, "pii-paired")
    least = save(paired.where("entity = 0").select("term", F.col("n_both").alias("n_least")), "pii-least")
    pairs = save(paired.where("entity <> 0").join(entities, "entity").join(least, "term").where(disclosure("n_least") >= GENERALISE), "pii-pairs")
    if not pairs.limit(1).count():
        return pairs.select("term", F.lit(0.0).alias("level")).limit(0)
    wanted = spark.sparkContext.broadcast(build_filter(save(pairs.select("term").distinct(), "pii-candidates")))

    def count(batches):
        def flush():
            terms, n = np.unique(np.concatenate(parts), return_counts=True)
            parts.clear()
            return pd.DataFrame({"term": terms, "n": n.astype(np.int64)})

        parts, size = [], 0
        for texts_ in batches:
            for _, part in slices(texts_):
                keys, doc = word_hashes(part)
                hit = wanted.value.test(keys)
                parts.append(np.unique(np.column_stack([doc[hit].astype(np.int64), keys[hit].view(np.int64)]), axis=0)[:, 1])
                size += len(parts[-1])
                if size >= PAIRS_AT_ONCE:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    counts = save(distinct.passing(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_term")), "pii-counts")
    for shipped in (distinct.again, recurring, wanted):
        shipped.destroy()
    known = pairs.join(counts, "term").where(F.col("n_both") * pmi("n_term") >= F.lit(float(np.log(max(1, n_texts) / CHANCE))))
    return known.groupBy("term").agg(F.max(disclosure("n_term")).alias("level")).where(F.col("level") >= GENERALISE)


SPAN = "struct<start:int,rank:int,end:int,kind:string>"


def find_spans(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_key, n_term, n_spans, base_sha256, spans (array of start, rank, end, kind), and the text, if asked for."""
    spark = docs.sparkSession
    texts = docs.select(id_or_last(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = save(disclosures(texts), "pii-terms")
    n_told = told.count()
    marked = spark.sparkContext.broadcast(build_filter(told.select("term")))

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            texts_, out = list(batch["text"]), []
            has_term = np.zeros(len(texts_), dtype=bool)
            if n_told:
                for start, part in slices(texts_):
                    keys, doc = word_hashes(part)
                    has_term[start + np.unique(doc[marked.value.test(keys)])] = True
            for doc_id, text, more in zip(batch["doc_id"], texts_, has_term, strict=True):
                spans = pattern_spans(text)
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                every = sorted(spans + key_spans(text))
                n = [sum(k == j for _, k, _ in every) for j in range(len(CLASSES))]
                hits = []
                if more:
                    words = free_words(text, every)
                    keys = term_keys([m.group().lower() for m in words])
                    test = marked.value.test(np.array(keys, dtype=np.int64).view(np.uint64))
                    hits = [(m.start(), m.end(), key) for m, key, ok in zip(words, keys, test, strict=True) if ok]
                out.append((row, doc_id, *n, hashlib.sha256(line.encode()).hexdigest(), [(a, k, b, CLASSES[k]) for a, k, b in every], hits, text if with_text else None))
                row += 1
            yield pd.DataFrame(out, columns=["row", "doc_id", *[f"n_{k}" for k in CLASSES], "base_sha256", "base", "hits", "text"])

    schema = f"row long, doc_id long, {', '.join(f'n_{k} long' for k in CLASSES)}, base_sha256 string, base array<{SPAN}>, hits array<struct<start:int,end:int,term:long>>, text string"
    rows = save(texts.mapInPandas(run, schema), "pii-rows")
    marked.destroy()
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    action = F.when(F.col("level") >= REMOVE, "remove").otherwise("term")
    kept = small_join(hits, told.select("term", action.alias("kind")), ["term"], "inner", n_told)
    extra = save(kept.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(TERM_RANK).alias("rank"), "end", "kind")).alias("extra")), "pii-extra")
    both = rows.drop("hits").join(extra, "row", "left")
    none = F.array().cast(f"array<{SPAN}>")
    every = F.array_sort(F.concat("base", F.coalesce("extra", none)))
    out = null_again(both, "doc_id").select(
        "doc_id", *[f"n_{k}" for k in CLASSES], F.size(F.coalesce("extra", none)).cast("long").alias("n_term"), F.size(every).cast("long").alias("n_spans"), "base_sha256", every.alias("spans"), "text")
    return out if with_text else out.drop("text")


def personal_data(docs: DataFrame) -> DataFrame:
    """As :func:`find_spans`, the spans as one string of kind:start:end; of terms the kind is what is done with them, term
    (generalised) or remove."""
    line = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_spans(docs).withColumn("spans", line)


def masked(text: str | None, spans) -> str:
    """``text`` with patterns named, disclosing terms generalised or removed."""
    text, out, at = text or "", [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["rank"])):
        if s["start"] >= at:
            out += [text[at:s["start"]], "" if s["kind"] == "remove" else f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitize(docs: DataFrame) -> DataFrame:
    """doc_id and the sanitised text of every row."""
    mask = F.pandas_udf(lambda texts, spans: pd.Series([masked(t, s if s is not None else []) for t, s in zip(texts, spans, strict=True)], dtype=object), "string")
    return find_spans(docs, with_text=True).select("doc_id", mask("text", "spans").alias("text"))
