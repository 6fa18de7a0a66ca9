"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  One aggregation counts tokens
by cell; raking scales the cells in turn until their sums meet the targets of all
three margins.  A cell's calibrated weight is raked over counted tokens; documents are
sampled by probabilities made from it.  A document's draw is a hash of its doc_id, so a rerun or
a lost executor changes nothing.

Topics are those of a mixture of multinomials over hashed words, fitted by EM on all documents: a round adds up, task by task, what each document
gives to ``TOPICS`` x ``TOPIC_WORDS`` sums, and the driver gets these sums alone.  The first round starts from a fit on at most ``START_DOCS`` documents
(smallest hashes).  Shares are whole multiples of 1 / ``SHARE``, so that sums are exact in any order.  Every document gets the topic most likely
for its whole text.

Targets may be given by margin as {value: weight}, counted over the values that occur; a margin without gets tempered
shares, tokens ** ``temper``.  Probabilities are in proportion to the weights, the largest being 1, so that ``expected`` sums equal the
targets' shares exactly; or, with ``keep``, that share of all tokens is kept: margins are filled up to it in proportion to their targets, a value
that has less being kept whole, and no cell is raked beyond its own tokens.  Either way no document has to be repeated.
Tokens are runs of characters other than white space;
an empty text counts as one token, so that every document can be drawn.

Cells are raked on the driver while they are at most ``MAX_DRIVER_CELLS`` (counted
first), beyond that by joins of grouped sums, by the same rule and until the same tolerance; then a margin's values and targets are tables too.

Defined results: null source, language or topic is a value of its own; null text is
empty, and texts without words have the topic ``none``; values without a target weight get probability 0 where targets are given; rows
that repeat a doc_id are drawn alike; a null doc_id is drawn by its text; of topics equally likely the first is taken; a draw equal to the probability
does not keep; a very long text is counted whole, its words in pieces; rows travel as one struct beside the operator's own columns, so that no
further column's name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BATCH_ROWS, hash_sample, save, small_batches, small_join
from .minhash import slices, word_hashes

MARGINS = ["source", "lang", "topic"]
TEMPER, KEEP = 0.9, 0.75
ROUNDS, TOLERANCE = 200, 1e-9
MAX_DRIVER_CELLS = 200_000
TOPICS, TOPIC_WORDS, START_DOCS = 8, 512, 2_000
EM_ROUNDS, EM_MOVED = 10, 1e-3  # rounds over all documents, at most, until the topics' shares move by less in all
SHARE = 1 << 16
COUNT = np.dtype([("word", "<u2"), ("n", "<u4")])
NONE = "\0none"
CELLS = pa.schema([*((name, pa.string()) for name in MARGINS), ("tokens", pa.int64()), ("raked", pa.float64())])


def word_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed words, one row a text."""
    out = np.zeros((len(texts), TOPIC_WORDS))
    for start, part in slices(texts):
        keys, doc = word_hashes(part)
        cell = (doc + start) * TOPIC_WORDS + (keys % np.uint64(TOPIC_WORDS)).astype(np.int64)
        out += np.bincount(cell, minlength=out.size).reshape(out.shape)
    return out


def packed_counts(counts: np.ndarray) -> list[bytes]:
    """Each row's counts above zero, as the bytes of ``COUNT`` records."""
    out = []
    for row in counts:
        words = np.flatnonzero(row)
        got = np.zeros(len(words), dtype=COUNT)
        got["word"], got["n"] = words, row[words]
        out.append(got.tobytes())
    return out


def unpacked(rows) -> np.ndarray:
    """The counts that :func:`packed_counts` made, one row each."""
    rows = [bytes(r) for r in rows]
    got = np.frombuffer(b"".join(rows), dtype=COUNT)
    doc = np.repeat(np.arange(len(rows)), [len(r) // COUNT.itemsize for r in rows])
    return np.bincount(doc * TOPIC_WORDS + got["word"], got["n"], minlength=len(rows) * TOPIC_WORDS).reshape(-1, TOPIC_WORDS)


class TopicModel:
    """A mixture of multinomials: log shares of topics, log shares of words by topic."""

    def __init__(self, prior: np.ndarray, words: np.ndarray):
        self.prior, self.words = prior, words

    def logs(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.words.T + self.prior

    def topics(self, counts: np.ndarray) -> np.ndarray:
        return self.logs(counts).argmax(axis=1)

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """Each document's probability of each topic."""
        z = self.logs(counts)
        share = np.exp(z - z.max(axis=1, keepdims=True))
        return share / share.sum(axis=1, keepdims=True)


def estimated(docs: np.ndarray, words: np.ndarray) -> TopicModel:
    """The model of expected documents by topic and words by topic, with a little added to each."""
    words = words + 0.1
    return TopicModel(np.log((docs + 1) / (docs.sum() + len(docs))).round(9), np.log(words / words.sum(axis=1, keepdims=True)).round(9))


def fit_topics(counts: np.ndarray, topics: int = TOPICS, seed: int = 3, rounds: int = 40) -> TopicModel | None:
    """EM from the documents farthest from each other."""
    counts = counts[counts.sum(axis=1) > 0]
    if not len(counts):
        return None
    rng, unit = np.random.default_rng(seed), np.sqrt(counts / counts.sum(axis=1, keepdims=True))
    chosen = [int(rng.integers(len(unit)))]
    while len(chosen) < min(topics, len(unit)):
        chosen.append(int((unit @ unit[chosen].T).max(axis=1).argmin()))
    share = np.eye(len(chosen))[(unit @ unit[chosen].T).argmax(axis=1)]
    for _ in range(rounds):
        model = estimated(share.sum(axis=0), share.T @ counts)
        share = model.shares(counts)
    return model


def topic_sums(rows: DataFrame, model: TopicModel) -> tuple[np.ndarray, np.ndarray]:
    """One round over the ``counts`` of all rows: expected documents and words by topic, in units of 1 / ``SHARE``.

    A task adds up its own rows; what leaves it is at most one row for each sum.
    """
    width, topics = TOPIC_WORDS + 1, len(model.prior)

    def add(batches):
        total = np.zeros((topics, width), dtype=np.int64)
        for batch in batches:
            counts = unpacked(batch["counts"])
            share = np.rint(SHARE * model.shares(counts))
            total[:, :-1] += (share.T @ counts).astype(np.int64)  # whole numbers far below 2 ** 53
            total[:, -1] += share.sum(axis=0).astype(np.int64)
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells.astype(np.int32), "n": total.ravel()[cells]})

    with small_batches(rows.sparkSession):
        got = rows.select("counts").mapInPandas(add, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(topics * width)
    sums[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
    sums = sums.reshape(topics, width) / SHARE
    return sums[:, -1], sums[:, :-1]


def learn_topics(rows: DataFrame, start_docs: int = START_DOCS, rounds: int = EM_ROUNDS) -> TopicModel | None:
    """Topics of all ``rows`` (h, counts), numbered by size; the driver gets counts of words of the start alone, then sums."""
    rows = rows.select("h", "counts").where(F.length("counts") > 0)
    start = hash_sample(rows, F.col("h"), start_docs, rows.count(), "counts").toPandas()
    if not len(start):  # rows that repeat so often that no hash is small
        start = rows.orderBy("h", "counts").limit(start_docs).toPandas()
    model = fit_topics(unpacked(start["counts"]))
    if model is None:
        return None
    for _ in range(rounds):
        docs, words = topic_sums(rows, model)
        before, model = model, estimated(docs, words)
        if np.abs(np.exp(model.prior) - np.exp(before.prior)).sum() < EM_MOVED:
            break
    order = np.lexsort((np.arange(len(model.prior)), -model.prior))
    return TopicModel(model.prior[order], model.words[order])


def margin(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NONE))


def filled(want: np.ndarray, have: np.ndarray, total: float) -> np.ndarray:
    """``total`` dealt out in proportion to ``want``, nobody getting more than ``have``."""
    out, open_ = np.zeros(len(want)), want > 0
    left = min(total, float(have[open_].sum()))
    while open_.any() and left > 0:
        part = want * (left / want[open_].sum())
        full = open_ & (part >= have)
        if not full.any():
            out[open_] = part[open_]
            break
        out[full] = have[full]
        left -= float(have[full].sum())
        open_ &= ~full
    return out


def margin_targets(sums: pd.DataFrame, name: str, targets: dict[str, dict], temper: float, keep: float | None) -> pd.DataFrame:
    """(value, have) of one margin's values with ``want``, the raked tokens that each shall have."""
    have = sums["have"].to_numpy(dtype=float)
    if name in targets:
        want = np.array([float(targets[name].get(None if v == NONE else v, 0.0)) for v in sums["value"]])
    else:
        want = have**temper
    total = float(have.sum())
    if keep is not None:
        return sums.assign(want=filled(want, have, keep * total))
    return sums.assign(want=want / want.sum() * total if want.sum() > 0 else want)


def rake(cells: pd.DataFrame, targets: dict[str, dict], temper: float = TEMPER, keep: float | None = None) -> pd.DataFrame:
    """Raked token weights of ``cells`` (margins, tokens); adds the column raked."""
    cells = cells.sort_values(MARGINS).reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(dtype=float)
    total, raked, plan = float(tokens.sum()), tokens.copy(), []
    for name in MARGINS:
        codes, values = pd.factorize(cells[name])
        sums = pd.DataFrame({"value": values, "have": np.bincount(codes, tokens, minlength=len(values))})
        plan.append((codes, margin_targets(sums, name, targets, temper, keep)["want"].to_numpy()))
    for _ in range(ROUNDS):
        before = raked
        for codes, want in plan:
            have = np.bincount(codes, raked, minlength=len(want))
            raked = raked * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[codes]
            if keep is not None:
                raked = np.minimum(raked, tokens)
        if float(np.abs(raked - before).max(initial=0.0)) <= TOLERANCE * max(total, 1.0):
            break
    return cells.assign(raked=raked)


def wanted(cells: DataFrame, name: str, targets: dict[str, dict], temper: float, keep: float | None) -> DataFrame:
    """As :func:`margin_targets`, as a table (margin, want); ``filled`` by the level at which the open values' parts add up."""
    sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("have"))
    if name in targets:
        given = [(NONE if value is None else str(value), float(weight)) for value, weight in targets[name].items()]
        sums = sums.join(cells.sparkSession.createDataFrame(given, f"{name} string, want double"), name, "left").fillna(0.0, ["want"])
    else:
        sums = sums.withColumn("want", F.pow("have", F.lit(temper)))
    sums = save(sums, "rake-targets")
    have, want, some = sums.agg(F.sum("have"), F.sum("want"), F.sum(F.when(F.col("want") > 0, F.col("have")))).first()
    have, want, some = have or 0.0, want or 0.0, some or 0.0
    if keep is None:
        return sums.select(name, (F.col("want") / want * have if want > 0 else F.lit(0.0)).alias("want"))
    left, whole, open_, level = min(keep * have, some), -1.0, want, 0.0
    while open_ > 0:
        level = (left - max(whole, 0.0)) / open_
        full = F.col("want") * level >= F.col("have")
        got = sums.where("want > 0").agg(F.sum(F.when(full, F.col("have"))), F.sum(F.when(~full, F.col("want")))).first()
        if (got[0] or 0.0) <= max(whole, 0.0):
            break
        whole, open_ = got[0], got[1] or 0.0
    part = F.least(F.col("have"), F.col("want") * level) if open_ > 0 else F.col("have")
    return sums.select(name, F.when(F.col("want") > 0, part).otherwise(0.0).alias("want"))


def rake_distributed(cells: DataFrame, targets: dict[str, dict], temper: float = TEMPER, keep: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """As :func:`rake`, by grouped sums and joins; each round is written to the shared folder."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    wants = {name: wanted(cells, name, targets, temper, keep) for name in MARGINS}
    now = cells.withColumn("raked", F.col("tokens").cast("double"))
    for _ in range(rounds):
        before = now
        for name in MARGINS:
            have = save(now.groupBy(name).agg(F.sum("raked").alias("have")).join(wants[name], name), "rake-sums")
            factor = have.select(name, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("factor"))
            raked = F.col("raked") * F.col("factor")
            now = now.join(factor, name).select(*MARGINS, "tokens", (raked if keep is None else F.least(raked, F.col("tokens").cast("double"))).alias("raked"))
        now = save(now, "raked")
        moved = now.join(before.select(*MARGINS, F.col("raked").alias("was")), MARGINS).agg(F.max(F.abs(F.col("raked") - F.col("was")))).first()[0] or 0.0
        if moved <= TOLERANCE * max(total, 1.0):
            break
    return now


def draw(doc_id: Column, text: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a hash of the id, or of the text where there is none."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.xxhash64(text)), F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, temper: float = TEMPER, seed: int = 17, keep: float | None = None, with_text: bool = True) -> DataFrame:
    """(row, source, lang, topic, tokens, weight, prob, keep): each row of ``docs`` as one struct, beside what it is drawn by
    (weight: raked over counted tokens).  Rows are written once, without their texts if these are not asked for."""
    def measure(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        return pd.DataFrame({"tokens": np.array([max(1, len(t.split())) for t in texts], dtype=np.int64), "counts": packed_counts(word_counts(texts))})

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    judged = docs.select(
        F.struct(*docs.columns).alias("row"), margin(F.col("source")).alias("source"), margin(F.col("lang")).alias("lang"),
        draw(F.col("doc_id").cast("long"), text, seed).alias("draw"), F.xxhash64("doc_id", text).alias("h"),
        F.pandas_udf(measure, "tokens long, counts binary")(F.col("text").cast("string")).alias("got"))
    judged = save(judged.select(F.col("row") if with_text else F.col("row").dropFields("text").alias("row"), "source", "lang", "got.tokens", "got.counts", "draw", "h"), "mix-rows")
    model = learn_topics(judged)

    def name(counts: pd.Series) -> pd.Series:
        names = np.full(len(counts), "none", dtype=object)
        some = np.flatnonzero(counts.str.len().to_numpy(dtype=np.int64) > 0)
        for part in np.split(some, range(BATCH_ROWS, len(some), BATCH_ROWS)):
            if len(part) and model is not None:
                names[part] = [f"topic {t}" for t in model.topics(unpacked(counts.iloc[part]))]
        return pd.Series(names)

    judged = judged.withColumn("topic", F.pandas_udf(name, "string")("counts"))
    cells = save(judged.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    n = cells.count()
    if n <= MAX_DRIVER_CELLS:
        got = rake(cells.toPandas(), targets or {}, temper, keep)
        # As Arrow: rows of tuples would start Python workers of another kind on every executor, which stay.
        raked = docs.sparkSession.createDataFrame(pa.Table.from_pandas(got, CELLS, preserve_index=False))
    else:
        raked = rake_distributed(cells, targets or {}, temper, keep)
    weights = raked.select(*MARGINS, (F.col("raked") / F.col("tokens")).alias("weight"))
    top = 1.0 if keep is not None else weights.agg(F.max("weight")).first()[0] or 1.0
    joined = small_join(judged, weights, MARGINS, "left", n).withColumn("prob", F.col("weight") / F.lit(top))
    return joined.select("row", *MARGINS, "tokens", "weight", "prob", (F.col("draw") < F.col("prob")).alias("keep"))


def sampled_rows(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, weight, prob, kept."""
    got = mix(docs.select("doc_id", "text", "source", "lang"), keep=KEEP, with_text=False)
    return got.select("row.doc_id", "row.source", "row.lang", "topic", "tokens", "weight", "prob", F.col("keep").alias("kept"))


def keep_sampled(docs: DataFrame, keep: float | None = KEEP) -> DataFrame:
    """The documents drawn, with their own columns."""
    return mix(docs, keep=keep).where("keep").select("row.*")
