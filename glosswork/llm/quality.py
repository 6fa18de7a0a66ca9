"""Quality classifier with hierarchical empirical Bayes.

A logistic document classifier on form features gives every document evidence.  Its
probabilities are summed by host and by path within host (here: source, and lang
within source) in one grouped aggregation; labels are evidence of their own, counted in place of the classifier's
probability where a document has one.  Site posteriors are beta-binomial means:
a host is shrunk toward the global rate, a path toward its host, each by a
concentration estimated from the spread between sites (method of moments), so sparse
sites stay near their prior.  The site's posterior odds, relative to the global ones,
are added to the document's log-odds; as a document's own evidence is part of its site's, it is taken out of the site's sums first.

The classifier is fitted on at most ``MAX_LABELLED`` labelled documents (those with the
smallest hash of doc_id); everything else reads all documents.

Defined results: null text counts as empty, an empty text gets the features of no
words; null source or lang is a site of its own; without labels of both classes the
classifier says 1 everywhere, so that nothing is rejected; a label that repeats a
doc_id counts once (lowest quality); rows are judged singly, so repeated rows are kept
or rejected alike (a label goes to all rows of its doc_id); a score of exactly ``KEEP_FROM`` is kept; a very long text is measured whole; rows travel as
one struct beside the operator's own columns, so that no further column's name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, hash_sample, save, small_batches, small_join

MAX_LABELLED = 20_000
FEATURES = [
    "log_words", "distinct_share", "repeat_share", "upper_share", "punct_share", "shout_share",
    "bar_share", "digit_share", "mean_word", "long_word_share", "sentence_rate", "line_distinct", "symbol_share",
]
KEEP_FROM = 0.5
LIKELY = 1e-6


def features(text: str | None) -> list[float]:
    """Form features of one whole text; each is a share or a logarithm, so length doesn't dominate."""
    text = text or ""
    words, n = text.split(), len(text)
    if not words:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    digits = int(((raw >= 48) & (raw <= 57)).sum())
    symbols = int((((raw > 32) & (raw < 48)) | ((raw > 57) & (raw < 65)) | ((raw > 90) & (raw < 97)) | ((raw > 122) & (raw < 127))).sum())
    plain = text.count(".") + text.count(",")
    count, lines = len(words), [x for x in text.split("\n") if x.strip()]
    adjacent = sum(map(str.__eq__, words, words[1:]))
    return [
        np.log1p(count), len(set(words)) / count, adjacent / count, upper / max(1, upper + lower), plain / n,
        text.count("!") / count, text.count("|") / count, digits / n, min(40.0, n / count) / 10,
        sum(map(int, (len(w) > 20 for w in words))) / count, (text.count(". ") + text.count(".\n")) / count,
        len(set(lines)) / max(1, len(lines)), (symbols - plain) / n,
    ]


class Classifier:
    """Logistic regression on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier | None:
    """Newton steps on the ridge-penalised likelihood; None unless both classes occur."""
    if len(y) == 0 or y.min() == y.max():
        return None
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[0, 0] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty + 1e-9 * np.eye(len(w)), z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Classifier | None:
    """Fit on at most ``most`` labelled documents, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = hash_sample(known, F.xxhash64("doc_id"), most, known.count(), "doc_id")
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches):
        for batch in batches:
            got = pd.DataFrame([features(t) for t in batch["text"]], columns=FEATURES)
            yield got.assign(doc_id=batch["doc_id"].to_numpy(), label=batch["label"].to_numpy().astype(float))

    schema = ", ".join(f"{c} double" for c in FEATURES) + ", doc_id long, label double"
    with small_batches(docs.sparkSession):
        got = labelled.mapInPandas(measure, schema).toPandas()
    got = got.sort_values(["doc_id", *FEATURES])
    return fit(got[FEATURES].to_numpy(), got["label"].to_numpy())


def judged_rows(docs: DataFrame, model: Classifier | None, host: str, path: str) -> DataFrame:
    """(row, p, host, path): each row of ``docs`` as one struct, the classifier's probability that it is good, and its site's key."""
    def key(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("x"), F.col(name).cast("string")), F.lit(""))

    if model is None:
        p = F.lit(1.0)
    else:
        def judge(texts: pd.Series) -> pd.Series:
            return pd.Series(model.probability(np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))))

        p = F.pandas_udf(judge, "double")("text")
    return docs.select(F.struct(*docs.columns).alias("row"), p.alias("p"), key(host).alias("host"), key(path).alias("path"))


def concentration(n: float, rate: float, sum_n2: float, spread: float, sites: float) -> float:
    """The beta prior's strength by the method of moments, from sums over sites.

    ``spread`` is the sum of n (site rate - rate)^2.  Without spread beyond chance sites are held to
    their prior as if by a million documents.
    """
    chance = rate * (1 - rate)
    between = (spread - (sites - 1) * chance) / max(1e-9, n - sum_n2 / max(1e-9, n)) if sites > 1 else 0.0
    return 1e6 if between <= chance * 1e-6 else min(1e6, max(1.0, chance / between - 1))


def site_sums(evidence: DataFrame) -> DataFrame:
    """The grouped aggregation: expected good documents and documents by (host, path)."""
    return evidence.groupBy("host", "path").agg(F.sum("good").alias("good"), F.count("*").alias("n"))


def shrink(paths: DataFrame) -> DataFrame:
    """From sums by (host, path) to posteriors, hosts toward the global rate and paths toward their host."""
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    n, rate = float(total[1] or 0), min(1 - LIKELY, max(LIKELY, (total[0] or 0.0) / max(1, total[1] or 0)))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    h = hosts.agg(F.sum(F.pow("host_n", F.lit(2.0))), F.sum(F.col("host_n") * F.pow(F.col("host_good") / F.col("host_n") - rate, F.lit(2.0))), F.count("*")).first()
    k_host = concentration(n, rate, h[0] or 0, h[1] or 0, h[2])
    hosts = hosts.withColumn("host_rate", (F.col("host_good") + k_host * rate) / (F.col("host_n") + k_host))
    both = paths.join(hosts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    p = both.agg(F.sum(F.pow("n", F.lit(2.0))), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("host_rate"), F.lit(2.0))), F.count("*")).first()
    k_path = concentration(n, rate, p[0] or 0, p[1] or 0, p[2])
    return both.select(
        "host", "path", F.lit(rate).alias("global_rate"), "host_rate",
        ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias("site_rate"), (F.col("n") + k_path).alias("strength"))


def log_odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(LIKELY)), F.lit(1 - LIKELY))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", most: int = MAX_LABELLED, with_text: bool = True) -> DataFrame:
    """(row, p, good, host_rate, site_rate, score, keep): each row of ``docs`` as one struct, beside its judgement.

    Rows are written once with their probabilities, so that features are computed in one pass; without their texts, if these are not asked for.
    """
    judged = judged_rows(docs, train(docs, labels, most), host, path)
    judged = save(judged if with_text else judged.withColumn("row", F.col("row").dropFields("text")), "site-judged")
    told = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("told_id")).agg(F.min("quality").cast("double").alias("told"))
    told = save(told, "site-labels")
    n_told = told.count()

    def evidence(rows: DataFrame) -> DataFrame:
        side = F.broadcast(told) if n_told <= BROADCAST_ROWS else told
        return rows.join(side, F.col("id") == F.col("told_id"), "left").withColumn("good", F.coalesce("told", "p"))

    light = judged.select(F.col("row.doc_id").cast("long").alias("id"), "p", "host", "path")
    sites = save(shrink(save(site_sums(evidence(light)), "site-sums")), "sites")
    joined = small_join(evidence(judged.withColumn("id", F.col("row.doc_id").cast("long"))), sites, ["host", "path"], "left", sites.count())
    # The site's rate without this document's own evidence.
    others = (F.col("site_rate") * F.col("strength") - F.col("good")) / F.greatest(F.col("strength") - 1, F.lit(LIKELY))
    score = log_odds(F.col("p")) + log_odds(others) - log_odds(F.col("global_rate"))
    scored = joined.withColumn("score", 1 / (1 + F.exp(-score))).withColumn("keep", F.col("score") >= KEEP_FROM)
    return scored.select("row", "p", "good", "host_rate", "site_rate", "score", "keep")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, doc_p, host_rate, site_rate, score, kept."""
    got = classify(docs.select("doc_id", "text", "source", "lang"), labels, with_text=False)
    return got.select("row.doc_id", F.col("p").alias("doc_p"), "host_rate", "site_rate", "score", F.col("keep").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their own columns."""
    return classify(docs, labels).where("keep").select("row.*")
