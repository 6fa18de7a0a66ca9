"""Small tests of the corpus operators against brute force, with odd rows of every kind."""

import hashlib
import html
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glosswork.llm import ann_partitions, bpe_chunks, exact_dedup, html_extract, line_runs, minhash, mixing, quality, sanitize, url_filter
from glosswork.llm._common import build_filter, components
from glosswork.llm.ann_partitions import nearest_vectors

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, _p double, part int"


def documents(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = ids or range(len(texts))
    rows = [(i, t, None if n % 5 == 4 else "en", None if n % 7 == 6 else f"s{n % 3}", n, "x", 0.5, 1) for n, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def sentences(seed, n, words=60):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(words)) for _ in range(n)]


ODD = [None, "", " ", "a b c", "a  b\tc", "x", "x", "!!!"]


def test_filter_and_components(spark):
    keys = spark.range(0, 3000, 3).select("id")
    found = build_filter(keys).test(np.arange(3000, dtype=np.uint64))
    assert found[::3].all() and found.mean() < 0.36
    edges = [(1, 2), (2, 3), (9, 3), (7, 8), (5, 5)] + [(i, i + 1) for i in range(100, 140)] + [(50, i) for i in range(200, 230)]
    got = {r["id"]: r["class_id"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 9)} == {1} and got[8] == 7 and {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(200, 230)} == {50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("digest_bytes,memtable", [(32, 50_000), (1, 3)])
def test_exact_dedup_even_with_colliding_digests(spark, digest_bytes, memtable):
    texts = ODD + sentences(1, 120, 4) + [t.replace(" ", "  ") for t in sentences(1, 60, 4)]
    got = {r["doc_id"]: r for r in exact_dedup.duplicate_classes(documents(spark, texts), digest_bytes, memtable).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append(i)
    for body, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (keep, len(ids), i == keep, hashlib.sha256(body.encode()).hexdigest())


def test_exact_dedup_rows(spark):
    docs = documents(spark, ["a", "a", None, "b"], [5, 5, None, 1])
    assert {(r["doc_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicate_classes(docs).collect()} == {(5, 2, True), (None, 1, True), (1, 1, True)}
    left = exact_dedup.deduplicate(docs)
    assert left.columns == docs.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 5]
    assert exact_dedup.duplicate_classes(docs.limit(0)).count() == 0
    assert left.where("doc_id = 1").first()["_p"] == 0.5


def test_index_over_batches(spark):
    index = exact_dedup.LsmIndex(spark).flush(documents(spark, ["a", "b"]), 1).flush(documents(spark, ["a"], [9]))
    assert index.runs.where("run_filter is not null").count() == index.runs.count() == 3
    sha = [bytes.fromhex(hashlib.sha256(x.encode()).hexdigest()) for x in ("a", "b", "z")]
    assert index.holds(sha) == {sha[0]: True, sha[1]: True, sha[2]: False}
    index = index.compact().flush(documents(spark, ["b", "c", "b"], [4, 5, 6])).compact()
    assert {(r["doc_id"], r["copies"]) for r in index.level.collect()} == {(0, 2), (1, 3), (5, 1)}
    single, maybe = index.probe(documents(spark, ["a", "c", "z"], [20, 21, 22]))
    assert [(r["doc_id"], r["keep_id"], r["body"]) for r in maybe.where("copies is not null").collect()] == [(20, 0, "a")]
    assert single.count() + maybe.where("copies is null").count() == 2


def test_runs_are_sorted_and_bounded(spark):
    runs = exact_dedup.flush_runs(exact_dedup.digested(documents(spark, sentences(2, 50, 3) * 2).coalesce(1), 32), 30).toPandas()
    for _, run in runs.groupby("run", sort=False):
        assert list(run["digest"]) == sorted(run["digest"]) and len(run) <= 30 and run["run_filter"].notna().tolist() == [True] + [False] * (len(run) - 1)
    assert runs["copies"].sum() == 100


def test_only_true_copies_go(spark):
    a, b, c = sentences(33, 3, 40)
    docs = documents(spark, [a, a, b, c, c, "x y", a + " ", "z"], [1, None, None, None, None, 2, 2, 2])
    texts = sorted(r["text"] for r in exact_dedup.deduplicate(docs).collect())
    assert texts == sorted([a + " ", b, c, "x y", "z"])
    near = documents(spark, [a, b, a + " more", c, c], [7, 7, 8, None, 8])
    left = minhash.keep_one_each(near)
    assert left.columns == near.columns and sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(7, a), (7, b), (8, c), (0, c)])


@pytest.mark.parametrize("ids", [[7, 7, 8, 8, 7, None], [1, 2, 3, 4, 5, None]])
def test_keep_one_each_with_clashing_names(spark, ids):
    a, b, c = sentences(34, 3, 40)
    names = ["_id", "_sha", "_no", "_gone", "_row", "row", "id", "sha", "no", "gone", "kept", "class_id", "same"]
    docs = spark.createDataFrame([(i, t, *[f"mine{n}"] * len(names)) for n, (i, t) in enumerate(zip(ids, [a, b, a + " more", c, a, c], strict=True))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = minhash.keep_one_each(docs)
    assert left.dtypes == docs.dtypes and left.exceptAll(docs).count() == 0
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left.collect()) == sorted([(0, c), (ids[0], a), (ids[1], b), (ids[3], c)])


def brute_classes(texts):
    words = [re.findall(r"(?:[a-zA-Z0-9_]|[^\x00-\x7f])+", (t or "").lower()) for t in texts]
    sets = [Counter(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else []) for w in words]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            either = sum((sets[i] | sets[j]).values())
            if (both >= 0.8 * either and either) or (not either and (texts[i] or "") == (texts[j] or "")):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_classes_match_brute_force(spark):
    base, rng = sentences(3, 30), random.Random(4)
    texts = list(ODD)
    for t in base:
        texts.append(t)
        for k in (1, 2, 20):
            w = t.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    # Texts that share a heavy shingle: a mixed bucket with many pairs below the threshold.
    texts += ["the " * (30 + 3 * i) + t for i, t in enumerate(sentences(5, 40, 12))]
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_classes_odd_rows(spark):
    docs = documents(spark, ["one two three four five six", "one two three four five six", None, "x y"], [3, 3, None, 1])
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in minhash.near_classes(docs).collect()) == [(-1, -1, True), (1, 1, True), (3, 3, True), (3, 3, True)]
    left = minhash.keep_one_each(docs)
    assert left.columns == docs.columns and left.count() == 3
    assert minhash.near_classes(docs.limit(0)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8):
        est = []
        for t in range(40):
            n = 200
            same = int(2 * n * share / (1 + share))
            e = rng.integers(0, 2**63, 2 * n - same, dtype=np.uint64)
            w = rng.uniform(0.2, 3.0, len(e))
            a, b = np.arange(n), np.concatenate([np.arange(same), np.arange(n, 2 * n - same)])
            true = w[:same].sum() / w.sum()
            doc = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
            _, s = minhash.dart_minhash(doc, np.concatenate([e[a], e[b]]), np.concatenate([w[a], w[b]]))
            est.append((s[0] == s[1]).mean() - true)
        assert abs(np.mean(est)) < 0.03


def test_quality_keeps_clean_and_rejects_junk(spark):
    clean = [f"{s.capitalize()}." for s in sentences(6, 120, 80)]
    junk = [("Word " * 40 + s) for s in sentences(7, 40, 10)] + [" | ".join(s.split()) for s in sentences(8, 40, 60)] + [s.upper().replace(" ", "!! ") for s in sentences(9, 40, 60)]
    docs = documents(spark, clean + junk + [None, ""])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240) if i % 2] + [(1, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 242
    wrong = [r["doc_id"] for r in got if r["doc_id"] < 240 and r["kept"] != (r["doc_id"] < 120)]
    assert len(wrong) <= 4 and not any(i < 120 for i in wrong)
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == kept.where("_p = 0.5").count() == 242
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_sparse_sites_shrink_toward_their_prior(spark):
    rows = [("big", "p", 900.0, 1000), ("bad", "p", 100.0, 1000), ("bad", "tiny", 1.0, 1), ("new", "q", 0.0, 1), (None, None, 5.0, 10)]
    got = {(r["host"], r["path"]): r for r in quality.shrink(spark.createDataFrame(rows, "host string, path string, good double, n long")).collect()}
    assert got["big", "p"]["site_rate"] > 0.85 and got["bad", "p"]["site_rate"] < 0.15
    assert got["new", "q"]["host_rate"] > 0.1 and got["bad", "tiny"]["site_rate"] < 0.9 and len(got) == 5


def test_shrinking_by_plain_loops(spark):
    """Posteriors of many uneven sites, null ones included, against the formulas over dictionaries."""
    rng, rows = random.Random(64), []
    for host in [None, "", *(f"h{i}" for i in range(20))]:
        rate = rng.random()
        for path in [None, *(f"p{i}" for i in range(rng.randrange(1, 5)))]:
            n = rng.choice([1, 2, 10, 500])
            rows.append((host, path, float(sum(rng.random() < rate for _ in range(n))), n))

    def strength(sites, overall):  # sites: (good, documents, the rate they are held against)
        n, chance = sum(x for _, x, _ in sites), overall * (1 - overall)
        spread = sum(x * (g / x - r) ** 2 for g, x, r in sites)
        between = (spread - (len(sites) - 1) * chance) / (n - sum(x * x for _, x, _ in sites) / n)
        return max(1.0, chance / between - 1) if between > 0 else 1e6

    overall, hosts = sum(r[2] for r in rows) / sum(r[3] for r in rows), {}
    for host, _, good, n in rows:
        g, x = hosts.get(host, (0.0, 0))
        hosts[host] = (g + good, x + n)
    k = strength([(g, x, overall) for g, x in hosts.values()], overall)
    host_rate = {h: (g + k * overall) / (x + k) for h, (g, x) in hosts.items()}
    k = strength([(g, n, host_rate[h]) for h, _, g, n in rows], overall)
    got = {(r["host"], r["path"]): r for r in quality.shrink(spark.createDataFrame(rows, "host string, path string, good double, n long")).collect()}
    assert len(got) == len(rows)
    for host, path, good, n in rows:
        r = got[host, path]
        assert abs(r["host_rate"] - host_rate[host]) < 1e-9 and abs(r["site_rate"] - (good + k * host_rate[host]) / (n + k)) < 1e-9


def test_site_evidence_turns_decisions(spark):
    """Documents of one text are kept at a good site and rejected at a bad one."""
    plain = [f"{s.capitalize()}." for s in sentences(61, 150, 80)]
    junk = [" | ".join(s.split()) for s in sentences(62, 150, 60)]
    doubtful = " ".join(plain[0].split()[:40]) + " " + " | ".join(junk[0].split(" | ")[:14])
    rows = [(i, t, "en", "good", 0) for i, t in enumerate(plain)] + [(200 + i, t, "en", "bad", 0) for i, t in enumerate(junk)]
    rows += [(1000 + i, doubtful, "en", site, 0) for i, site in enumerate(["good"] * 3 + ["bad"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _host int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 150, 2)] + [(200 + i, 0, 0) for i in range(0, 150, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len({got[1000 + i]["doc_p"] for i in range(6)}) == 1
    assert [got[1000 + i]["score"] > got[1003 + i]["score"] for i in range(3)] == [True] * 3
    assert got[1000]["site_rate"] > 0.9 > 0.2 > got[1003]["site_rate"]
    assert [got[1000 + i]["kept"] for i in range(6)] == [True] * 3 + [False] * 3
    assert quality.keep_good(docs, labels).where("_host = 0").count() == sum(r["kept"] for r in got.values())


def plain_rake(cells, wants, rounds=500):
    """Iterative proportional fitting over dictionaries."""
    raked = dict(cells)
    for _ in range(rounds):
        for m in range(3):
            have = Counter()
            for cell, x in raked.items():
                have[cell[m]] += x
            raked = {cell: x * wants[m][cell[m]] / have[cell[m]] for cell, x in raked.items()}
    return raked


def test_raking_matches_plain_loops(spark):
    rng = random.Random(63)
    cells = {(s, g, t): rng.randrange(1, 1000) for s in "abcde" for g in "xyz" for t in "12" if rng.random() < 0.9}
    total, frame = sum(cells.values()), pd.DataFrame([(*c, n) for c, n in cells.items()], columns=["source", "lang", "topic", "tokens"])
    given = {"lang": {"x": 2, "y": 1, "z": 1, "absent": 5}}
    wants = []
    for m in range(3):
        have = Counter()
        for cell, n in cells.items():
            have[cell[m]] += n
        part = given["lang"] if m == 1 else {v: n**0.9 for v, n in have.items()}
        wants.append({v: part[v] / sum(part[u] for u in have) * total for v in have})
    want = plain_rake(cells, wants)
    got = mixing.rake(frame, given)
    assert all(abs(r.raked - want[r.source, r.lang, r.topic]) < 1e-3 for r in got.itertuples())
    spread = mixing.rake_distributed(spark.createDataFrame(frame), given, rounds=30).toPandas()
    assert all(abs(r.raked - want[r.source, r.lang, r.topic]) < 1 for r in spread.itertuples())
    kept = mixing.rake(frame, {}, keep=0.75)
    by_joins = mixing.rake_distributed(spark.createDataFrame(frame), {}, keep=0.75, rounds=12).toPandas()
    plainly = {(r.source, r.lang, r.topic): r.raked for r in mixing.rake(frame, {}, keep=0.75).itertuples()}
    assert all(abs(r.raked - plainly[r.source, r.lang, r.topic]) < 1 for r in by_joins.itertuples())
    assert (kept["raked"] <= kept["tokens"]).all() and abs(kept["raked"].sum() - 0.75 * total) < 0.02 * total
    assert np.allclose(mixing.filled(np.array([4.0, 1, 1, 0]), np.array([1.0, 10, 10, 5]), 9.0), [1, 4, 4, 0])


def test_topics_tell_vocabularies_apart():
    own = [sentences(70 + i, 1, 40)[0].split() for i in range(4)]
    rng = random.Random(71)
    texts = [" ".join(rng.choice(own[i % 4]) for _ in range(60)) for i in range(400)]
    counts = mixing.word_counts(texts)
    got = mixing.fit_topics(counts, 4).topics(counts)
    assert len({(i % 4, t) for i, t in enumerate(got)}) == 4


@pytest.mark.parametrize("wants, keep", [({"source": {"a": 9, "b": 1, "c": 1, None: 0.5}}, 0.75), ({"source": {"a": 1}}, 0.9), ({}, 1.0), ({}, None)])
def test_targets_as_tables_are_those_on_the_driver(spark, wants, keep):
    have = {"a": 10, "b": 1000, "c": 30, "d": 7, mixing.NONE: 400}
    cells = spark.createDataFrame([(v, "x", "1", n) for v, n in have.items()], "source string, lang string, topic string, tokens long")
    sums = pd.DataFrame({"value": list(have), "have": list(have.values())})
    want = dict(mixing.margin_targets(sums, "source", wants, 0.9, keep)[["value", "want"]].itertuples(index=False, name=None))
    got = {r["source"]: r["want"] for r in mixing.wanted(cells, "source", wants, 0.9, keep).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-6 for v in want)


def test_topics_are_fitted_on_all_documents(spark):
    """EM over the cluster equals plain EM over all counts, however the rows lie."""
    own = [sentences(80 + i, 1, 40)[0].split() for i in range(3)]
    rng = random.Random(81)
    texts = [" ".join(rng.choice(own[i % 3]) for _ in range(60)) for i in range(300)] + ["", None]
    counts = mixing.word_counts([t or "" for t in texts])
    packed = mixing.packed_counts(counts)
    assert (mixing.unpacked(packed) == counts).all()
    hashes = [rng.randrange(-(1 << 63), 1 << 63) for _ in texts]
    rows = spark.createDataFrame(list(zip(hashes, packed, strict=True)), "h long, counts binary")
    got = mixing.learn_topics(rows, start_docs=30)
    again = mixing.learn_topics(rows.repartition(7), start_docs=30)
    assert (got.prior == again.prior).all() and (got.words == again.words).all()
    full, first = counts[counts.sum(axis=1) > 0], [i for i in sorted(range(len(texts)), key=lambda i: hashes[i]) if texts[i]][:30]
    model = mixing.fit_topics(counts[first])
    for _ in range(mixing.EM_ROUNDS):
        units = [[round(mixing.SHARE * x) for x in row] for row in model.shares(full)]
        docs = [sum(u[t] for u in units) / mixing.SHARE for t in range(len(model.prior))]
        words = [[sum(u[t] * n for u, n in zip(units, column, strict=True)) / mixing.SHARE for column in full.T] for t in range(len(model.prior))]
        before, model = model, mixing.estimated(np.array(docs), np.array(words))
        if np.abs(np.exp(model.prior) - np.exp(before.prior)).sum() < mixing.EM_MOVED:
            break
    order = sorted(range(len(model.prior)), key=lambda t: (-model.prior[t], t))
    assert np.allclose(got.words, model.words[order], atol=1e-8) and np.allclose(got.prior, model.prior[order], atol=1e-8)
    assert mixing.learn_topics(rows.limit(0)) is None
    assert mixing.learn_topics(spark.createDataFrame([(1 << 62, packed[0])] * 200, rows.schema), start_docs=30) is not None


def test_mixing_by_plain_computation(spark):
    """Topics, tokens, targets, raking and draws of the whole query, by loops."""
    texts = ODD + sentences(90, 150, 20) + [s * 30 for s in sentences(91, 20, 20)] + ["word " * 4_000_000]
    docs = documents(spark, texts)
    rows = {r["doc_id"]: r for r in mixing.sampled_rows(docs).collect()}
    counts = mixing.word_counts([t or "" for t in texts])
    hashes = [r["h"] for r in docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h")).collect()]
    model = mixing.learn_topics(spark.createDataFrame(list(zip(hashes, mixing.packed_counts(counts), strict=True)), "h long, counts binary"))
    cells, place = Counter(), {}
    for r in docs.select("doc_id", "source", "lang").collect():
        i = r["doc_id"]
        topic = f"topic {model.topics(counts[i:i + 1])[0]}" if counts[i].any() else "none"
        place[i] = (r["source"] or mixing.NONE, r["lang"] or mixing.NONE, topic)
        assert rows[i]["topic"] == topic and rows[i]["tokens"] == max(1, len((texts[i] or "").split()))
        cells[place[i]] += rows[i]["tokens"]
    raked, wants = {cell: float(n) for cell, n in cells.items()}, []
    for m in range(3):
        have = Counter()
        for cell, n in cells.items():
            have[cell[m]] += n
        wants.append(dict(zip(have, mixing.filled(np.array([n**0.9 for n in have.values()]), np.array([float(n) for n in have.values()]), 0.75 * sum(have.values())), strict=True)))
    for _ in range(mixing.ROUNDS):
        for m in range(3):
            have = Counter()
            for cell, x in raked.items():
                have[cell[m]] += x
            raked = {cell: min(float(cells[cell]), x * wants[m][cell[m]] / have[cell[m]] if have[cell[m]] else 0.0) for cell, x in raked.items()}
    for i, r in rows.items():
        assert abs(r["prob"] - raked[place[i]] / cells[place[i]]) < 1e-4
    draws = {r["doc_id"]: r["d"] for r in docs.select("doc_id", mixing.draw(F.col("doc_id"), F.coalesce("text", F.lit("")), 17).alias("d")).collect()}
    assert all(r["kept"] == (draws[i] < r["prob"]) for i, r in rows.items()) and len(rows) == len(texts)


def test_mixing_meets_targets(spark):
    docs = documents(spark, ODD + sentences(10, 400, 20) + [s * 30 for s in sentences(11, 20, 20)]).withColumnRenamed("digest", "_lang")
    targets = {"source": {"s0": 3, "s1": 1, "s2": 1, None: 1}}
    rows = mixing.mix(docs.select("doc_id", "text", "source", "lang"), targets).drop("row").toPandas()
    share = (rows["weight"] * rows["tokens"]).groupby(rows["source"]).sum() / (rows["weight"] * rows["tokens"]).sum()
    assert abs(share["s0"] - 0.5) < 1e-6 and abs(share[mixing.NONE] - 1 / 6) < 1e-6 and rows["prob"].max() == 1.0
    assert set(rows["topic"]) > {"none"}
    kept = mixing.keep_sampled(docs)
    assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count() and kept.first()["_lang"] == "x"
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in mixing.keep_sampled(docs.repartition(7)).collect())
    assert mixing.sampled_rows(docs.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe_chunks.VOCABULARY))
    rng = random.Random(12)
    alphabet = list("ab '\n  rés!1\t.") + ["the ", "'re", "\n\n", "<|endoftext|>", "漢", "😀"]
    shared = "".join(rng.choice(alphabet) for _ in range(6000))
    texts = list(ODD) + ["<|endoftext|>", "a\u2028 b"]
    for _ in range(80):
        a, noise = rng.randrange(5000), ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(2)]
        texts.append(noise[0] + shared[a:a + rng.randrange(3000)] + noise[1])
    got = {r["doc_id"]: r for r in bpe_chunks.encode_documents(documents(spark, texts), with_ids=True).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe_chunks.encode_documents(documents(spark, texts).limit(0)).count() == 0


def brute_lines(texts, min_lines=3, min_words=10):
    sequence, stop = [], []
    for i, t in enumerate(texts):
        own = [(i, n, s) for n, line in enumerate((t or "").split("\n")) if (s := line.strip())]
        stop += [len(sequence) + len(own)] * len(own)
        sequence += own
    gone, seen, runs = set(), set(), set()
    for p, (_, _, line) in enumerate(sequence):
        if line in seen and len(line.split()) >= min_words:
            gone.add(p)
        seen.add(line)
        if p + min_lines <= stop[p]:
            key = tuple(x[2] for x in sequence[p:p + min_lines])
            if key in runs:
                gone.update(range(p, p + min_lines))
            runs.add(key)
    out = {i: [] for i in range(len(texts))}
    for p in sorted(gone):
        out[sequence[p][0]].append(sequence[p][1])
    return out


def brute_longest(texts):
    """By document the most lines in a row that also stand elsewhere, by comparing all places."""
    sequence, doc = [], []
    for i, t in enumerate(texts):
        own = [s for line in (t or "").split("\n") if (s := line.strip())]
        sequence += own
        doc += [i] * len(own)
    out = dict.fromkeys(range(len(texts)), 0)
    for p in range(len(sequence)):
        for r in range(p):
            n = 0
            while p + n < len(doc) and doc[p + n] == doc[p] and doc[r + n] == doc[r] and sequence[p + n] == sequence[r + n]:
                n += 1
            out[doc[p]], out[doc[r]] = max(out[doc[p]], n), max(out[doc[r]], n)
    return out


def test_runs_of_repeated_lines_end_with_their_documents():
    """Marked for a whole batch at once: documents without lines or hits among them, none at all too."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        offsets = np.append(0, np.cumsum(rng.integers(0, 5, rng.integers(0, 6))))
        hit = rng.random(offsets[-1]) < 0.6
        want = []
        for d, (first, last) in enumerate(zip(offsets, offsets[1:])):
            for i in np.flatnonzero(hit[first:last]) + first:
                want.append((i, d, next((j for j in range(i, last) if not hit[j]), last)))
        assert list(zip(*line_runs.hit_runs(hit, offsets), strict=True)) == want
    assert [len(x) for x in line_runs.line_keys([])] == [0, 0]


def test_line_runs_match_brute_force(spark):
    rng = random.Random(13)
    lines = sentences(14, 12, 3) + sentences(15, 6, 14) + ["", "  "]
    texts = list(ODD) + ["\n".join(rng.choice(lines) for _ in range(rng.randrange(14))) for _ in range(80)] + ["\n".join(["same"] * 9), "\n".join(lines), "\n".join(lines)]
    docs = documents(spark, texts)
    got = {r["doc_id"]: r for r in line_runs.dedup_runs(docs).collect()}
    want = brute_lines(texts)
    assert {i: r["removed"] for i, r in got.items()} == want
    assert {i: r["longest"] for i, r in got.items()} == brute_longest(texts)
    cut = {r["doc_id"]: r["text"] for r in line_runs.dedup_lines(docs).collect()}
    assert cut[10] == "\n".join(x for n, x in enumerate(texts[10].split("\n")) if n not in want[10]) and cut[0] == ""
    for m in (1, 5):
        assert {r["doc_id"]: r["removed"] for r in line_runs.dedup_runs(docs, m, 99).collect()} == brute_lines(texts, m, 99)
    assert line_runs.removed_lines(docs.limit(0)).count() == 0
    assert line_runs.removed_lines(documents(spark, ["a", "a", None], [1, 1, None])).count() == 2


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>m</ul></nav>
<div class="cookie-notice">We use</div>%s<footer>&copy; x</footer></body></html>"""
ARTICLE = """<div class="post-7 entry"><h2>T &amp; x</h2><p>Hello   <b>wor</b>ld<br>and more text that runs on and on for a while<ul><li>a<li>b</ul><form>f<input></form>
<div class="ad">buy</div><p>End &eacute;&#233; &am</div><section class="comments"><p>nice comment</p></section><aside>s</aside>"""


def test_html_consensus(spark):
    rows = [(i, "http://A.org/x", PAGE % ARTICLE) for i in range(3)] + [(3, "http://a.org/y", PAGE % ("<div class='links'><p>" + "long other text " * 40 + "</p></div>" + ARTICLE)), (4, None, None), (5, "u", ""), (6, "http://b.org", "plain <b>text"), (7, "http://b.org", "<p>a<p>b<script>x")]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", __import__("pyspark").sql.functions.lit("clash"))).collect()}
    want = "T & x\n\nHello world and more text that runs on and on for a while\n\na\n\nb\n\nEnd éé &am"
    assert [got[i]["text"] for i in range(8)] == [want, want, want, want, "", "", "plain text", "a\n\nb"]
    assert got[0]["n_chars"] == len(want) and got[3]["path"] == "div.entry.post-"
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_keeps_unequal_parts_under_one_parent():
    lead, story = "lead " * 40, "story " * 50
    page = PAGE % f'<div class="post"><div class="lead"><p>{lead}</p></div><div class="story"><p>{story}</p></div></div>'
    assert html_extract.vote(page) == "div.post"
    for winning in ("div.post", None):
        assert html_extract.extract(page, winning)[0] == f"{lead.strip()}\n\n{story.strip()}"


@pytest.mark.parametrize("name", ["has-sidebar", "content no-sidebar", "post comments-open", "entry-header", "related-topics", "legal-news", "skip", "comments"])
def test_html_no_class_costs_a_page_its_text(name):
    text = "long text " * 30
    page = PAGE % f'<div class="{name}"><h1>T</h1><p>{text}</p></div>'
    assert html_extract.extract(page, html_extract.vote(page))[0] == f"T\n\n{text.strip()}"


def test_html_leaves_out_long_comments_and_keeps_labels():
    page = PAGE % f'<article><h1>T</h1><p>{"own " * 40}</p><label>kept</label><div class="comments"><p>{"said " * 200}</p></div><form><label>gone</label></form></article>'
    assert html_extract.extract(page, None)[0] == f"T\n\n{('own ' * 40).strip()}\n\nkept"


def test_html_host_decides_against_the_page(spark):
    """Pages of one host whose own best container is another one."""
    def page(i, story, aside):
        return PAGE % f'<div class="wrap"><section class="s{i}">{story}<p>Follow us there</p></section></div><div class="teaser">{aside}</div>'

    rng, said = random.Random(50), sentences(50, 40, 30)
    rows = [(i, "https://h.org/x", page(i, f"<p>{said[i]}</p><p>{said[i + 1]}</p>", "")) for i in range(12)]
    # An article-like second part, longer than the first: alone, the page would choose them both.
    rows += [(12 + i, "https://h.org/y", page(i, f"<p>{said[20 + i]}</p>", f"<p>{said[30 + i]} {said[31 + i]}</p>")) for i in range(3)]
    rng.shuffle(rows)
    assert html_extract.vote(next(h for i, _, h in rows if i == 12)) != html_extract.vote(next(h for i, _, h in rows if i == 3)) == "div.wrap/section.s"
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # A block that all pages repeat stays: recurring alone makes nothing boilerplate.
    assert [got[i] for i in range(12)] == [f"{said[i]}\n\n{said[i + 1]}\n\nFollow us there" for i in range(12)]
    assert [got[12 + i] for i in range(3)] == [f"{said[20 + i]}\n\nFollow us there" for i in range(3)]


@pytest.mark.parametrize("n", [9, 12, 1000])
def test_html_keeps_headings_that_all_pages_have(spark, n):
    said = sentences(60, 40, 20)
    page = "<html><body><nav>m</nav><article><h1>%s</h1><h2>Ingredients</h2><p>%s</p><h2>Method</h2><p>%s</p></article></body></html>"
    rows = [(i, "http://cook.org/x", page % (f"Dish {i}", said[i % 40], said[(i * 7 + 1) % 40])) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Dish {i}\n\nIngredients\n\n{said[i % 40]}\n\nMethod\n\n{said[(i * 7 + 1) % 40]}" for i in range(n))


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("item", ["<article><p>%s</p>{}</article>", "<article><p>%s</p></article>{}", "<div><p>%s</p></div>{}", "<main><h1>%s</h1>{}</main>"])
def test_html_long_threads_footers_and_notices_go(item, inside):
    story, said = "A short story that says what there is to say. " * 5, "<p>" + "I have an opinion on this. " * 3 + "</p>"
    for tail in (f'<div class="comments">{said * 60}</div>', f"<ol class='comment-list'><li><article class='comment-body'>{said * 60}</article></ol>", f"<footer>{said * 40}</footer>",
                 f'<div class="cookie-notice">{said * 40}</div>', f'<aside>{said * 40}</aside>', f'<div id="disqus_thread">{said * 40}</div>'):
        page = PAGE % (item.format(tail) if inside else item.format("") + tail)
        page = page.replace("%s", story)
        for winning in (None, html_extract.vote(page)):
            assert html_extract.extract(page, winning)[0] == story.strip()


def test_html_wrappers_with_an_articles_head_stay():
    text = "long text " * 30
    for page in (f'<div class="sidebar-layout"><article><p>{text}</p></article></div>', f'<form id="form1"><div class="related"><h1>T</h1><p>{text}</p></div><div class="comments"><p>{text * 20}</p></div></form>'):
        got = html_extract.extract(PAGE % page, None)[0]
        assert got.removeprefix("T\n\n") == text.strip()


def test_html_classes_with_slashes_vote_and_are_found(spark):
    said = sentences(61, 12, 40)
    page = '<html><body><div class="md:w-1/2 50%%"><p>%s</p></div><div class="teaser"><p>%s</p></div></body></html>'
    rows = [(i, "http://s.org", page % (said[i], "" if i < 10 else said[i] + " " + said[i - 1])) for i in range(12)]
    assert len(html_extract.at_path(html_extract.parse(rows[0][2]), html_extract.vote(rows[0][2]))) == 1
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(12)] == said


@pytest.mark.parametrize("page", ['<a ' * 100_000 + '"', "<ul>" * 40_000 + "<tr>" * 40_000, '<a x=">" ' * 35_000, "<a x='" * 50_000, "<p class=\"x\"\">" * 20_000, "<script>" * 40_000, "<li><table>" * 25_000,
                                  "<dl>" * 30_000 + "<dt>a<dd>" * 20_000, "<select>" * 20_000 + "<option>" * 20_000, "</p>" * 70_000, "<!--" * 70_000, "<textarea><title>" * 15_000, "= \"" * 90_000, "<a =" + " " * 290_000])
def test_html_parses_hostile_pages_in_linear_time(page):
    start = time.time()
    html_extract.extract("<p>before</p>" + page, None)
    assert time.time() - start < 2


def test_html_equals_the_pages_own_articles(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    got, equal = html_extract.extract_pages(pages).select("page_id", "text", "n_chars").toPandas().set_index("page_id"), 0
    for row in pages.toPandas().itertuples():
        inside = re.search(r"(?s)<article>(.*?)</article>", row.html).group(1)
        parts = re.split(r"</?(?:h1|p)>", inside.replace("<br>", " "))
        cleaned = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in parts]
        equal += got.loc[row.page_id, "text"] == "\n\n".join(x for x in cleaned if x)
    assert equal == len(got) == 2500


def test_html_parses_deep_and_broken_pages():
    start = time.time()
    assert html_extract.extract("<div>" * 100_000 + "deep" + "</p></div>", None)[0] == "deep"
    assert html_extract.extract("<div><div class='ad'>" * 20_000 + "<p>x" * 20_000, None)[0] and time.time() - start < 10
    assert html_extract.extract("<article><p>a <i>b</i>c<script>if (a<b) {'</p>'}</script> d</article>", None)[0] == "a bc d"
    assert html_extract.extract("a < b <c", None)[0].startswith("a < b")
    assert html_extract.extract("<table><tr><td>a<td>b<tr><td>c<ul><li>d<li>e</table>f", None)[0] == "a\n\nb\n\nc\n\nd\n\ne\n\nf"


def test_patterns_match_the_plain_ones():
    plain = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]

    def luhn(d):
        total = 0
        for i, c in enumerate(reversed(d)):
            v = int(c) * (1 + i % 2)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    def brute(t):
        out = []
        for k, p in enumerate(plain):
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m.group())
                if k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn(d) or k == 3 and 9 <= len(d) <= 15:
                    out.append((m.start(), k, m.end()))
        return sorted(out)

    rng = random.Random(16)
    for _ in range(4000):
        t = "".join(rng.choice("a@.-+ 0123456789%()b") for _ in range(rng.randrange(60)))
        assert sanitize.pattern_spans(t) == brute(t)
    t = "4111 1111 1111 1111, a.b@c.d.e, 1.2.3.4 and +1 (555) 123-4567 é 256.1.1.1"
    assert sanitize.pattern_spans(t) == brute(t) and len(brute(t)) == 4


def test_disclosing_terms(spark):
    filler = sentences(17, 400, 12)
    texts = [f"{filler[i]} zanzibari {filler[i + 50].split()[0]} a@b.org {filler[i + 100]}" for i in range(20)] + filler[150:] + ["Only the Zanzibari was seen", None, ""]
    got = {r["doc_id"]: r for r in sanitize.personal_data(documents(spark, texts)).collect()}
    assert got[0]["n_email"] == 1 and got[0]["n_term"] == 1 and got[len(texts) - 3]["spans"] == "remove:9:18" and got[0]["n_spans"] == 2 and got[30]["spans"] == ""
    assert got[0]["base_sha256"] != got[30]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in sanitize.sanitize(documents(spark, texts)).collect()}
    assert "[EMAIL]" in clean[0] and "anzibari" not in clean[0] + clean[len(texts) - 3] and clean[len(texts) - 1] == ""
    assert sanitize.personal_data(documents(spark, texts).limit(0)).count() == 0


def test_disclosure_over_whole_texts_and_copies(spark):
    filler = sentences(31, 500, 30)
    far = [f"Ng holds badge E1234. {filler[i]} write to far@b.org" for i in range(6)]
    signed = [f"{filler[i]} Regards Quill sig@b.org" for i in range(20, 60)]
    copied = [f"Wexford {filler[i]} cop@b.org" for i in range(100, 103)]
    texts = far + signed + copied + [copied[0]] * 60 + filler[150:] + ["ng e1234 quill wexford"]
    got = {r["doc_id"]: r for r in sanitize.sanitize(documents(spark, texts)).collect()}
    assert not {"ng", "e1234", "quill", "wexford"} & set(got[len(texts) - 1]["text"].split())
    for i, word in [(0, "Ng"), (0, "E1234"), (20, "Quill"), (46, "Wexford"), (60, "Wexford")]:
        assert word not in got[i]["text"].split(), (i, word)
    assert got[len(texts) - 2]["text"] == texts[-2]


def test_sanitize_goes_by_rows(spark):
    texts = ["mail a@b.org now", "card 4111 1111 1111 1111 of", "other text x@y.org here", "x@y.org and more", None]
    got = sanitize.sanitize(documents(spark, texts, [None, None, 7, 7, 7])).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == [(0, "card [CARD] of"), (0, "mail [EMAIL] now"), (7, ""), (7, "[EMAIL] and more"), (7, "other text [EMAIL] here")]


def brute_levels(texts):
    """Disclosure of every word of the corpus, by plain loops over distinct texts."""
    held = []
    for text in set(texts):
        spans = sorted(sanitize.pattern_spans(text) + sanitize.key_spans(text))
        words = {m.group().lower() for m in re.finditer(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", text) if not any(a < m.end() and m.start() < b for a, _, b in spans)}
        held.append((words, {m.group().lower() for m in re.finditer(r"(?:[A-Za-z0-9_]|[^\x00-\x7f])+", text)}, {text[a:b].lower() for a, _, b in spans} | {k for _, k, _ in spans}))
    n, out = len(held), {}
    for e in set().union(*(x[2] for x in held)):
        n_e = sum(e in x[2] for x in held)
        for t in set().union(*(x[0] for x in held if e in x[2])):
            n_t, n_both = sum(t in x[1] for x in held), sum(e in x[2] and t in x[0] for x in held)
            pmi = np.log(n_both * n / (n_t * n_e))
            if n_both >= 3 and n > n_e and n_both * pmi >= np.log(n / 0.01) - 1e-9:
                out[t] = max(out.get(t, 0), pmi / np.log(n / n_e))
    return {t: x for t, x in out.items() if x >= 0.9}


@pytest.mark.parametrize("seed", [1, 2])
def test_disclosure_levels_match_brute_force(spark, seed):
    rng, words = random.Random(seed), sentences(40, 1, 60)[0].split()
    values = ["a@b.org", "c@d.org", "10.0.0.7", "9b0b3c6a43eb78aa99cb7049c5"]
    texts = []
    for i in range(300):
        own = [rng.choice(words) for _ in range(12)]
        if i % 6 == 0:
            v = rng.randrange(5)
            own += [values[v] if v < 4 else f"user{i}@mail.org"] + ["quux"] * (rng.random() < 0.9) + [f"near{v}"] * (rng.random() < 0.8) + ["hinted"] * (v == 4)
        elif rng.random() < 0.02:
            own += [f"near{rng.randrange(5)}"]
        rng.shuffle(own)
        texts += [" ".join(own)] * (1 + 40 * (i == 12))
    want = brute_levels(texts)
    got = sanitize.disclosures(documents(spark, texts).select("doc_id", "text")).toPandas()
    known = {k: w for w, k in zip(sorted(want), sanitize.term_keys(sorted(want)), strict=True)}
    assert {known.get(k, k): round(x, 9) for k, x in zip(got["term"], got["level"], strict=True)} == {w: round(x, 9) for w, x in want.items()} and "hinted" in want


@pytest.mark.parametrize("rules", [url_filter.RULES, [("block", "b.example", "/x"), ("allow", "example", "/xyz"), ("block", "example", ""), ("allow", "a.b.example", ""), ("block", "example", "/xyz")], []])
def test_url_filter(spark, rules):
    rng = random.Random(18)
    hosts = ["x.net", "net", "a.example.net", "example.com", "EXAMPLE.com", "q.org", "b.example", "a.b.example", "example", "sub.a.b.example", "xexample", ""]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/a', '/de/', '/fr/x?y', '/x', '/xyz1', '?q', '#f', '/xy'])}" for _ in range(300)] + [None, "", "nothing", "a://b://c/d", "://net/"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(rows, rules).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(len(h + p), len(h), v == "block", h + p) for v, h, p in rules if m and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else None
        blocked = best and any(v == "block" and h + p == best[3] for v, h, p in rules)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        assert (got[i]["rule"], got[i]["verdict"]) == (best and best[3], "block" if blocked else "allow"), url
    assert url_filter.filter_urls(rows.limit(0), rules).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) as key")
    listed = [f"k{i}" for i in range(0, 20_000, 37)] + ["not in the corpus"]
    cascade = url_filter.build_cascade(universe, spark.createDataFrame([(k,) for k in listed], "key string"))
    F = __import__("pyspark").sql.functions
    rows = universe.select("key", url_filter.key_hash(F.col("key"), 0).alias("a"), url_filter.key_hash(F.col("key"), 1).alias("b")).toPandas()
    inside = cascade.contains(rows["a"].to_numpy().view(np.uint64), rows["b"].to_numpy().view(np.uint64))
    assert set(rows["key"][inside]) == set(listed) - {"not in the corpus"} and len(cascade.levels) > 1


def test_nearest_vectors(spark):
    rng = np.random.default_rng(19)
    points = np.concatenate([rng.normal(size=(1500, 16)), rng.normal(size=(700, 16)) * 0.05 + 1, np.repeat(rng.normal(size=(1, 16)), 60, axis=0)]).astype(np.float32)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(points)] + [(9000, None, 0), (9020, [0.0] * 16, 0), (9040, [float("nan")] * 16, 0), (9060, [None] * 16, 0), (9080, [], 0), (None, [1.0] * 16, 0), (9100, [float("inf")] * 16, 0)]
    rows.append(rows[20])
    got = nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas()
    exact = points.astype(float)
    hit = total = 0
    for q, own in got.groupby("query_id"):
        score = (exact * exact[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(score)), -score))[:20]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(own["score"], score[own["vec_id"]], rtol=0, atol=0)
        assert list(zip(-own["score"], own["vec_id"])) == sorted(zip(-own["score"], own["vec_id"]))
        hit, total = hit + len(set(best) & set(own["vec_id"])), total + 20
    assert got["query_id"].nunique() == len(points) // 20 and hit / total >= 0.9
    few = nearest_vectors(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>, label int")).toPandas()
    assert len(few) == 4 and nearest_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert isinstance(got, pd.DataFrame)


def test_nearest_vectors_probe_as_learned_and_until_there_are_enough(spark, monkeypatch):
    points = np.random.default_rng(22).normal(size=(600, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    few = nearest_vectors(rows, parts=40, probes=1).toPandas()
    assert few.groupby("query_id").size().to_dict() == dict.fromkeys(range(0, 600, 20), 20)
    learn = ann_partitions.learn
    monkeypatch.setattr(ann_partitions, "learn", lambda *a: (learn(*a)[0], 1))
    got = nearest_vectors(rows, parts=4).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        score = points @ points[q]
        score[q] = -np.inf
        hit += len(set(np.argsort(-score)[:20]) & set(own["vec_id"]))
    assert len(got) == 600 and hit < 600
    tiny = nearest_vectors(rows.limit(21)).toPandas()
    assert sorted(tiny.groupby("query_id").size()) == [20] * tiny["query_id"].nunique()


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_nearest_vectors_on_many_rows(spark, kind):
    """20,000 rows: recall, and the share of all pairs that was scored; vectors spread evenly cannot be cut well."""
    rng, n, width = np.random.default_rng(23), 20_000, 24
    points = rng.normal(size=(n, width)) * (0.25 if kind == "clustered" else 1) + (rng.normal(size=(60, width))[rng.integers(0, 60, n)] if kind == "clustered" else 0)
    points = ann_partitions.unit_rows(points)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points)], "vec_id long, embedding array<double>")
    got = nearest_vectors(rows).toPandas()
    hit = 0
    for q, own in got.groupby("query_id"):
        score = points @ points[q]
        score[q] = -np.inf
        hit += len(set(np.argpartition(-score, 20)[:20]) & set(own["vec_id"]))
    recall, share = hit / (20 * n / 20), got.groupby("query_id")["scored"].first().mean() / n
    print(f"{kind}: recall {recall:.3f}, {share:.2f} of all pairs scored")
    assert len(got) == n and recall >= 0.9 and share < (0.4 if kind == "clustered" else 0.95)


def test_near_copies_of_one_text_in_few_pairs(spark):
    """A group whose members often fail with its smallest member but meet through others."""
    rng, base = random.Random(20), sentences(21, 1, 120)[0].split()
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("tile", [512, 24])
def test_near_classes_of_groups_on_both_sides_of_the_threshold(spark, monkeypatch, tile):
    """Large mixed buckets: the classes are those of all pairs, however the members are dealt into tiles."""
    monkeypatch.setattr(minhash, "TILE_ROWS", tile)
    rng, base = random.Random(5), sentences(6, 2, 150)
    texts = []
    for n in range(360):
        w = base[n % 2].split()
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(50)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_classes(documents(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_a_tile_gives_a_forest():
    rng = np.random.default_rng(30)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    keys = [np.sort(np.concatenate([base[:-3], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for _ in range(40)]
    marks = np.tile(rng.integers(0, 2**16, 125).astype("<u2"), (40, 1))
    tile = minhash.Tile(np.arange(40), np.arange(40), np.arange(40) > 0, marks, keys, 5)
    links = tile.links(np.arange(1, 40), np.arange(40), 0, 80, 0.8)
    assert len(links) == 39 and len({x for link in links for x in link}) == 40
    assert minhash.Tile(np.arange(40), np.arange(40), np.arange(40) > 0, marks, keys, 5).links(np.arange(1, 40), np.arange(40), 1, 80, 0.8) == []


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = " ".join(sentences(32, 40, 40)) + " é😀" + "x" * 9000
    whole = minhash.weighted_set([text, "a b", text])
    signature = minhash.dart_minhash(*whole)[1]
    monkeypatch.setattr(minhash, "SLICE", 100)
    monkeypatch.setattr(minhash, "STRIPS", 64)
    pieces = minhash.weighted_set([text, "a b", text])
    assert all((x == y).all() for x, y in zip(whole, pieces, strict=True)) and (minhash.dart_minhash(*pieces)[1] == signature).all()


@pytest.mark.parametrize("operator", ["exact_dedup", "line_runs", "minhash"])
def test_hot_keys_are_split(spark, operator):
    """With thresholds to match a small table, adaptive execution splits the joins of a key that holds most rows."""
    low = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
           "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    own = sentences(90, 300, 14)
    texts = [own[0]] * 900 + own if operator != "line_runs" else ["\n".join([own[0], own[1 + i % 250], own[2 + i % 250]]) for i in range(900)]
    docs = documents(spark, texts).repartition(6)
    run = {"exact_dedup": exact_dedup.duplicate_classes, "line_runs": line_runs.removed_lines, "minhash": minhash.near_classes}[operator]
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda: [plans.apply(i) for plans in [store.executionsList()] for i in range(plans.size())]
    seen = max((p.executionId() for p in listed()), default=-1)
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, v in low.items():
            spark.conf.set(k, v)
        assert run(docs).toPandas().shape[0] == len(texts)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    # By number: Spark keeps only the last thousand plans.
    assert any("skew=true" in p.physicalPlanDescription() for p in listed() if p.executionId() > seen)
