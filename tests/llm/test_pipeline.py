"""The pipeline: its stages one by one on a small folder of tables, against plain computations."""

import hashlib
import os
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark import SparkContext

import corpus_pipeline
from glosswork.llm._common import work_dir
from glosswork.llm import _common, bpe_chunks, minhash, mixing, quality

from .test_operators import brute_classes, sentences

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("needs the test tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, columns = docs.count(), docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == columns, name
        after = kept.count()
        assert 0 < after <= before, name
        docs, before = kept.persist(), after
    shared = pathlib.Path(work_dir(spark).removeprefix("file:"))
    there = set(shared.rglob("*.parquet"))
    last = corpus_pipeline.run(spark, folder)
    left = {f.parent.name for f in set(shared.rglob("*.parquet")) - there}
    assert len(left) == 1 and left.pop().endswith("-stage-encoding")
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == before
    assert corpus_pipeline.run(spark, folder).exceptAll(last).count() == 0


def write_tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, FIELDS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_every_stage_against_plain_computations(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    rng, said = random.Random(80), [f"{s.capitalize()}." for s in sentences(81, 90, 80)]
    junk = [" | ".join(s.split()) for s in sentences(82, 40, 60)]
    copies = [said[i].replace(" ", "  ", 3) for i in range(20)] + [said[i] for i in range(10)]
    near = []
    for i in range(20, 40):
        words = said[i].split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))
    texts = said + junk + copies + near + [None, ""]
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", 0) for i, t in enumerate(texts)]
    labels = [(i, int(i < 90), 0) for i in range(0, 130, 2)]
    folder = write_tables(spark, tmp_path, rows, labels)
    docs, got = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, folder)
        got.append(kept.toPandas())
        if name == "quality":
            scores = quality.quality_scores(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("kept").toPandas()
        elif name == "mixing":
            drawn = mixing.mix(docs, keep=mixing.KEEP).where("keep").select("row.doc_id").toPandas()
        docs = kept
    ids = [set(g["doc_id"]) for g in got]
    assert ids[0] == set(scores["doc_id"]) and set(range(90)) <= ids[0] and not ids[0] & set(range(90, 130))
    groups = {}
    for i in ids[0]:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", texts[i] or ""), []).append(i)
    assert ids[1] == {min(own, key=lambda i: (-len(texts[i] or ""), i)) for own in groups.values()}
    left = sorted(ids[1])
    classes = brute_classes([texts[i] for i in left])
    assert ids[2] == {left[c] for c in set(classes)} and len(ids[2]) < len(ids[1])
    assert ids[3] == set(drawn["doc_id"]) and 0.5 * len(ids[2]) < len(ids[3]) < len(ids[2])
    t, last = Tokenizer.from_file(public_tokenizers.path(bpe_chunks.VOCABULARY)), got[4].set_index("doc_id")
    assert ids[4] == ids[3]
    for i in ids[4]:
        own = t.encode(texts[i] or "", add_special_tokens=False).ids
        assert last.loc[i, "ids_sha256"] == hashlib.sha256(np.array(own, dtype="<u4").tobytes()).hexdigest() and last.loc[i, "n_tokens"] == len(own)


def test_python_rows_are_not_held_by_coalesced_tasks(spark, tmp_path, monkeypatch):
    """A coalesced task would hold what each of its many partitions queued for Python; nor are Python workers started for rows of tuples."""
    plans, lists = [], []
    packed, parallelize = _common.packed, SparkContext.parallelize
    monkeypatch.setattr(_common, "packed", lambda df, rows: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or packed(df, rows))
    monkeypatch.setattr(SparkContext, "parallelize", lambda self, *a, **b: lists.append(a) or parallelize(self, *a, **b))
    said = sentences(83, 30, 60)
    rows = [(i, f"{t} more" if i % 2 else t, "en", "s", 0) for i, t in enumerate([*said, *said])]
    docs = spark.read.parquet(f"{write_tables(spark, tmp_path, rows, [])}/documents.parquet")
    lists.clear()
    assert len(minhash.keep_one_each(docs).collect()) == 30 and plans
    assert not [p for p in plans if re.search("EvalPython|MapIn", p)]
    assert mixing.keep_sampled(docs).count() and not lists


def test_empty_tables_pass_through(spark, tmp_path):
    folder = write_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
