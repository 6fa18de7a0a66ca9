"""Fill-in-middle, suffix-array dedup and the filter audit against plain computations, with odd rows of every kind."""

import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from glosswork.llm import fill_middle, filter_audit, suffix_dedup

from .test_operators import ODD, documents, sentences

LONG = 20 << 20


def sha(raw):
    return hashlib.sha256(raw.encode() if isinstance(raw, str) else raw).hexdigest()


# Fill-in-middle.
def plain_fim(text, doc_id):
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i * 8:i * 8 + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_equals_plain_cutting(spark):
    rng = random.Random(5)
    texts = [*ODD, "\n", "\n\n\n", "a\r\nb", "x<P>y", "<S>", "a <M", "<P\n>S>", "é😀\nü\n", " a\u0085b\n", "tail\n"]
    texts += ["".join(rng.choice(["a", "<", "P>", "S", ">", "\n", "é", "<M", "😀"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    ids = [None, 3, 3, -5, *range(100, 100 + len(texts) - 4)]
    docs = documents(spark, texts, ids)
    got = fill_middle.fill_in_middle(docs).collect()
    want = [(i, *w[:4], sha(w[4]), sha(t or ""), w[4]) for i, t in zip(ids, texts, strict=True) for w in [plain_fim(t or "", i)]]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert all(fill_middle.restored(r["output"], r["form"]) in [t or "" for t in texts] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fim_digests(docs.limit(0)).count() == 0


def test_fill_in_middle_has_other_rates_and_units(spark):
    docs = documents(spark, sentences(9, 200, 6))
    none = fill_middle.fill_in_middle(docs, rate=0).collect()
    assert {r["form"] for r in none} == {"plain"} and all(r["output_sha256"] == r["restored_sha256"] for r in none)
    words = fill_middle.fill_in_middle(docs, unit=r"\S+\s*", spm_rate=0, seed=8).collect()
    assert {r["form"] for r in words} == {"psm"} and {r["n"] for r in words} == {6}


def test_fill_in_middle_of_a_very_long_text(spark):
    text = "line of a long text é\n" * (LONG // 23)
    r = fill_middle.fim_digests(documents(spark, [text, "a"])).where("doc_id = 0").first()
    want = plain_fim(text, 0)
    assert (r["n"], r["form"], r["output_sha256"], r["restored_sha256"]) == (want[0], want[1], sha(want[4]), sha(text))


# Suffix-array dedup.
def plain_removed(rows, length):
    """(kept bytes, removed, spans) of each (doc_id, text)."""
    inf = float("inf")
    raws = [(inf if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, raw in raws:
        for a in range(len(raw) - length + 1):
            least[raw[a:a + length]] = min(i, least.get(raw[a:a + length], inf))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if least[raw[a:a + length]] < i:
                gone[a:a + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((kept, sum(gone), len(re.findall(b"\x01+", bytes(gone)))))
    return out


@pytest.mark.parametrize("length", [8, 17, 50])
def test_judged_blocks_match_brute_force(length):
    for seed in range(60):
        rng = random.Random(seed)
        letters = rng.choice([b"ab", b"a", b"\0\1", b"abc\xff\0"])
        base = bytes(rng.choice(letters) for _ in range(400))
        texts = []
        for _ in range(rng.randrange(1, 20)):
            n = rng.randrange(length, length + 30)
            a = rng.randrange(0, len(base) - n)
            text = bytearray(base[a:a + n])
            if rng.random() < 0.5:
                text[rng.randrange(n)] = rng.choice(letters)
            texts.append(bytes(text))
        least = np.array([rng.randrange(6) for _ in texts])
        first = {}
        for t, low in zip(texts, least, strict=True):
            for i in range(len(t) - length + 1):
                first[t[i:i + length]] = min(low, first.get(t[i:i + length], 99))
        want = [sum(1 << i for i in range(len(t) - length + 1) if first[t[i:i + length]] < low) for t, low in zip(texts, least, strict=True)]
        assert suffix_dedup.judge_block(texts, least, length).tolist() == want


def test_cover_of_many_documents_is_one_mask():
    """Lists of pieces of a batch, a null one and a sliced column among them, mark the same bytes as piece by piece."""
    kind = pa.list_(pa.struct([("at", pa.int64()), ("strings", pa.int32()), ("bits", pa.int64())]))
    column = pa.array([[(0, 1, 1)], None, [(2, 3, 5), (9, 62, 1 << 61)], [], [(0, 2, 3)]], kind).slice(1)
    doc, (at, strings, bits) = suffix_dedup.elements(column)
    assert doc.tolist() == [1, 1, 3] and at.tolist() == [2, 9, 0]
    offsets = np.array([0, 100, 200, 300])
    mask = suffix_dedup.removed_mask(400, offsets[doc] + at, strings, bits, 8)
    assert np.flatnonzero(mask).tolist() == [*range(102, 112), *range(170, 178), *range(300, 309)]
    assert not len(suffix_dedup.removed_mask(0, at[:0], strings[:0], bits[:0], 8))


def test_two_stage_order_is_the_order_of_suffixes():
    for seed in range(80):
        rng = random.Random(seed)
        texts = [bytes(rng.choice(b"abz") for _ in range(rng.randrange(1, 60))) for _ in range(8)]
        whole = b"\0".join(texts) + b"\0"
        data = np.frombuffer(whole, dtype=np.uint8)
        codes = np.where(data == 0, 0, data.astype(np.int16) + 1)
        words = suffix_dedup.words_at(data)
        order = suffix_dedup.suffix_order(codes, words, codes > 0, 50)
        suffix = lambda x: whole[x:whole.index(b"\0", x)][:50]  # noqa: B023, E731
        assert sorted(order) == np.flatnonzero(codes > 0).tolist() and [suffix(x) for x in order] == sorted(suffix(x) for x in order)
        shared = suffix_dedup.common_prefixes(order, words, 50)
        for a, b, n in zip(order, order[1:], shared[1:], strict=False):
            assert whole[a:a + n] == whole[b:b + n] and (n == 50 or whole[a + n:a + n + 1] != whole[b + n:b + n + 1])


def passages(seed, n):
    """Texts that share passages, lines of one byte and NULs, with copies in hundreds."""
    rng = random.Random(seed)
    shared = [*sentences(seed, 12, 14), "a" * 500, "ab" * 90, "\0" * 120, "é😀" * 30, " " * 200]
    own = sentences(seed + 1, n, 8)
    texts = []
    for i in range(n):
        parts = [own[i], *rng.sample(shared, rng.randrange(0, 3))]
        if rng.random() < 0.2:
            x = rng.choice(shared)
            parts.append(x[rng.randrange(20):])
        rng.shuffle(parts)
        texts.append(rng.choice(["", " ", "\n"]).join(parts))
    return texts + [texts[0]] * 40 + [texts[1] + "!"] * 40


@pytest.mark.parametrize("length,most,stretch,block,keys", [(50, 20_000, 1 << 20, 2 << 20, 1 << 23), (50, 3, 300, 500, 0), (24, 0, 1000, 2000, 1 << 10)])
def test_suffix_dedup_matches_brute_force(spark, monkeypatch, length, most, stretch, block, keys):
    monkeypatch.setattr(suffix_dedup, "FILTER_KEYS", keys)
    monkeypatch.setattr(suffix_dedup, "STRETCH", stretch)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", block)
    texts = [*ODD, "x" * 49, "x" * 50, "y" * 51, *passages(3, 120)]
    ids = list(range(1000, 1000 + len(texts)))
    random.Random(1).shuffle(ids)
    ids[20:26] = [None, None, 7, 7, 7, -3]
    texts[24] = texts[23]
    docs = documents(spark, texts, ids)
    got = suffix_dedup.remove_repeats(docs, length, most).collect()
    want = [(i, len((t or "").encode()), w[1], w[2], sha(w[0]), w[0]) for (i, t), w in zip(zip(ids, texts, strict=True), plain_removed(list(zip(ids, texts, strict=True)), length), strict=True)]
    rows = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"]


def test_suffix_dedup_of_odd_tables(spark):
    assert suffix_dedup.repeats_removed(documents(spark, ODD).limit(0)).count() == 0
    assert all(r["n_removed"] == 0 for r in suffix_dedup.repeats_removed(documents(spark, ["x" * 300] * 3, [4, 4, 4])).collect())


def test_suffix_dedup_of_a_very_long_text(spark):
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, LONG, dtype=np.uint8).tobytes().decode()
    got = {r["doc_id"]: r for r in suffix_dedup.repeats_removed(documents(spark, [text[500:600] + "#" + "z" * 100_000, text + text[-49:], text[:LONG // 2] + "-"], [1, 2, 3])).collect()}
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (0, 100, 1)
    assert (got[3]["n_removed"], got[3]["kept_sha256"]) == (LONG // 2, sha("-"))


# The filter audit.
def plain_audit(rows, labels):
    """Rows of the audit by walking every document through every order."""
    inf = float("inf")
    first, known = {}, {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", inf), inf if i is None else i)
    for i, q, x in labels:
        if i is not None:
            before = known.get(i, (False, False))
            known[i] = (before[0] or q == 1, before[1] or x == 1)
    facts = []
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": (inf if i is None else i) > first[t]}
        facts.append((lang or "", fails, *known.get(i, (False, False))))
    out, parts = set(), {f[0] for f in facts}
    removed = {}
    for part in parts:
        own = [f for f in facts if f[0] == part]
        cells = []
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                here, left = [f for f in left if f[1][c]], [f for f in left if not f[1][c]]
                cells.append(("".join(order), step, c, len(left), len(here), sum(f[1][c] for f in own) - len(here), sum(f[1][c] and sum(f[1].values()) == 1 for f in own),
                              sum(f[2] for f in here), sum(f[3] for f in here)))
                removed[part, c] = removed.get((part, c), 0) + len(here)
        out |= {(part, *x[:2], *x[3:], removed[part, x[2]]) for x in cells}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("parts_held", [256, 1])
def test_audit_matches_a_walk_through_all_orders(spark, monkeypatch, parts_held):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", parts_held)
    rng = random.Random(2)
    texts = [*ODD, "A", "a#", "é" * 40, "\x1ca b c", *[" ".join(rng.choice(["aa", "b", "C", "dd", "#", f"w{rng.randrange(400)}"]) for _ in range(rng.randrange(120, 300))) for _ in range(60)]]
    texts += rng.sample(texts, 20) * 2 + ["copy " * 210] * 30
    rows = [(None if n % 17 == 9 else n // 2 if n % 11 == 0 else n, t, rng.choice(["en", "de", None, "", "x"])) for n, t in enumerate(texts)]
    labels = [(rng.randrange(150), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(200)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1.5, "p") for r in rows], "doc_id long, text string, lang string, label double, digest string")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600 * len({r[2] or "" for r in rows}) and {tuple(r[c] for c in COLUMNS) for r in got} == plain_audit(rows, labels)


def test_audit_of_odd_tables(spark):
    docs, labels = documents(spark, ["a b", "#" * LONG]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    got = filter_audit.audit(docs, labels)
    assert got.where("filter_order = 'ABCDE' and step = 1").first()["removed"] == 2 and got.agg({"good_lost": "sum"}).first()[0] == 0
    assert {r["unique_fails"] for r in got.collect()} == {0, 1}


def test_first_failures_hold_every_set_and_order():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all() and (table[31] == 0).all()
    for mask in range(32):
        for o, order in enumerate(filter_audit.ORDERS):
            assert table[mask, o] == next((i for i, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)
