import random

import pytest
from pyspark.sql import functions as F

from glosswork.functions import lang, quality, text
from glosswork.operators import phrase_table as pt
from glosswork.operators import prefixes
from glosswork.operators import translate as tr
from glosswork.operators.lookup import Lookup
from glosswork.operators.numbering import number_rows
from tests import spec

TABLE = [(1, "hello world", "olá mundo", "en", "pt_BR", 1), (2, "open file", "abrir arquivo", "en", "pt_BR", 1), (3, "file", "arquivo", "en", "pt_BR", 1)]


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", make(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows)]


def phrase_table(spark, rows=TABLE):
    return spark.createDataFrame(rows, pt.SCHEMA)


def test_normalize_for_lookup(spark):
    cases = {"Don't": "don t", "can't": "cannot", "WON'T go": "will not go", "x n't": "x not", "I'm": "i am", "they're": "they are", "he'd've": "he would have", "It's open-source!": "it open source",
             "x-1": "x-1", "a-b-c": "a b c", "‘a’ “b”": "a b", "¿qué?": "¿qué", "a/b+c#": "a/b+c#", " a b ": "a b", "ação-é": "ação é", "éI'm": "éi am"}
    assert column(spark, list(cases), text.normalize_for_lookup) == list(cases.values())


def test_case_functions(spark):
    assert column(spark, ["ßa", "1éa", "…", "😀a", ""], text.uppercase_first) == ["ßa", "1Éa", "…", "😀A", ""]
    for source, want in (("I", "AB C"), ("漢字", "AB C"), ("Hi", "Ab c"), ("hi", "ab c"), ("123", "ab c")):
        assert column(spark, [source], lambda x: text.apply_capitalization(x, F.lit("ab c"))) == [want]


def test_languages(spark):
    codes = {"pt": "pt_BR", "pt-PT": "pt_BR", "por": "pt_BR", "por_BR": "por_BR", "ptbr": "pt_BR", "en_US": "en", "fr-CA": "fr", "zh-Hans-CN": "zh_HANS", "_en": "_en", "DE": "de", "de-AT": "de_AT", "eng": "eng", "": "", " en ": "en"}
    assert column(spark, list(codes), lang.normalize_language) == list(codes.values())
    assert column(spark, ["pt", "", "de"], lang.lookup_variants) == [["pt_BR", "pt", "pt_br"], [], ["de"]]


@pytest.mark.parametrize("pair,reason", [
    (("", "x y"), "empty"), (("a", "bb"), "length"), (("File!", "file"), "same"), (("<b>x", "yy"), "markup"), (("color: red", "yy"), "style"), (("www.x", "yy"), "url"), (("if (x", "yy"), "code"),
    (("Use the USA map", "mapa"), "variable"), (("pid of", "yy"), "pid"), (("Bearer of", "yy"), "auth"), (("tool tip", "yy"), "tooltip"), (("a/b/c", "yy"), "path"), (("a@b.org x", "yy"), "email"),
    (("amount in units (real)", "yy"), "catalog"), (("wow!!!! a", "yy"), "symbols"), (("no no no no", "yy"), "strange"), (("open file", "abrir"), None), (("ab😀 cdefgh", "yy"), None), (("😀😀abcdefghi", "yy"), "symbols"),
])
def test_import_rules(spark, pair, reason):
    got = spark.createDataFrame([pair], "s string, t string").select(quality.first_reason(quality.import_rules(quality.side(F.col("s")), quality.side(F.col("t")))).alias("r")).first()[0]
    assert got == reason


@pytest.mark.parametrize("source,bad", [
    ("123 45", True), ("a a a a a", True), ("a a a a", False), ("bad\x01c", True), ("lost �� x", True), ("ab cd " * 133 + "ab", False), ("ab cd " * 133 + "abc", True), ("if (x)", False), ("while (x)", True),
    ("color: red", False), ("PID x", False), ("pid 12", True), ("wow there!!!!! abc", False), ("wow there!!!!!! abc", True), ("  ", True)])
def test_cleanup_rules(spark, source, bad):
    assert spark.createDataFrame([(source, "bom texto")], "s string, t string").select(quality.is_invalid_stored_pair(F.col("s"), F.col("t"))).first()[0] is bad


def test_build_best_upsert_and_catalog(spark):
    raw = spark.createDataFrame([("en", "pt", 1, "It's open-source!", "É código aberto!"), ("en", "pt", 2, "it's open source", "É código aberto!"), ("en", "pt", 3, "File", "file"), ("en", "pt", 4, "Hello there", "olá")],
                                "source_lang string, target_lang string, line_no bigint, source_raw string, target_raw string")
    table = pt.build(pt.import_pairs(raw))
    assert sorted(map(tuple, table.collect())) == [(1, "it open source", "É código aberto!", "en", "pt_BR", 2), (2, "hello there", "olá", "en", "pt_BR", 1)]
    assert pt.import_stats(raw).first().asDict() == {"processed": 4, "inserted": 2, "updated_frequency": 1, "ignored": 1, "duplicate": 1, "resumed": 0}
    again = pt.upsert(table, pt.import_pairs(raw))
    assert sorted((r["id"], r["frequency"]) for r in again.collect()) == [(1, 4), (2, 2)]
    assert pt.import_stats(raw, table).first()["inserted"] == 0
    ties = phrase_table(spark, [(1, "k", "aa", "en", "de", 3), (2, "k", "b b", "en", "de", 3), (8, "k", "yyyy", "en", "de", 5), (9, "k", "zzzz", "en", "de", 5)])
    assert pt.find_translation(ties, " K! ", "en-GB", "DE") == "yyyy"
    assert pt.find_translation(ties, "nothing", "en", "de") is None and pt.find_translation(ties, "k", "", "de") is None
    assert pt.has_pair(table, "en_US", "pt") and not pt.has_pair(table, "de", "pt")
    assert [r[0] for r in pt.available_languages(table).collect()] == ["en", "pt_BR"]


def test_number_rows(spark):
    rows = [(g, i * 7 % 101) for g in ("a", "b", None) for i in range(101)]
    got = number_rows(spark.createDataFrame(rows, "g string, v int"), ["v"], ["g"], start=10).collect()
    assert len(got) == 303 and all(r["row_no"] == r["v"] + 11 for r in got)


def test_segments_match_the_specification(spark):
    rng = random.Random(1)
    alphabet = ["a", "B", "1", "2", " ", ".", ".", "!", "?", "\"", ")", "Mr", "e.g", "etc", " vs", "é"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20))) for _ in range(1500)]
    got = column(spark, texts, tr.sentence_segments)
    assert [[tuple(s) for s in g] for g in got] == [spec.segments(t) for t in texts]


def test_greedy_cover_matches_the_specification(spark):
    rng = random.Random(2)
    vocabulary = ["the", "a", "please", "open", "file", "x-y", "I'm", "don't", "Big", "tool", "é", "u/v"]
    phrases = {" ".join(rng.choice(["the", "a", "open", "file", "big", "tool", "i", "am", "x", "y", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(60)}
    table = [(i, p, f"T{i}", "en", "de", 1) for i, p in enumerate(sorted(phrases))]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 15))) for _ in range(400)]
    segments = spark.createDataFrame(list(enumerate(texts)), "i int, text string").selectExpr("i", "text", "'en' as source_lang", "'de' as target_lang", "'' as delimiter")
    got = {r["i"]: tuple(r)[3:] for r in tr.translate_segments(segments, ["i"], phrase_table(spark, table)).collect()}
    known = {p: t for _, p, t, *_ in table}
    assert [got[i] for i in range(len(texts))] == [spec.greedy(t, known) for t in texts]


def test_translation_examples(spark):
    cases = [("Hello, world!", "Olá mundo!", "full", "hello world", 2), ("HELLO WORLD", "OLÁ MUNDO", "full", "hello world", 2), ("Open the file.", "Abrir arquivo.", "full", "open file", 3),
             ("please Open the file now", "abrir arquivo now", "phrase-normalized", "open file", 4), ("Foo, file: bar", "Foo, arquivo: bar", "word", "file", 1), ("open-source Foo", "open source foo", "none", "", 0),
             ("a.b", "a. b", "none", "", 0), ("  (file)\n\nI", "  (arquivo)\n\nI", "full", "file", 1), ("\"Hello world.\"", "\"Olá mundo.\"", "full", "hello world", 2), ("...", "...", "none", "", 0), ("", "", "none", "", 0)]
    inputs = spark.createDataFrame([(i, c[0], "en", "pt") for i, c in enumerate(cases)], "i int, text string, source_lang string, target_lang string")
    got = {r["i"]: (r["translation"], r["match_type"], r["matched_text"], r["consumed_words"]) for r in tr.translate(inputs, phrase_table(spark), ["i"]).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    empty = tr.translate(inputs, phrase_table(spark).limit(0), ["i"]).where("match_type <> 'none'").count()
    assert empty == 0


def test_patterns_are_asked_of_all_texts_that_they_match(spark):
    rng = random.Random(7)
    words = ["PID", "pİd", "proceſs", "id", "to\u212aen", "token", "tool", "tip", "TOOLTIP", "OAuth", "apı", "API-Key", "Bearer", "Authorization:", "unit", "synonyms", "www.x", "WWW.", "ftp://a", "x://", "ABC", "_A_", "%1", "${a}",
             "@x@", "a/b", "../", "c:\\", "me@host.org", "<b", "&amp;", "#fff", ".a", "{", "color:", "if", "(", ";", "->", "==", "||", "[[", "word", "ſ", "é", "amount in units (real)", "process  id 5", "token = abcdef123456"]
    texts = [*words, *[" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(600)]]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    for rules in (quality.TECHNICAL, quality.STORED_JUNK):
        columns = [F.expr("1")] + [(quality.pattern_rule(n, p)(quality.side(F.col("x"))) != F.col("x").rlike(p)).alias(n) for n, p in rules.items()]
        wrong = rows.select("x", *columns[1:]).where(" or ".join(rules))
        assert wrong.count() == 0, wrong.first()


def test_private_use_characters_and_many_lines_come_back(spark):
    own = ["a\ue000b 3.14 Mr. X. End", "\ue001\ue002\ue003 x. y\ue000", "\ue001\ue003. z"]
    assert ["".join(s["text"] + s["delimiter"] for s in g) for g in column(spark, own, tr.sentence_segments)] == ["a\ue000b 3.14 Mr. X.End", "\ue001\ue002\ue003 x.y\ue000", "\ue001\ue003.z"]
    text_ = "\r\n".join(f"  the file {i}\t" if i % 3 else " \t" for i in range(3000))
    inputs = spark.createDataFrame([(1, text_, "en", "pt"), (2, "", "en", "pt"), (3, " \n\n", "en", "pt"), (4, None, "en", "pt")], "i int, text string, source_lang string, target_lang string")
    got = {r["i"]: r["translation"] for r in tr.translate(inputs, phrase_table(spark), ["i"]).collect()}
    assert got == {1: "\r\n".join(f"  the arquivo {i}\t" if i % 3 else " \t" for i in range(3000)), 2: "", 3: " \n\n", 4: ""}


def test_filter_of_prefixes_changes_no_row(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["the", "a", "please", "open", "file", "big", "tool", "é", "of", "x"]
    say = lambda least, most: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(least, most)))
    phrases = sorted({say(1, 5) for _ in range(80)} | {say(7, 15) for _ in range(40)})
    texts = [say(0, 20) for _ in range(300)] + [" ".join(rng.choice(phrases) for _ in range(3)) for _ in range(200)]
    rows = [(s, t, p, f"{s} {p}") for p in phrases for s, t in (("en", "de"), ("en", "fr"), ("de", "en")) if rng.random() < 0.6]
    best = spark.createDataFrame(rows, "source_lang string, target_lang string, candidate string, translation string")
    said = [(i, rng.choice(["en", "de", "xx"]), t, x.split()) for i, x in enumerate(texts) for t in ("de", "fr", "en")]
    segments = spark.createDataFrame(said, "i int, source_lang string, target_lang string, words array<string>")

    def trace(lookup):
        return sorted(map(tuple, tr.match_trace(segments, ["i", "target_lang"], lookup).collect()))

    plain = Lookup(spark, [{"rows": len(rows), "longest": 14}], table=best)
    assert plain.filters() is None
    want = trace(plain)
    assert any(r[3] > 8 for r in want) and any(r[4] == 1 for r in want)
    whole = tr.measured(best)
    assert whole.filters() and trace(whole) == want
    parts = [{"rows": 1, "longest": 14, "bits": bits, "filter": prefixes.phrase_filter(best.where(cond), bits)} for bits, cond in ((1 << 13, "length(candidate) > 9"), (1 << 10, "length(candidate) <= 9"))]
    assert trace(Lookup(spark, parts, table=best)) == want
    full = [{"rows": 1, "longest": 14, "bits": 64, "filter": prefixes.phrase_filter(best, 64)}]  # a filter that says yes to nearly all
    assert trace(Lookup(spark, full, table=best)) == want
    own = segments.select("i", "source_lang", "words").distinct()
    few = tr.stored_candidates(own, ["i", "source_lang"], 12, whole.filters()).count()
    assert few * 5 < own.select(F.explode(tr.ngram_candidates(F.col("words")))).count()
    monkeypatch.setattr(prefixes, "MOST_ROWS", 10)
    assert tr.measured(best).filters() is None and prefixes.filter_bits(0) == 0


def test_a_phrase_of_the_filter_is_never_refused(spark):
    words = ["a", "b", "c", "d", "e"]
    phrases = [" ".join(words[(i // 5**k) % 5] for k in range(1 + i % 9)) for i in range(500)]
    best = spark.createDataFrame([("en", p) for p in phrases], "source_lang string, candidate string")
    test = prefixes.known([(prefixes.phrase_filter(best, prefixes.filter_bits(500)), prefixes.filter_bits(500))])
    assert best.where(~test(prefixes.head_key(F.col("source_lang"), F.lit(0), F.col("candidate")))).count() == 0
    others = best.select("source_lang", F.concat("candidate", F.lit(" z")).alias("candidate"))
    assert others.where(test(prefixes.head_key(F.col("source_lang"), F.lit(0), F.col("candidate")))).count() < 50
