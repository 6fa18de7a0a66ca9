import io
import pathlib
import random
import threading

import pytest
from pyspark.sql import functions as F

from glosswork import cli
from glosswork.operators import lookup
from glosswork.operators import phrase_table as pt
from glosswork.operators import store as store_module
from glosswork.operators.manifest import ConflictError, ManifestLog
from glosswork.operators.shared import shared_folder
from glosswork.operators.store import NotReadyError, PhraseStore, Translator
from glosswork.sources import aligned as aligned_source
from glosswork.sources import moses
from glosswork.streaming.import_stream import import_stream
from glosswork.streaming.translate_stream import translate_stream


def write(path, lines, newline="\n", bom=False):
    path.write_bytes((b"\xef\xbb\xbf" if bom else b"") + newline.join(lines).encode() + newline.encode())
    return str(path)


@pytest.fixture
def pair(tmp_path):
    return (write(tmp_path / "C.en-pt.en", ["Open file", "open file", "Good\rday friend", "<b>x"], "\r\n", True), write(tmp_path / "C.en-pt.pt", ["abrir arquivo", "abrir arquivo", "bom dia", "negrito"]))


def test_read_lines_over_many_blocks(spark, tmp_path):
    path = write(tmp_path / "x.txt", [f"line {i}" + ("\rstill" if i == 7 else "") for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r["line_no"]: r["value"] for r in moses.read_lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and got[7] == "line 7\rstill" and all(got[i] == f"line {i}" for i in range(3000) if i != 7)


def test_first_lines_of_any_length_and_bytes(spark, tmp_path):
    """A sign of two bytes stands where the first 1,024 bytes end, bytes are no UTF-8, a line begins with many blanks."""
    lines = {"cut": ("x" * 1023 + "é").encode(), "bad": b"\xff\xfe ok", "late": b" " * 5000 + b"x", "blank": b" " * 5000, "two words": b"one two", "a%20b+é": b"three"}
    for name, first in lines.items():
        (tmp_path / name).write_bytes(first + b"\nsecond\n")
    (tmp_path / "empty").write_bytes(b"")
    got = {r["file_name"]: r["ok"] for r in moses.list_files(spark, str(tmp_path)).select("file_name", moses.is_readable(F.col("size"), F.col("first_line")).alias("ok")).collect()}
    assert got == {"cut": True, "bad": True, "late": True, "blank": False, "two words": True, "a%20b+é": True, "empty": False}


def test_scan(spark, tmp_path, pair):
    write(tmp_path / "Half.en-de.en", ["only one side"])
    (tmp_path / "Tiny.en-fr.en").write_text("x")
    (tmp_path / "Tiny.en-fr.fr").write_text("a longer line")
    found = moses.scan(spark, str(tmp_path)).collect()
    assert [(d["corpus_name"], d["source_language"], d["target_language"]) for d in found] == [("C", "en", "pt_BR")]
    assert found[0]["source_file"] == pair[0]
    assert moses.scan(spark, str(tmp_path / "new")).count() == 0 and (tmp_path / "new").is_dir()
    assert moses.has_dataset_files(str(tmp_path)) and not moses.has_dataset_files(str(tmp_path / "new"))


def test_import_both_ways_and_translate(spark, tmp_path, pair):
    store = PhraseStore(spark, str(tmp_path / "store"))
    with pytest.raises(NotReadyError):
        store.table()
    forth, back = store.initialize().import_both(*pair, "en", "pt")
    assert forth == {"processed": 4, "inserted": 2, "updated_frequency": 1, "ignored": 1, "duplicate": 1, "resumed": 0}
    assert back["inserted"] == 3
    rows = {(r["source_text"], r["translated_text"], r["source_lang"], r["frequency"]) for r in store.table().collect()}
    assert rows == {("open file", "abrir arquivo", "en", 2), ("good day friend", "bom dia", "en", 1), ("abrir arquivo", "Open file", "pt_BR", 1), ("abrir arquivo", "open file", "pt_BR", 1), ("bom dia", "Good day friend", "pt_BR", 1)}
    again = store.import_moses(*pair, "en", "pt")
    assert again["resumed"] == 4 and store.table().count() == 5
    translator = Translator(store.lookup())
    assert translator.translate_text("Open file!", "en", "pt") == "Abrir arquivo!"
    seen = translator.statistics
    assert (seen["translations"], seen["by_type"]) == (1, {"full": 1}) and seen["last_ms"] == seen["mean_ms"] == seen["total_ms"] > 0
    assert translator.trace("the open file", "en", "pt")[0] == "miss at word 0: the open file" and "hit  at word 0: open file -> abrir arquivo" in translator.trace("the open file", "en", "pt")
    # Three lookups: of "Open file!" with 3 phrases and twice of "the open file" with 7.
    assert (seen["lookups"], seen["phrases"], seen["phrase_hits"]) == (3, 17, 5) and seen["mean_lookup_ms"] == seen["lookup_ms"] / 3 > 0
    assert Translator(store.table()).translate_text("the OPEN file; good day friend?", "en", "pt") == translator.translate_text("the OPEN file; good day friend?", "en", "pt")
    assert store.report()[0] == "5 translations, total frequency 6" and "languages: en, pt_BR" in store.report()
    assert Translator(None).translate_text("Open file!") == "Open file!"


def test_misaligned_and_resume(spark, tmp_path, pair):
    short = write(tmp_path / "short", ["um", "dois"])
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    with pytest.raises(moses.MisalignedError):
        store.import_moses(pair[0], short, "en", "pt")
    assert store.table().count() == 0 and "lines" in store.last_error
    key = store.key_of(*pair, "en", "pt")
    store.save_progress(key, *pair, "en", "pt", 2, False)
    assert store.import_moses(*pair, "en", "pt") == {"processed": 4, "inserted": 1, "updated_frequency": 0, "ignored": 1, "duplicate": 0, "resumed": 2}
    with pytest.raises(moses.ResumeError):
        moses.read_pair(spark, *pair, "en", "pt", 99)


def aligned(tmp_path, n, name="B", target="de", first=0):
    """Two files of ``n`` lines, all different, that the filters keep."""
    word = lambda i: "".join("abcdefghij"[int(c)] for c in str(i).zfill(4))
    return (write(tmp_path / f"{name}.en-{target}.en", [f"word {word(i)} line" for i in range(first, first + n)]),
            write(tmp_path / f"{name}.en-{target}.{target}", [f"wort {word(i)} zeile" for i in range(first, first + n)]))


def size(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_batches_publish_rows_and_progress_together(spark, tmp_path, monkeypatch):
    left, right = aligned(tmp_path, 50)
    store, real, calls = PhraseStore(spark, str(tmp_path / "store")).initialize(), ManifestLog.claim, []

    def breaking(self, number, state):
        calls.append((len(state["deltas"]), state.get("progress", {})))
        if len(calls) == 3:
            raise OSError("lost")
        return real(self, number, state)

    monkeypatch.setattr(ManifestLog, "claim", breaking)
    with pytest.raises(OSError):
        store.import_moses(left, right, "en", "de", batch_lines=20)
    monkeypatch.undo()
    assert [(n, [p[4] for p in progress.values()]) for n, progress in calls] == [(1, [20]), (2, [40]), (3, [50])] and store.last_error == "lost"
    before = store.table()
    assert before.count() == 40 and [(r["processed_lines"], r["completed"]) for r in store.progress().collect()] == [(40, False)]
    assert store.import_moses(left, right, "en", "de", batch_lines=20) == {"processed": 50, "inserted": 10, "updated_frequency": 0, "ignored": 0, "duplicate": 0, "resumed": 40}
    assert store.table().agg({"frequency": "sum", "id": "max"}).first().asDict() == {"sum(frequency)": 50, "max(id)": 50}
    # A table that is being read stays for some more writes, then its files go.
    for _ in range(2):
        store.write(store.table())
    assert before.count() == 40
    for _ in range(5):
        store.write(store.table())
    assert len([x for x in (tmp_path / "store").iterdir() if x.name.startswith(("base-", "delta-"))]) <= 5


def test_a_batch_writes_about_its_own_bytes(spark, tmp_path, monkeypatch):
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.import_moses(*aligned(tmp_path, 10_000, "Big"), "en", "de")
    store.write(store.table())
    whole = size(tmp_path / "store")
    again = [x for x in store.table().orderBy("id").limit(50).collect()]
    left = write(tmp_path / "Small.en-de.en", [r["source_text"] for r in again] + [f"fresh {r['source_text']}" for r in again])
    right = write(tmp_path / "Small.en-de.de", [r["translated_text"] for r in again] + [r["translated_text"] for r in again])
    kept = {f for f in (tmp_path / "store").rglob("*") if f.is_file()}
    assert store.import_moses(left, right, "en", "de") == {"processed": 100, "inserted": 50, "updated_frequency": 50, "ignored": 0, "duplicate": 50, "resumed": 0}
    fresh = sum(f.stat().st_size for f in (tmp_path / "store").rglob("*") if f.is_file() and f not in kept)
    assert fresh < whole * 0.08 and not list((tmp_path / "store").glob(".fresh-*"))
    table = {r["source_text"]: r for r in store.table().collect()}
    assert len(table) == 10_050 and all(table[r["source_text"]]["frequency"] == 2 and table[r["source_text"]]["id"] == r["id"] for r in again)
    # The merged view is what one upsert makes, but for the numbers of the new ids.
    assert sorted(r["id"] for r in table.values())[:10_000] == list(range(1, 10_001)) and min(table[f"fresh {r['source_text']}"]["id"] for r in again) > 10_000


def test_catalogue_comes_from_the_manifest_and_equals_the_scan(spark, tmp_path, monkeypatch):
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.import_both(*aligned(tmp_path, 300), "en", "de")
    store.import_moses(*aligned(tmp_path, 120, "C", "fr", 200), "en", "fr")
    store.import_moses(*aligned(tmp_path, 200, "D", "de", 200), "en", "de", batch_lines=90)
    table = store.table()
    scanned = [pt.table_summary(table), pt.available_languages(table), pt.available_pairs(table), pt.pair_summary(table)]
    scanned = [sorted(map(tuple, x.collect())) for x in scanned]
    monkeypatch.setattr(PhraseStore, "_part", None)  # no data is read
    assert [sorted(map(tuple, x.collect())) for x in (store.summary(), store.available_languages(), store.available_pairs(), store.pair_summary())] == scanned
    assert store.has_pair("EN-us", "fr") and not store.has_pair("fr", "en") and store.report()[0].startswith("820 translations")
    estimate = {(r[0], r[1]): r[2] for r in store.distinct_sources().collect()}
    assert abs(estimate["en", "de"] - 400) < 40 and abs(estimate["de", "en"] - 300) < 30 and abs(estimate["en", "fr"] - 120) < 12


def test_deltas_are_merged_by_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FANOUT", 3)
    monkeypatch.setattr(store_module, "SMALLEST", 2)
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.import_moses(*aligned(tmp_path, 200), "en", "de")
    store.write(store.table())
    seen = []
    for i in range(8):
        store.append(spark.createDataFrame([(f"word {'x' * (i % 3 + 1)}", "wort" + "y" * (i % 2), "en", "de", 0, 1 + i)], "source_text string, translated_text string, source_lang string, target_lang string, first_line bigint, frequency bigint"))
        state = store._state()
        seen.append(len(state["deltas"]))
        want = {r["source_text"]: r["translated_text"] for r in pt.best_translations(store.table()).collect()}
        assert {r["candidate"]: r["translation"] for r in store.lookup().table().collect()} == want
        assert {r["candidate"]: r["translation"] for r in store.lookup().find("en", "de", list(want)).collect()} == want
    assert max(seen) <= 4 and seen[2] == 1 and store.table().count() == 206
    assert store.summary().first()["translation_count"] == 206 and store.summary().first()["total_frequency"] == 236


def test_two_writers_land_both(spark, tmp_path):
    PhraseStore(spark, str(tmp_path / "store")).initialize()
    files = {"de": aligned(tmp_path, 60), "fr": aligned(tmp_path, 80, "C", "fr")}
    done, start = {}, threading.Barrier(3)

    def work(target, files):
        store = PhraseStore(spark, str(tmp_path / "store"))
        start.wait()
        try:
            done[target, files] = store.import_moses(*files, "en", target, batch_lines=20)["inserted"]
        except ConflictError as e:
            done[target, files] = str(e)

    same = (*aligned(tmp_path, 40, "E", "de", 40),)
    threads = [threading.Thread(target=work, args=x) for x in (("de", files["de"]), ("fr", files["fr"]), ("de", same))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = PhraseStore(spark, str(tmp_path / "store"))
    assert done["fr", files["fr"]] == 80 and done["de", files["de"]] + done["de", same] == 80
    rows = store.table().collect()
    assert len(rows) == 160 and len({r["id"] for r in rows}) == 160 and sum(r["frequency"] for r in rows) == 180
    assert {(r["source_lang"], r["target_lang"]): r["translation_count"] for r in store.available_pairs().collect()} == {("en", "de"): 80, ("en", "fr"): 80}
    assert {(r["target_lang"], r["candidate"]): r["translation"] for r in store.lookup().table().collect()} == {(r["target_lang"], r["source_text"]): r["translated_text"] for r in rows}


def test_a_manifest_number_is_claimed_once(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))
    assert log.latest() == (0, {}) and log.claim(1, {"a": 1}) and not log.claim(1, {"a": 2}) and log.latest() == (1, {"a": 1})
    won = []
    threads = [threading.Thread(target=lambda i=i: won.extend([i] * log.claim(2, {"a": i}))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and log.latest() == (2, {"a": won[0]})

    def add(state):
        return state | {"n": state.get("n", 0) + 1}

    threads = [threading.Thread(target=log.commit, args=(add,)) for _ in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.latest()[1]["n"] == 6
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    other = PhraseStore(spark, str(tmp_path / "store"))
    real, seen = other._write_base, []
    other._write_base = lambda table: (seen.append(store.write(table)), real(table))[1]  # another write lands in between
    with pytest.raises(ConflictError):
        other.write(store.table())
    assert len(seen) == 1


def test_a_line_reads_few_files_and_writes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lookup, "ROWS_A_FILE", 100)
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.import_both(*aligned(tmp_path, 3000), "en", "de")
    store.write(store.table())
    found = store.lookup()
    every = found.table().inputFiles()
    files = found.files("en", "de", ["word aabb line", "word", "line"])
    assert len(every) >= 40 and sum(map(len, files)) <= 3
    translator, before = Translator(found), size(tmp_path / "store")
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    kept = set(shared.iterdir())
    asked = []
    monkeypatch.setattr(lookup.Lookup, "find", lambda self, *a, real=lookup.Lookup.find: asked.append(real(self, *a)) or asked[-1])
    assert translator.translate_text("Word aabb line!", "en", "de") == "Wort aabb zeile!"
    assert len(asked[0].inputFiles()) <= 8 and set(shared.iterdir()) == kept and size(tmp_path / "store") == before
    assert translator.translate_text("nothing here", "en", "de") == "nothing here" and translator.translate_text("", "en", "de") == ""


def test_lines_before_a_misalignment_stay(spark, tmp_path):
    left, right = aligned(tmp_path, 70)
    short = write(tmp_path / "short", [f"wort {i}" for i in "abcdefghij"] + [f"wort {i}{j}" for i in "abcde" for j in "abcdefghij"] + ["wort zz"])
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    with pytest.raises(moses.MisalignedError, match="60 lines are imported"):
        store.import_moses(left, short, "en", "de", batch_lines=20)
    assert store.table().count() == 60 and [(r["processed_lines"], r["completed"]) for r in store.progress().collect()] == [(60, False)]
    with pytest.raises(moses.MisalignedError):
        store.import_moses(left, short, "en", "de", batch_lines=20)
    assert store.summary().first()["total_frequency"] == 60
    even = write(tmp_path / "even", [f"wort {i}{j}" for i in "abcd" for j in "abcdefghij"])
    with pytest.raises(moses.MisalignedError):
        store.import_moses(left, even, "en", "de", batch_lines=20)
    assert store.progress().where("processed_lines = 40 and not completed").count() == 1


def test_cleanup_judges_rows_once(spark, tmp_path, monkeypatch):
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.import_moses(*aligned(tmp_path, 50), "en", "de")
    judged = []
    monkeypatch.setattr(pt, "cleanup_stats", lambda table, real=pt.cleanup_stats: judged.append(table.count()) or real(table))
    assert store.cleanup() == {"removed_invalid_entries": 0, "removed_duplicates": 0, "final_translations_count": 50} and judged == []
    store.append(spark.createDataFrame([("123 45", "x y", "en", "de", 0, 1), ("one more", "noch eine", "en", "de", 1, 1)], "source_text string, translated_text string, source_lang string, target_lang string, first_line bigint, frequency bigint"))
    assert store.cleanup() == {"removed_invalid_entries": 1, "removed_duplicates": 0, "final_translations_count": 51} and judged == [2, 52]
    assert store.table().count() == 51 and store.lookup().find("en", "de", ["123 45"]).count() == 0


def test_adopts_older_forms(spark, tmp_path):
    store = PhraseStore(spark, str(tmp_path / "store"))
    legacy = spark.createDataFrame([("file", "arquivo", "EN", "pt"), ("file", "arquivo", "en", "pt_BR"), ("open", "abrir", "en", "pt")], "source_text string, translated_text string, source_lang string, target_lang string")
    assert store.adopt(legacy) and sorted((r["source_text"], r["frequency"]) for r in store.table().collect()) == [("file", 2), ("open", 1)]
    assert not store.adopt(store.table()) and pt.migrate(store.table())[1] is False
    assert PhraseStore(spark, str(tmp_path / "new")).create().report() == ["The phrase table is empty; import a dataset first."]


def test_paths_and_console(spark, tmp_path, pair, monkeypatch, capsys):
    (tmp_path / "datasets").mkdir()
    for f in pair:
        (tmp_path / "datasets" / f.rsplit("/", 1)[1]).write_bytes(open(f, "rb").read())
    (tmp_path / "a" / "b").mkdir(parents=True)
    monkeypatch.chdir(tmp_path / "a")
    assert moses.datasets_path(str(tmp_path / "a" / "b")) == str(tmp_path / "datasets")
    monkeypatch.setenv(moses.ENVIRONMENT, str(tmp_path / "elsewhere"))
    assert moses.datasets_path() == str(tmp_path / "elsewhere")
    monkeypatch.setattr("sys.stdin", io.StringIO("2\n1\n1\nen\npt\nOpen file.\n\n0\n"))
    assert cli.main(["--store", str(tmp_path / "store"), "--datasets", str(tmp_path / "datasets"), "--debug"]) == 0
    shown = capsys.readouterr().out
    assert "The phrase table is empty" in shown and "1. C en-pt_BR" in shown and "Abrir arquivo." in shown and "hit  at word 0: open file -> abrir arquivo" in shown


def test_store_cleans_and_normalises(spark, tmp_path):
    store = PhraseStore(spark, str(tmp_path / "store"))
    rows = [(1, "file", "arquivo", "EN", "pt", 2), (2, "file", "arquivo", "en", "pt_BR", 3), (3, "123 45", "números", "en", "pt_BR", 1)]
    store.write(spark.createDataFrame(rows, "id bigint, source_text string, translated_text string, source_lang string, target_lang string, frequency bigint"))
    store.initialize()
    assert store.cleanup() == {"removed_invalid_entries": 1, "removed_duplicates": 0, "final_translations_count": 1}
    assert [(r["source_text"], r["frequency"]) for r in store.table().collect()] == [("file", 5)]


def test_stream(spark, tmp_path):
    store = PhraseStore(spark, str(tmp_path / "store")).initialize()
    store.append(spark.createDataFrame([("file", "arquivo", "en", "pt_BR", 0, 1)], "source_text string, translated_text string, source_lang string, target_lang string, first_line bigint, frequency bigint"))
    schema, source = "id bigint, text string, source_lang string, target_lang string", str(tmp_path / "in")
    for i in range(20):
        spark.createDataFrame([(2 * i, "The file", "en", "pt"), (2 * i + 1, "File", "en", "pt")], schema).coalesce(1).write.mode("append").parquet(source)
    shared = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    kept, sizes = {f for f in shared.iterdir()}, []
    for table in (store.lookup, store.table):
        got, translator = [], Translator(None)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1" if table == store.lookup else "10").parquet(source)

        def sink(df, n, got=got):
            got.extend(df.collect())
            sizes.append(size(tmp_path / "store"))

        translate_stream(stream, table, ["id"], sink, str(tmp_path / f"cp-{table.__name__}"), once=True, translator=translator).awaitTermination(240)
        assert sorted((r["id"], r["translation"]) for r in got) == [(i, "Arquivo" if i % 2 else "The arquivo") for i in range(40)]
        assert translator.statistics["phrases"] == 20 * 3 and translator.statistics["phrase_hits"] == 20 * 2 and translator.statistics["mean_lookup_ms"] > 0
    assert len(sizes) == 22 and len(set(sizes)) == 1 and set(shared.iterdir()) == kept  # nothing has grown


def test_arriving_files_meet_and_count_once(spark, tmp_path, monkeypatch):
    store, into = PhraseStore(spark, str(tmp_path / "store")), tmp_path / "in"
    into.mkdir()
    left, right = aligned(tmp_path, 30)
    (into / "B.en-de.en").write_bytes(open(left, "rb").read())
    (into / "notes.txt").write_text("nothing")
    run = lambda: import_stream(spark, str(into), store, str(tmp_path / "cp"), once=True).awaitTermination(240)
    run()
    assert store.table().count() == 0
    (into / "B.en-de.de").write_bytes(open(right, "rb").read())
    # The stream dies between the store's publish and its own checkpoint: once before the batch's number is published, once after.
    for broken in ("save_stream_position", None):
        real = store.save_stream_position

        def dies(name, number, real=real, broken=broken):
            if broken is None:
                real(name, number)
            raise OSError("killed")

        monkeypatch.setattr(store, "save_stream_position", dies)
        with pytest.raises(Exception, match="killed"):
            run()
        monkeypatch.undo()
        assert store.summary().first().asDict() == {"translation_count": 60, "total_frequency": 60}
    run()
    assert store.summary().first().asDict() == {"translation_count": 60, "total_frequency": 60} and store.progress().where("completed").count() == 2
    for f in aligned(tmp_path, 20, "F", "fr"):
        (into / f.rsplit("/", 1)[1]).write_bytes(open(f, "rb").read())
    run()
    assert store.available_pairs().count() == 4 and store.summary().first()["total_frequency"] == 100


@pytest.mark.parametrize("block", [3, 7, 64, 1 << 20])
def test_moses_source_equals_a_plain_zip(spark, tmp_path, block):
    rng = random.Random(block)
    def plain(path):
        raw = path.read_bytes().removeprefix(b"\xef\xbb\xbf")
        lines = raw.split(b"\n")
        lines = lines[:-1] if lines[-1] == b"" else lines
        return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]

    for n in range(6):
        files = [tmp_path / f"{block}-{n}.{side}" for side in "ab"]
        for f in files:
            body = "".join(rng.choice(["x", "é", "long words here", "", "\r", "😀"]) + rng.choice(["\n", "\r\n", "\n\n"]) for _ in range(rng.randrange(0, 25)))
            f.write_bytes((b"\xef\xbb\xbf" if rng.random() < 0.5 else b"") + body.encode() + rng.choice([b"", b"no end", b"end\r", b"\xff\xfe"]))
        want = list(zip(*[plain(f) for f in files], strict=False))
        found = aligned_source.AlignedFiles(spark, *map(str, files), block)
        assert found.lengths == tuple(len(plain(f)) for f in files)
        got = sorted(map(tuple, found.lines().collect()))
        assert got == [(i, *x) for i, x in enumerate(want)]
        a = rng.randrange(0, len(want) + 2)
        assert sorted(map(tuple, found.lines(a, a + 4).collect())) == got[a:a + 4]
    direct = spark.read.format("moses").option("source", str(files[0])).option("target", str(files[1])).option("blockBytes", str(block)).load()
    assert sorted(map(tuple, direct.collect())) == got and direct.columns == ["line_no", "source_raw", "target_raw"]
