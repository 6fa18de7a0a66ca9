"""Inputs of the registered queries: tables derived from the driver's, and literal rows.

Literal rows are plain tuples, so that queries and their SQL share them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions.text import normalize_for_lookup, normalize_whitespace, split_sentences, words
from glosswork.operators.numbering import number_rows
from glosswork.operators.phrase_table import KEY, bidirectional, import_pairs, with_ids
from glosswork.operators.shared import shared_folder

TARGETS = ["de", "es", "fr"]

CODES = ["pt", "pt-PT", "PT_br", "por", "por_BR", "ptbr", "en_US", "fr-CA", "es_MX", "zh-Hans-CN", "_en", "DE", "de-at", "eng", "", " en "]
TEXTS = [
    "Don't stop", "I can't do it", "won't, can't and n't", "I'm here", "They're late", "he'd've gone", "It's open-source!", "‘curly’ and “double” quotes",
    "x-1 stays", "a-b-c", "ação-é", "  tabs\tand\r\nbreaks  ", "¿qué?", "a/b+c#", "É isso", "WORLD", "I", "(hello), [you]; \"x\": y", "the best tool", "please just go",
    "the", "a, b; c: d", "{'quoted'}", "Olá, mundo; sim: não", "123 abc", "", "foo_bar-baz d’accord", "…—", "Straße and öl", "\"(Both)\"", "one,, two;: three",
]
PAIRS = [
    ("Open the file", "Abrir o arquivo"), ("", "x y"), ("a", "bb"), ("aa", "bb"), ("File!", "file"), ("<b>bold</b>", "negrito"), ("a &amp; b", "a e b"),
    ("color: red", "cor vermelha"), (".cls {", "classe"), ("#fff text", "texto branco"), ("see www.example.org", "veja o site"), ("git://host x", "um dois"),
    ("if (x) then", "se x"), ("a => b c", "a b c"), ("run {} now", "rodar agora"), ("Use %1 files", "Usar arquivos"), ("${HOME} path here", "caminho aqui"),
    ("Use the USA map", "Use o mapa"), ("the PID value", "o valor"), ("process  id here", "aqui mesmo"), ("Bearer of news", "portador"), ("your token please", "sua ficha"),
    ("a tooltip text", "um texto"), ("tool tip text", "outro texto"), ("C:\\dir file", "arquivo dir"), ("in /usr/ now", "em usr agora"), ("ab/cd.txt here", "aqui"),
    ("mail me@host.org now", "escreva agora"), ("unit synonyms for matching user input", "sinônimos"), ("wow!!!! yes", "uau sim"), ("a!!! b", "a b c"),
    ("1,234.56", "mil e tal"), ("no no no no", "não quatro"), ("no no no yes", "não três"), ("abcdefghijklmnopqrstuvwxyzabcdefghijk", "comprida"),
    ("ab😀 cd😀 ef", "ab cd ef"), ("😀😀", "duas caras"), ("x" * 40, "y z"), ("ab cd " * 83 + "ab", "longa demais"), ("ab cd " * 83 + "abc", "longa mesmo"), ("e\u0301a ba", "acento ok"),
]
STORED = [
    ("123 45", "cento e tal"), ("a a a a a", "cinco as"), ("a a a a", "quatro as"), ("bad\x01char", "controle"), ("lost \ufffd\ufffd x", "perdido"), ("ab cd " * 133 + "ab", "oitocentos"),
    ("ab cd " * 133 + "abc", "oitocentos e um"), ("if (x)", "se x aqui"), ("import {", "importar"), ("color: red", "cor vermelha"), ("pid here", "sem número"), ("PID 123 x", "com número"),
    ("token = abcdef123456", "segredo"), ("your token", "sua ficha"), ("tooltip: 'x'", "dica"), ("a tooltip", "uma dica"), ("me@host.org", "correio"), ("   ", "vazio"),
    ("same text", "Same, text!"), ("wow there!!!!! abc", "cinco sinais"), ("wow there!!!!!! abc", "seis sinais"), ("open file", "abrir arquivo"), ("while (1)", "enquanto um"), ("[[]] x yy", "colchetes"),
]
SEGMENTS = [
    "Mr. Smith left. He ran!", "Mr . X stays", "3.14 is pi. Yes", "e.g. this one. Done", "etc.. end", "...", "Wait?! \"Yes.\" No", "a.b", "(hi), [you]; \"x\"", "", "no end",
    "Dr. No vs. Prof. Yes. End.", "one.\ttwo", "x! )y", "1.2.3.", "i.e. so",
]
LINES = ["one line", "two\nlines", "\n", "  lead\ntrail  \n\n x ", "", "cr\r\nlf", "a\n\nb\n"]
TABLE = [
    (1, "aa", "aa xx", "en", "pt_BR", 3), (2, "aa", "b b", "en", "pt_BR", 3), (3, "aa", "yyyy", "en", "pt_BR", 5), (4, "aa", "zzzz", "en", "pt_BR", 5), (5, "hello world", "olá mundo", "en", "pt_BR", 2),
    (6, "open file", "abrir arquivo", "en", "pt_BR", 1), (7, "file", "arquivo", "en", "pt_BR", 4), (8, "file", "ficheiro", "en", "pt_BR", 4), (9, "the best tool", "a melhor ferramenta", "en", "pt_BR", 1),
    (10, "best tool", "melhor ferramenta", "en", "pt_BR", 9), (11, "world", "mundo", "en", "pt_BR", 1), (12, "olá", "hello", "pt_BR", "en", 1), (13, "file", "datei", "en", "de", 7),
    (14, "a b c d e f g h i j k l", "doze", "en", "pt_BR", 1), (15, "a b c d e f g h i j k l m", "treze", "en", "pt_BR", 1),
]
INPUTS = [
    "Hello, world!", "HELLO WORLD", "Open the file.", "please Open the file now", "Foo, file: bar", "open-source Foo", "a.b", "  (file)\n\nI", "\"Hello world.\"", "...", "",
    "The best tool; the Best, tool", "a b c d e f g h i j k l m", "a b c d e f g h i j k l", "unknown Words here", "File. Hello world! AA?", "line one file\r\n\r\nthe file ", "I'm x/y", "漢字", "[file] {aa}",
]
LEGACY = [
    ("file", "arquivo", "EN", "pt"), ("file", "arquivo", "en_US", "pt-br"), ("file", "arquivo", "en", "pt_BR"), ("file", "ficheiro", "en", "por"), ("datei", "file", "de", "en"),
    ("datei", "file", "de", "en"), ("wort", "word", "de-at", "en"),
]
FILES = [
    ("KDE4.en-pt_BR.en", 100, "hello"), ("KDE4.en-pt_BR.pt_BR", 120, "olá"), ("News.v2.de-en.de", 1000, "x y"), ("News.v2.de-en.en", 100, "x"), ("Big.de-fr.de", 1010, "x"), ("Big.de-fr.fr", 100, "y"),
    ("Half.en-es.en", 50, "x"), ("Tiny.en-fr.en", 7, "x"), ("Tiny.en-fr.fr", 8, "y"), ("Blank.en-fr.en", 80, "   "), ("Blank.en-fr.fr", 80, "y"), ("Wrong.en-fr.de", 80, "x"), ("Same.en-en.en", 80, "x"),
    ("nodots", 80, "x"), ("Case.en-fr.EN", 80, "x"), ("Case.en-fr.fr", 80, "x"), (".en-fr.en", 80, "x"), ("Bad.e1-fr.fr", 80, "x"), ("Long.eng-por_BR.eng", 80, "x"), ("Long.eng-por_BR.por_BR", 90, "x"),
]
LINES_A_FILE = 50_000


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents: lang, doc_id, pos, seg."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "seg"))
    return docs.select("lang", "doc_id", F.col("pos").cast("bigint").alias("pos"), "seg")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents and the literal texts: id, pos, text."""
    lit = literal(spark, TEXTS, "text string").select((-F.col("i") - 1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("pos"), "text")
    return segments(spark, sf_dir).select(F.col("doc_id").alias("id"), "pos", F.col("seg").alias("text")).union(lit)


def filter_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for the filters: kind, id, pos, text, white space cleaned."""
    lines = table(spark, sf_dir, "documents").select(F.lit("line").alias("kind"), F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pages = table(spark, sf_dir, "pages")
    parts = [lines.select("kind", "id", F.col("pos").cast("bigint").alias("pos"), "text")]
    parts += [pages.select(F.lit(c).alias("kind"), F.col("page_id").alias("id"), F.lit(0).cast("bigint").alias("pos"), F.col(c).alias("text")) for c in ("html", "url")]
    pairs = literal(spark, PAIRS, "source string, target string")
    parts += [pairs.select(F.lit(c).alias("kind"), F.col("i").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("pos"), F.col(c).alias("text")) for c in ("source", "target")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("text", normalize_whitespace("text"))


def parallel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for aligned files: sentence n of English beside sentence n of each other language."""
    numbered = number_rows(segments(spark, sf_dir), ["doc_id", "pos"], ["lang"], "line_no")
    left = numbered.where("lang = 'en'").select(F.col("lang").alias("source_lang"), "line_no", F.col("seg").alias("source_raw"))
    right = numbered.where(F.col("lang").isin(TARGETS)).select(F.col("lang").alias("target_lang"), "line_no", F.col("seg").alias("target_raw"))
    return left.join(right, "line_no").select("source_lang", "target_lang", "line_no", "source_raw", "target_raw")


def raw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bidirectional(parallel_lines(spark, sf_dir))


def imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_pairs(raw_pairs(spark, sf_dir))


def unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs as an import without its filter would store them: line_no and the four text columns."""
    lines = raw_pairs(spark, sf_dir).where("source_raw is not null and target_raw is not null")
    return lines.select("line_no", normalize_for_lookup(normalize_whitespace("source_raw")).alias("source_text"), normalize_whitespace("target_raw").alias("translated_text"), "source_lang", "target_lang")


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language codes in many spellings, from the documents' languages and sources, and the literal ones: id, n, code."""
    docs = table(spark, sf_dir, "documents")
    made = F.array("lang", F.upper("lang"), F.concat_ws("-", "lang", F.upper("lang")), F.concat_ws("_", "lang", "source"), F.concat(F.lit(" "), "lang", F.lit("-")), F.col("source"), F.concat_ws("-", F.lit("pt"), "lang"))
    lit = literal(spark, CODES, "code string").select((-F.col("i") - 1).cast("bigint").alias("id"), F.lit(0).alias("n"), "code")
    return docs.select(F.col("doc_id").alias("id"), F.posexplode(made).alias("n", "code")).union(lit)


def written_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with aligned files of the parallel lines, ``LINES_A_FILE`` lines each: docs0.en-de.en beside docs0.en-de.de, and so on."""
    lines = parallel_lines(spark, sf_dir).withColumn("part", F.floor((F.col("line_no") - 1) / LINES_A_FILE))
    sides = F.explode(F.array(*[F.struct(F.col(f"{side}_lang").alias("language"), F.col(f"{side}_raw").alias("value")) for side in ("source", "target")])).alias("s")
    named = lines.select(F.format_string("docs%d.en-%s", "part", "target_lang").alias("pair"), "line_no", sides).select(F.concat_ws(".", "pair", "s.language").alias("file"), "line_no", "s.value")
    folder = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    # A file is one task's, of bounded length; its only part is then given the file's name.
    named.repartition("file").sortWithinPartitions("file", "line_no").select("file", "value").write.partitionBy("file").text(f"{folder}/parts")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for made in fs.listStatus(path(f"{folder}/parts")):
        if made.isDirectory():
            name = made.getPath().getName().removeprefix("file=")
            part = next(f.getPath() for f in fs.listStatus(made.getPath()) if f.getPath().getName().startswith("part-"))
            fs.rename(part, path(f"{folder}/{name}"))
    fs.delete(path(f"{folder}/parts"), True)
    return folder.removeprefix("file://") if folder.startswith("file:") else folder


def small_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that the benchmark's sentences begin with, and the literal table: from English to Brazilian Portuguese."""
    own = table(spark, sf_dir, "benchmark").select(F.explode(split_sentences(F.col("text"))).alias("s")).select(words(F.col("s")).alias("w"))
    phrases = own.select(F.explode(F.array(*[F.array_join(F.slice("w", a, n), " ") for a, n in ((1, 1), (1, 2), (2, 3))])).alias("source_text")).where("source_text <> ''")
    counted = phrases.groupBy("source_text").agg(F.count("*").alias("frequency")).select(
        "source_text", F.concat(F.lit("x"), "source_text").alias("translated_text"), F.lit("en").alias("source_lang"), F.lit("pt_BR").alias("target_lang"), "frequency")
    return with_ids(counted, KEY, 100).union(literal_table(spark))


def literal_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TABLE, "id bigint, source_text string, translated_text string, source_lang string, target_lang string, frequency bigint")


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to translate from English to each of ``TARGETS``: conversations by conv_id and turn, benchmark items with turn -1."""
    conversations = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(-1).cast("bigint").alias("turn"), "text")
    targets = F.explode(F.array(*[F.lit(t) for t in TARGETS])).alias("target_lang")
    return conversations.union(items).select("*", F.lit("en").alias("source_lang"), targets)
