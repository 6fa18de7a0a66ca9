"""The registered queries of the phrase-table engine and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import lang, quality, text
from glosswork.operators import phrase_table as pt
from glosswork.operators import translate as tr
from glosswork.operators.shared import kept
from glosswork.plans import fixtures as fx
from glosswork.plans.oracle import ORACLE_SQL
from glosswork.sources import aligned, moses

ENTRY_QUERY = "translate_text"
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def joined(array: Column) -> Column:
    return F.array_join(array, "|")


def text_query(name: str, **columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.texts(spark, sf_dir).select("id", "pos", *[make(F.col("text")).alias(c) for c, make in columns.items()])

    QUERIES[name] = run


# Scalar text functions over all sentences and the literal texts.
text_query("norm_whitespace", norm=lambda x: text.normalize_whitespace(F.concat(F.lit(" \t"), x, F.lit("\n "))))
text_query("norm_lookup", norm=text.normalize_for_lookup)
text_query("words", words=lambda x: joined(text.words(x)), n=lambda x: F.size(text.words(x)).cast("bigint"))
text_query("lookup_candidates", candidates=lambda x: joined(text.lookup_candidates(text.words(x))))
text_query("split_sentences", sentences=lambda x: joined(text.split_sentences(x)))
text_query("case_class", letters=text.has_letters, caps=text.is_all_caps, upper_start=text.starts_upper)
text_query("capitalize", capital=text.uppercase_first, applied=lambda x: text.apply_capitalization(x, F.lit("xyz abc")))
text_query("word_tokens", tokens=lambda x: joined(text.word_tokens(x)))
text_query("inline_marks", marks=lambda x: joined(text.inline_marks(x)))
text_query("reapply_marks", marked=lambda x: text.reapply_marks(x, F.lit("um dois  três, quatro")))
text_query("wrappers", leading=text.leading_wrappers, trailing=text.trailing_wrappers)


@query
def import_key(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select("page_id", text.import_key(F.col("url"), F.concat(F.col("url"), F.lit(".b")), F.lit("en"), F.lit("pt_BR")).alias("import_key"))


# Language codes of the documents in many spellings, and literal ones.
def code_query(name: str, column: str, make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.codes(spark, sf_dir).select("id", "n", make(F.col("code")).alias(column))

    QUERIES[name] = run


code_query("lang_normalize", "canonical", lang.normalize_language)
code_query("lang_variants", "variants", lambda x: joined(lang.lookup_variants(x)))
code_query("lang_token_valid", "valid", lang.is_language_token)


# Sources: files written from the documents, beside literal listings.
def literal_listing(spark: SparkSession) -> DataFrame:
    return fx.literal(spark, fx.FILES, "file_name string, size bigint, first_line string").select(F.concat(F.lit("/d/"), "file_name").alias("file_path"), "file_name", "size", "first_line")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moses.list_files(spark, fx.written_files(spark, sf_dir)).union(literal_listing(spark))


@query
def dataset_parse_name(spark, sf_dir):
    return listing(spark, sf_dir).withColumns(moses.parse_name(F.col("file_name"))).where("valid").select("file_name", "corpus_name", "lang_pair", "language")


@query
def dataset_readable(spark, sf_dir):
    return listing(spark, sf_dir).select("file_name", "size", moses.is_readable(F.col("size"), F.col("first_line")).alias("readable"))


@query
def dataset_coherent(spark, sf_dir):
    """Each file beside those of the same language pair and corpus, itself included."""
    named = listing(spark, sf_dir).withColumn("pair", F.expr("substring_index(file_name, '.', 2)"))
    a, b = named.select("pair", F.col("file_name").alias("a"), F.col("size").alias("a_size")), named.select("pair", F.col("file_name").alias("b"), F.col("size").alias("b_size"))
    return a.join(b, "pair").select("a", "b", moses.is_coherent(F.col("a_size"), F.col("b_size")).alias("coherent"))


@query
def dataset_scan(spark, sf_dir):
    last = lambda c: F.element_at(F.split(c, "/"), -1).alias(c)
    found = moses.scan(spark, fx.written_files(spark, sf_dir)).union(moses.datasets(literal_listing(spark)))
    return found.select("corpus_name", "source_language", "target_language", last("source_file"), last("target_file"))


def pairs_of_files(spark: SparkSession, sf_dir: str) -> list:
    return moses.scan(spark, fx.written_files(spark, sf_dir)).collect()


@query
def moses_zip(spark, sf_dir):
    """All lines of all pairs of files, as the data source reads them side by side."""
    out = None
    for d in pairs_of_files(spark, sf_dir):
        lines = aligned.aligned_files(spark, d["source_file"], d["target_file"]).lines()
        lines = lines.select(F.lit(d["corpus_name"]).alias("corpus_name"), F.lit(d["target_language"]).alias("target_language"), "line_no", "source_raw", "target_raw")
        out = lines if out is None else out.union(lines)
    return out


@query
def moses_misaligned(spark, sf_dir):
    """The lengths of each source beside the targets of all language pairs of its corpus."""
    found, rows = pairs_of_files(spark, sf_dir), []
    for a in found:
        for b in (d for d in found if d["corpus_name"] == a["corpus_name"]):
            lengths = aligned.aligned_files(spark, a["source_file"], b["target_file"]).lengths
            rows.append((a["corpus_name"], a["target_language"], b["target_language"], *lengths, lengths[0] == lengths[1]))
    return spark.createDataFrame(rows, "corpus_name string, source_of string, target_language string, source_lines bigint, target_lines bigint, aligned boolean")


@query
def bidirectional_pairs(spark, sf_dir):
    return fx.raw_pairs(spark, sf_dir)


# Filters, each rule by itself over document lines, pages and literal pairs.
def filter_query(name: str, rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fx.filter_inputs(spark, sf_dir).select("kind", "id", "pos", rule(F.col("text")).alias("hit"))

    QUERIES[f"filter_{name}"] = run


filter_query("len", lambda x: (x == "") | quality.bad_length(quality.side(x)))
for _name, _pattern in quality.TECHNICAL.items():
    filter_query(_name, quality.matches(_pattern))
filter_query("symbols", lambda x: quality.too_many_symbols(quality.side(x)))
filter_query("strange", lambda x: quality.strange(quality.side(x)))


def stored_query(name: str, rule):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = fx.literal(spark, fx.STORED, "source string, target string").select(F.lit("lit").alias("kind"), F.col("i").cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("pos"), F.col("source").alias("text"))
        return fx.filter_inputs(spark, sf_dir).union(stored).select("kind", "id", "pos", rule(F.col("text")).alias("hit"))

    QUERIES[f"cleanup_{name}"] = run


stored_query("control", quality.control_noise)
stored_query("junk", lambda x: quality.any_of({n: x.rlike(p) for n, p in quality.STORED_JUNK.items()}))
stored_query("symbols", lambda x: quality.too_many_stored_symbols(quality.side(x)))
stored_query("broken", lambda x: quality.broken(quality.side(x)))


@query
def filter_same(spark, sf_dir):
    lines = fx.parallel_lines(spark, sf_dir).select("target_lang", "line_no", quality.same_text(quality.side(F.col("source_raw")), quality.side(F.col("target_raw"))).alias("hit"))
    pairs = fx.literal(spark, fx.PAIRS, "source string, target string").select(F.lit("lit").alias("target_lang"), F.col("i").cast("bigint").alias("line_no"), quality.same_text(quality.side(F.col("source")), quality.side(F.col("target"))).alias("hit"))
    return lines.union(pairs)


@query
def import_pair_rules(spark, sf_dir):
    pairs = fx.literal(spark, fx.PAIRS, "source string, target string").select(F.lit("lit").alias("target_lang"), F.col("i").cast("bigint").alias("line_no"), "source", "target")
    lines = fx.parallel_lines(spark, sf_dir).select("target_lang", "line_no", "source_raw", "target_raw").union(pairs)
    clean = lines.select("target_lang", "line_no", text.normalize_whitespace("source_raw").alias("s"), text.normalize_whitespace("target_raw").alias("t"))
    return clean.select("target_lang", "line_no", quality.is_valid_pair(F.col("s"), F.col("t")).alias("valid"))


@query
def cleanup_pair_rules(spark, sf_dir):
    pairs = fx.literal(spark, fx.STORED, "source string, target string").select(F.lit("lit").alias("source_lang"), F.lit("lit").alias("target_lang"), F.col("i").cast("bigint").alias("line_no"), "source", "target")
    lines = fx.unfiltered(spark, sf_dir).select("source_lang", "target_lang", "line_no", "source_text", "translated_text").union(pairs)
    return lines.select("source_lang", "target_lang", "line_no", quality.is_invalid_stored_pair(F.col("source_text"), F.col("translated_text")).alias("invalid"))


# The phrase table.
@query
def import_pipeline(spark, sf_dir):
    return fx.imported(spark, sf_dir)


@query
def import_stats(spark, sf_dir):
    return pt.import_stats(fx.raw_pairs(spark, sf_dir))


@query
def phrase_table_build(spark, sf_dir):
    return pt.build(fx.imported(spark, sf_dir))


@query
def best_translation(spark, sf_dir):
    return pt.best_translations(pt.build(fx.imported(spark, sf_dir)))


@query
def find_translation(spark, sf_dir):
    wanted = fx.segments(spark, sf_dir).where("lang = 'en'").select(F.col("seg").alias("text"))
    return pt.find_translations(pt.unnumbered(fx.imported(spark, sf_dir)), wanted, "en", "de")


@query
def duplicate_rows(spark, sf_dir):
    return pt.duplicate_rows(fx.imported(spark, sf_dir))


@query
def merge_duplicates(spark, sf_dir):
    return pt.merge_duplicates(fx.imported(spark, sf_dir).withColumn("frequency", F.lit(2)))


def legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of an older form: no frequency, a row for each occurrence, language codes in several spellings."""
    spelt = lambda c: F.when(F.length("translated_text") % 3 == 0, F.upper(c)).when(F.length("translated_text") % 3 == 1, F.concat(c, F.lit("-at"))).otherwise(F.col(c)).alias(c)
    own = fx.imported(spark, sf_dir).select("source_text", "translated_text", spelt("source_lang"), spelt("target_lang"))
    return own.union(fx.literal(spark, fx.LEGACY, "source_text string, translated_text string, source_lang string, target_lang string").drop("i"))


@query
def legacy_frequency(spark, sf_dir):
    return pt.merge_duplicates(legacy(spark, sf_dir))


@query
def normalize_stored_langs(spark, sf_dir):
    return pt.normalize_languages(legacy(spark, sf_dir))


@query
def cleanup_invalid(spark, sf_dir):
    return pt.cleanup(pt.build(fx.unfiltered(spark, sf_dir)))


@query
def cleanup_stats(spark, sf_dir):
    return pt.cleanup_stats(fx.unfiltered(spark, sf_dir))


@query
def table_summary(spark, sf_dir):
    return pt.table_summary(pt.merge_duplicates(fx.imported(spark, sf_dir)))


@query
def pair_summary(spark, sf_dir):
    return pt.pair_summary(pt.merge_duplicates(fx.imported(spark, sf_dir)))


@query
def available_languages(spark, sf_dir):
    return pt.available_languages(fx.imported(spark, sf_dir))


@query
def available_pairs(spark, sf_dir):
    return pt.available_pairs(pt.merge_duplicates(fx.imported(spark, sf_dir)))


@query
def has_pair(spark, sf_dir):
    asked = [("en", "de"), ("EN-gb", "fr"), ("de", "fr"), ("", "en")]
    return pt.pairs_found(fx.imported(spark, sf_dir), spark.createDataFrame(asked, "source_lang string, target_lang string"))


@query
def import_progress(spark, sf_dir):
    """Progress of imports asked for by key: of every page's two files, of which only some have been imported."""
    key = lambda target: text.import_key(F.col("url"), F.col("url"), F.lit("en"), F.lit(target)).alias("import_key")
    pages = fx.table(spark, sf_dir, "pages").where("url is not null")
    progress = pages.where("page_id % 3 <> 0").groupBy(key("de")).agg(F.max("page_id").alias("processed_lines"), F.min(F.col("page_id") % 2 == 0).alias("completed"))
    asked = pages.select(key("de")).union(pages.select(key("fr"))).distinct()
    found = asked.join(progress, "import_key", "left")
    return found.select("import_key", "processed_lines", "completed", F.col("processed_lines").isNotNull().alias("found"))


@query
def upsert(spark, sf_dir):
    """All pairs onto a table that has those from English already."""
    pairs = fx.imported(spark, sf_dir)
    return pt.upsert(kept(pt.build(pairs.where("source_lang = 'en'")), "existing"), pairs)


@query
def import_stats_existing(spark, sf_dir):
    existing = pt.build(fx.imported(spark, sf_dir).where("source_lang = 'en'"))
    return pt.import_stats(fx.raw_pairs(spark, sf_dir), existing)


# Matching and translation.
@query
def line_split(spark, sf_dir):
    lit = fx.literal(spark, fx.LINES, "text string").select((-F.col("i") - 1).cast("bigint").alias("id"), "text")
    docs = fx.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").union(lit)
    return tr.split_lines(docs, ["id"]).drop("line")


@query
def sentence_segments(spark, sf_dir):
    lit = fx.literal(spark, fx.SEGMENTS, "text string").select((-F.col("i") - 1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("turn"), "text")
    both = fx.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn", "text").union(lit)
    return both.select("id", "turn", F.posexplode(tr.sentence_segments(F.col("text"))).alias("seg_no", "s")).select("id", "turn", "seg_no", "s.text", "s.delimiter")


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.literal(spark, fx.INPUTS, "text string").select((-F.col("i") - 1).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("pos"), "text")
    items = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.posexplode(text.split_sentences(F.col("text"))).alias("pos", "text"))
    return rows.union(items.select("id", F.col("pos").cast("bigint"), "text")).withColumn("words", text.words(F.col("text")))


@query
def ngram_candidates(spark, sf_dir):
    return segment_words(spark, sf_dir).select("id", F.col("pos").alias("seg"), F.explode(tr.ngram_candidates(F.col("words"))).alias("c")).select("id", "seg", "c.*")


def small_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's sentences and the literal inputs, to be translated with the small table."""
    rows = segment_words(spark, sf_dir)
    return rows.select("id", F.col("pos").alias("seg"), F.lit("en").alias("source_lang"), F.lit("pt_BR").alias("target_lang"), "text", F.lit("").alias("delimiter"), "words")


def small_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tr.match_trace(small_segments(spark, sf_dir), ["id", "seg"], tr.lookup_table(fx.small_table(spark, sf_dir)))


@query
def best_match_at_pos(spark, sf_dir):
    return small_trace(spark, sf_dir)


@query
def match_type(spark, sf_dir):
    totals = small_segments(spark, sf_dir).select("id", "seg", F.size("words").alias("total"))
    return small_trace(spark, sf_dir).join(totals, ["id", "seg"]).select("id", "seg", "pos", "len", tr.match_type(F.col("pos"), F.col("len"), F.col("total"), F.col("variant")).alias("match_type"))


@query
def translate_segments(spark, sf_dir):
    return tr.translate_segments(small_segments(spark, sf_dir).drop("words"), ["id", "seg"], fx.small_table(spark, sf_dir)).drop("text", "delimiter")


@query
def translate_literals(spark, sf_dir):
    """Whole texts of the benchmark beside the literal inputs, lines and all."""
    lit = fx.literal(spark, fx.INPUTS, "text string").select((-F.col("i") - 1).cast("bigint").alias("id"), "text")
    rows = fx.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text").union(lit)
    return tr.translate(rows.select("id", "text", F.lit("en").alias("source_lang"), F.lit("pt").alias("target_lang")), fx.small_table(spark, sf_dir), ["id"])


@query
def match_trace(spark, sf_dir):
    table = pt.unnumbered(fx.imported(spark, sf_dir))
    worded = fx.inputs(spark, sf_dir).withColumn("words", text.words(F.col("text")))
    return tr.match_trace(worded, ["id", "turn", "target_lang"], tr.lookup_table(table))


@query
def translate_text(spark, sf_dir):
    return tr.translate(fx.inputs(spark, sf_dir), pt.unnumbered(fx.imported(spark, sf_dir)), ["id", "turn", "target_lang"])
