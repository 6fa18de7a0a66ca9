"""Aligned text files: directory scan and line-by-line reader.

File names are CORPUS.src-tgt.lang.  Only file names, sizes and first lines pass the driver; contents are
read by Spark.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glosswork.functions.lang import is_language_token, normalize_language
from glosswork.functions.text import trim_all
from glosswork.sources.aligned import aligned_files

MIN_SIZE, MAX_RATIO = 8, 10.0
ENVIRONMENT = "GLOSSWORK_DATASETS_PATH"


class MisalignedError(ValueError):
    """One of two aligned files has more lines than the other."""


class ResumeError(ValueError):
    """The point to resume at lies beyond the end of the files."""


def parse_name(name: Column) -> dict[str, Column]:
    """Columns corpus_name, lang_pair, source_lang, target_lang, language and valid of a file name."""
    dots = F.split(name, r"\.", -1)
    n = F.size(dots)
    language = F.when(n >= 2, F.element_at(dots, -1)).otherwise("")
    pair = F.when(n >= 3, F.get(dots, n - 2)).otherwise("")
    corpus = F.when(n >= 3, F.array_join(F.slice(dots, 1, F.greatest(n - 2, F.lit(0))), ".")).otherwise("")
    source, target = F.substring_index(pair, "-", 1), F.regexp_extract(pair, r"^[^-]*-(.*)\z", 1)
    valid = ((corpus != "") & pair.contains("-") & is_language_token(language) & is_language_token(source) & is_language_token(target)
             & ((language == source) | (language == target)))
    return {"corpus_name": corpus, "lang_pair": pair, "source_lang": source, "target_lang": target, "language": language, "valid": F.coalesce(valid, F.lit(False))}


def is_readable(size: Column, first_line: Column) -> Column:
    """At least MIN_SIZE bytes and a first line that is not blank."""
    return (size >= MIN_SIZE) & (trim_all(F.coalesce(first_line, F.lit(""))) != "")


def is_coherent(a: Column, b: Column) -> Column:
    """Sizes at least MIN_SIZE, the larger at most MAX_RATIO times the smaller."""
    return (F.least(a, b) >= MIN_SIZE) & (F.greatest(a, b).cast("double") / F.least(a, b) <= MAX_RATIO)


def datasets(listing: DataFrame) -> DataFrame:
    """Pairs in a listing (file_path, file_name, size, first_line): corpus_name, source_language, target_language, source_file, target_file.

    Both sides of a pair must be there, readable and of coherent size.
    """
    parsed = listing.withColumns(parse_name(F.col("file_name"))).where("valid").where(is_readable(F.col("size"), F.col("first_line")))
    side = lambda which: parsed.where(F.col("language") == F.col(f"{which}_lang")).groupBy("corpus_name", "lang_pair", "source_lang", "target_lang").agg(
        F.min(F.struct("file_name", "file_path", "size")).alias(which))
    both = side("source").join(side("target"), ["corpus_name", "lang_pair", "source_lang", "target_lang"])
    coherent = both.where(is_coherent(F.col("source.size"), F.col("target.size")) & (F.col("source_lang") != F.col("target_lang")))
    return coherent.select(
        "corpus_name", normalize_language(F.col("source_lang")).alias("source_language"), normalize_language(F.col("target_lang")).alias("target_language"),
        F.col("source.file_path").alias("source_file"), F.col("target.file_path").alias("target_file")).distinct().orderBy("corpus_name", "source_language", "target_language")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """(file_path, file_name, size, first_line) of the files right in a directory; it is created if missing."""
    if "://" not in directory:
        os.makedirs(directory, exist_ok=True)
    schema = "file_path string, file_name string, size long, first_line string"
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(s.getPath().toUri().getPath() if "://" not in directory else str(s.getPath().toString()), s.getPath().getName(), s.getLen()) for s in fs.listStatus(path) if s.isFile()]
    if not rows:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame(sorted(rows), "file_path string, file_name string, size long")
    # Whole lines as they are, of any length and any bytes; only a file's first block is looked at.
    lines = spark.read.option("lineSep", "\n").text([r[0] for r in rows]).where("_metadata.file_block_start = 0")
    coded = F.replace(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit("+"), F.lit("%2B"))  # a URI's path, where a plus is itself
    named = lines.select(F.url_decode(coded).alias("file_name"), "value", F.monotonically_increasing_id().alias("nth"))
    heads = named.groupBy("file_name").agg(F.min_by("value", "nth").alias("first_line"))
    return files.join(heads, "file_name", "left").select("file_path", "file_name", "size", "first_line")


def scan(spark: SparkSession, directory: str) -> DataFrame:
    return datasets(list_files(spark, directory))


def has_dataset_files(directory: str) -> bool:
    return os.path.isdir(directory) and any(
        os.path.splitext(e.name)[1][1:] and e.is_file() and os.access(e.path, os.R_OK) and e.stat().st_size >= MIN_SIZE for e in os.scandir(directory))


def datasets_path(start: str | None = None, levels: int = 6) -> str:
    """The environment's folder, else the nearest ``datasets`` with files at or above ``start``, else ``start``'s own."""
    if os.environ.get(ENVIRONMENT, "").strip():
        return os.path.abspath(os.environ[ENVIRONMENT].strip())
    start = os.path.abspath(start or os.getcwd())
    for base in (start, os.getcwd()):
        here = base
        for _ in range(levels + 1):
            if has_dataset_files(os.path.join(here, "datasets")):
                return os.path.join(here, "datasets")
            here = os.path.dirname(here)
    return os.path.join(start, "datasets")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no from 0, value): lines end at LF, one CR before it is dropped.

    Numbers are offsets of file blocks, counted per block, plus the place within the block; no global sort.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r\\z", "").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
    counts = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("nth").alias("first"))
    # One row a block: this window is as long as the file has blocks.
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("block", "first", before.alias("before"))
    return lines.join(F.broadcast(offsets), "block").select((F.col("before") + F.col("nth") - F.col("first")).alias("line_no"), "value")


def zip_lines(source: DataFrame, target: DataFrame) -> DataFrame:
    """Lines of two numbered files side by side, up to the shorter one: line_no, source_raw, target_raw."""
    return source.select("line_no", F.col("value").alias("source_raw")).join(target.select("line_no", F.col("value").alias("target_raw")), "line_no")


def misalignment(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: source_lines, target_lines, aligned."""
    a, b = source.agg(F.count("*").alias("source_lines")), target.agg(F.count("*").alias("target_lines"))
    return a.crossJoin(b).withColumn("aligned", F.col("source_lines") == F.col("target_lines"))


def in_languages(lines: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Numbered line pairs as an import wants them."""
    return lines.select(F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"), "line_no", "source_raw", "target_raw")


def read_pair(spark: SparkSession, source_file: str, target_file: str, source_lang: str, target_lang: str, resume: int = 0) -> DataFrame:
    """Aligned lines of two files; raises if they do not align or end before ``resume``."""
    files = aligned_files(spark, source_file, target_file)
    if resume > min(files.lengths):
        raise ResumeError(f"cannot resume at line {resume} of {min(files.lengths)}")
    if files.lengths[0] != files.lengths[1]:
        raise MisalignedError(f"{source_file} has {files.lengths[0]} lines, {target_file} has {files.lengths[1]}")
    return in_languages(files.lines(resume), source_lang, target_lang)
