"""Import of arriving files: the two sides of a pair wait for each other, then both directions are imported.

Only file names pass through the stream.  A pair's side that has arrived is keyed state until the other one is there.  What a micro-batch completes
is imported by the store's own driver, each direction with its progress in one manifest; the batch's number follows in a
manifest of its own.  A batch that Spark repeats after a loss finds its number, or its imports' progress, and counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glosswork.functions.lang import normalize_language
from glosswork.operators.store import PhraseStore
from glosswork.sources.moses import parse_name

FOUND = "corpus_name string, source_file string, target_file string, source_lang string, target_lang string"
WAITING = "source_file string, target_file string"
FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arrivals(spark: SparkSession, directory: str, files_a_batch: int = 1000) -> DataFrame:
    """(path, corpus_name, lang_pair, source_lang, target_lang, language) of the files that appear in a folder; contents are not read."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", str(files_a_batch)).load(directory)
    named = found.select("path").withColumns(parse_name(F.element_at(F.split("path", "/"), -1)))
    return named.where(F.col("valid") & (F.col("source_lang") != F.col("target_lang"))).drop("valid")


def meet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The pair of one corpus and language pair, as soon as both sides are there, once."""
    corpus, _, source_lang, target_lang = key
    sides = dict(zip(("source_file", "target_file"), state.get, strict=True)) if state.exists else {"source_file": None, "target_file": None}
    was_whole = all(sides.values())
    for batch in batches:
        for path, language in zip(batch["path"], batch["language"], strict=True):
            side = "source_file" if language == source_lang else "target_file"
            sides[side] = sides[side] or path
    state.update((sides["source_file"], sides["target_file"]))
    if all(sides.values()) and not was_whole:
        yield pd.DataFrame([(corpus, sides["source_file"], sides["target_file"], source_lang, target_lang)], columns=[c.split()[0] for c in FOUND.split(", ")])


def pairs(named: DataFrame) -> DataFrame:
    return named.groupBy("corpus_name", "lang_pair", "source_lang", "target_lang").applyInPandasWithState(meet, FOUND, WAITING, "append", GroupStateTimeout.NoTimeout)


def import_stream(spark: SparkSession, directory: str, store: PhraseStore, checkpoint: str, once: bool = False, name: str = "arrivals"):
    """Start a query that imports the pairs of files that appear in ``directory``, both ways, into ``store``."""
    def batch(found: DataFrame, number: int) -> None:
        canonical = found.withColumns({c: normalize_language(F.col(c)) for c in ("source_lang", "target_lang")})
        # File names, a batch's worth; they are made even for a batch that is done, as its state is.
        rows = canonical.orderBy("corpus_name", "source_lang", "target_lang").collect()
        if store.stream_position(name) < number:
            for r in rows:
                store.import_both(r["source_file"], r["target_file"], r["source_lang"], r["target_lang"])
            store.save_stream_position(name, number)

    store.create()
    writer = pairs(arrivals(spark, directory)).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
