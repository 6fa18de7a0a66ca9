"""The phrase table: build, merge, clean, rank and describe.

Schema: id, source_text, translated_text, source_lang, target_lang, frequency; unique in the
four text columns by construction.  Ids follow first appearance, so ties in ranking are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions.lang import lookup_variants, normalize_language
from glosswork.functions.quality import Side, cleanup_rules, first_reason, has_of, import_rules, is_invalid_stored_pair, side
from glosswork.functions.text import normalize_for_lookup, normalize_whitespace, units
from glosswork.operators.numbering import number_rows

KEY = ["source_text", "translated_text", "source_lang", "target_lang"]
SCHEMA = "id bigint, source_text string, translated_text string, source_lang string, target_lang string, frequency bigint"
PAIR_LIMIT = 20


def bidirectional(lines: DataFrame) -> DataFrame:
    """Aligned lines (source_lang, target_lang, line_no, source_raw, target_raw) in both directions, in one pass."""
    forth = F.struct(F.col("source_lang"), F.col("target_lang"), F.col("source_raw"), F.col("target_raw"))
    back = F.struct(F.col("target_lang").alias("source_lang"), F.col("source_lang").alias("target_lang"), F.col("target_raw").alias("source_raw"), F.col("source_raw").alias("target_raw"))
    return lines.select("line_no", F.explode(F.array(forth, back)).alias("d")).select("d.source_lang", "d.target_lang", "line_no", "d.source_raw", "d.target_raw")


def judged_lines(raw_pairs: DataFrame) -> DataFrame:
    """Cleaned lines with their languages canonical, the normalised source and the first reason to reject (null: kept)."""
    # A generator keeps what it makes computed once: a filter on it can't be pushed below it and repeat it in every rule.
    clean = F.struct(
        normalize_language(F.col("source_lang")).alias("source_lang"), normalize_language(F.col("target_lang")).alias("target_lang"), F.col("line_no"),
        normalize_whitespace("source_raw").alias("source_clean"), normalize_whitespace("target_raw").alias("translated_text"))
    clean = raw_pairs.select(F.explode(F.array(clean)).alias("c")).select("c.*")
    shaped = F.struct(
        *clean.columns, normalize_for_lookup("source_clean").alias("source_text"), normalize_for_lookup("translated_text").alias("target_norm"),
        units(F.col("source_clean")).alias("source_shape"), units(F.col("translated_text")).alias("target_shape"),
        has_of(F.col("source_clean")).alias("source_has"), has_of(F.col("translated_text")).alias("target_has"))
    shaped = clean.select(F.explode(F.array(shaped)).alias("c")).select("c.*")
    source = Side(F.col("source_clean"), F.col("source_shape"), F.col("source_text"), F.col("source_has"))
    target = Side(F.col("translated_text"), F.col("target_shape"), F.col("target_norm"), F.col("target_has"))
    return shaped.withColumn("reason", first_reason(import_rules(source, target))).drop("target_norm", "source_shape", "target_shape", "source_has", "target_has")


def import_pairs(raw_pairs: DataFrame) -> DataFrame:
    """Lines that pass the import filter: line_no and the four text columns."""
    return judged_lines(raw_pairs).where("reason is null").select("line_no", *KEY)


def count_pairs(pairs: DataFrame) -> DataFrame:
    """Upsert by counting: one row for each pair with first_line and frequency."""
    return pairs.groupBy(*KEY).agg(F.min("line_no").alias("first_line"), F.count("*").alias("frequency"))


def with_ids(counted: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """Ids from ``start`` + 1 in the given order."""
    keys = [*order, *[k for k in KEY if k not in order]]
    return number_rows(counted, keys, name="id", start=start).select("id", *KEY, "frequency")


def unnumbered(pairs: DataFrame) -> DataFrame:
    """The phrase table of imported pairs for ranking alone: what ids would follow stands in their place, and nothing is sorted or numbered."""
    counted = count_pairs(pairs)
    order = F.struct("source_lang", "target_lang", "first_line", "source_text", "translated_text")
    return counted.select(order.alias("id"), *KEY, "frequency")


def build(pairs: DataFrame) -> DataFrame:
    """The phrase table of imported pairs; ids by language pair, then first line."""
    return with_ids(count_pairs(pairs), ["source_lang", "target_lang", "first_line"])


def upsert(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add imported pairs: known ones gain frequency and keep their id, new ones follow in line order."""
    fresh = count_pairs(pairs)
    top = table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    gained = table.join(fresh.select(*KEY, F.col("frequency").alias("more")), KEY, "left").select(
        "id", *KEY, (F.col("frequency") + F.coalesce("more", F.lit(0))).alias("frequency"))
    new = fresh.join(table.select(*KEY), KEY, "left_anti")
    return gained.unionByName(with_ids(new, ["first_line"], top))


def import_stats(raw_pairs: DataFrame, existing: DataFrame | None = None, resumed: int = 0) -> DataFrame:
    """One row: processed, inserted, updated_frequency, ignored, duplicate, resumed.

    The lines are judged and counted in one pass; rejected ones, whatever their texts, are one row of each partial sum.
    """
    pair = F.when(F.col("reason").isNull(), F.struct(*KEY))
    counted = judged_lines(raw_pairs).groupBy(pair.alias("pair")).agg(F.count("*").alias("n"))
    if existing is not None:
        known = existing.select(F.struct(*KEY).alias("pair")).distinct().withColumn("known", F.lit(True))
        counted = counted.join(known, "pair", "left")
    kept = F.col("pair").isNotNull()
    first = F.when(kept, F.lit(1) if existing is None else F.when(F.col("known"), 0).otherwise(1)).otherwise(0)
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("bigint")
    again = whole(F.when(kept, F.col("n") - first))
    return counted.agg(
        (whole(F.col("n")) + resumed).alias("processed"), whole(first).alias("inserted"), again.alias("updated_frequency"),
        whole(F.when(~kept, F.col("n"))).alias("ignored"), again.alias("duplicate"), F.lit(resumed).cast("bigint").alias("resumed"))


def conform(table: DataFrame) -> DataFrame:
    """A legacy table without frequency counts each of its rows once."""
    out = table if "frequency" in table.columns else table.withColumn("frequency", F.lit(1))
    return out.withColumn("frequency", F.coalesce(F.col("frequency"), F.lit(1)).cast("bigint"))


def duplicate_rows(table: DataFrame) -> DataFrame:
    """One row, duplicates: how many rows repeat another's pair."""
    return table.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def merge_duplicates(table: DataFrame) -> DataFrame:
    """One row for each pair, frequencies added."""
    return conform(table).groupBy(*KEY).agg(F.sum("frequency").cast("bigint").alias("frequency"))


def normalize_languages(table: DataFrame) -> DataFrame:
    """Stored language codes made canonical, pairs that thereby meet merged."""
    return merge_duplicates(table.withColumns({"source_lang": normalize_language(F.col("source_lang")), "target_lang": normalize_language(F.col("target_lang"))}))


def migrate(table: DataFrame) -> tuple[DataFrame, bool]:
    """A table of any older form as :data:`SCHEMA` wants it, and whether that changed anything.

    Older forms lack the frequency (each row then counts once) or the ids, hold codes that are not canonical, or several rows of one pair.
    A table that is as wanted comes back as it is, counts and ids included.
    """
    codes = [F.col(c) != normalize_language(F.col(c)) for c in ("source_lang", "target_lang")]
    whole = {"id", "frequency"} <= set(table.columns) and not table.where("id is null or frequency is null").limit(1).count()
    if whole and not table.where(codes[0] | codes[1]).limit(1).count() and not duplicate_rows(table).first()[0]:
        return table, False
    return with_ids(normalize_languages(table), KEY), True


def cleanup(table: DataFrame) -> DataFrame:
    """Rows that the cleanup filter leaves."""
    return table.where(~is_invalid_stored_pair(F.col("source_text"), F.col("translated_text")))


def cleanup_reasons(table: DataFrame) -> DataFrame:
    return table.withColumn("reason", first_reason(cleanup_rules(side(F.col("source_text")), side(F.col("translated_text")))))


def cleanup_stats(table: DataFrame) -> DataFrame:
    """One row: removed_invalid_entries, removed_duplicates, final_translations_count."""
    tagged = table.withColumn("bad", is_invalid_stored_pair(F.col("source_text"), F.col("translated_text")))
    groups = tagged.groupBy(*KEY, "bad").agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(F.col("bad"), F.col("n"))), F.lit(0)).cast("bigint").alias("removed_invalid_entries"),
        F.coalesce(F.sum(F.when(~F.col("bad"), F.col("n") - 1)), F.lit(0)).cast("bigint").alias("removed_duplicates"),
        F.count_if(~F.col("bad")).cast("bigint").alias("final_translations_count"))


def rank_order() -> Column:
    return F.struct((-F.col("frequency")).alias("f"), F.length("translated_text").alias("n"), F.col("id").alias("id"))


def best_translations(table: DataFrame) -> DataFrame:
    """The lookup table: per languages and source text the most frequent, then shortest, then oldest translation.

    A min-by aggregation: partial results combine before the shuffle, so a common phrase is no hot key.
    """
    best = F.min_by(F.struct("translated_text", "frequency", "id"), rank_order()).alias("best")
    return table.groupBy("source_lang", "target_lang", "source_text").agg(best).select("source_lang", "target_lang", "source_text", "best.*")


def in_languages(table: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    return table.where(
        F.array_contains(lookup_variants(F.lit(source_lang)), F.col("source_lang")) & F.array_contains(lookup_variants(F.lit(target_lang)), F.col("target_lang")))


def find_translations(table: DataFrame, texts: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """(source_text, translated_text) for the normalised, distinct, non-empty ``texts.text`` that the table holds."""
    wanted = texts.select(normalize_for_lookup(F.col("text")).alias("source_text")).where("source_text <> ''").distinct()
    rows = in_languages(table, source_lang, target_lang).join(wanted, "source_text", "left_semi")
    best = F.min_by(F.col("translated_text"), rank_order()).alias("translated_text")
    return rows.groupBy("source_text").agg(best)


def find_translation(table: DataFrame, text: str, source_lang: str, target_lang: str) -> str | None:
    """The translation of one text, or None."""
    one = table.sparkSession.createDataFrame([(text,)], "text string")
    row = find_translations(table, one, source_lang, target_lang).first()
    return row["translated_text"] if row else None


def available_languages(table: DataFrame) -> DataFrame:
    both = table.select(F.col("source_lang").alias("lang")).union(table.select(F.col("target_lang").alias("lang")))
    return both.where("lang is not null and lang <> ''").distinct().orderBy("lang")


def available_pairs(table: DataFrame) -> DataFrame:
    return table.groupBy("source_lang", "target_lang").agg(F.count("*").alias("translation_count")).orderBy("source_lang", "target_lang")


def has_pair(table: DataFrame, source_lang: str, target_lang: str) -> bool:
    return in_languages(table, source_lang, target_lang).limit(1).count() > 0


def pairs_found(table: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (source_lang, target_lang) with found: whether the table has rows under any of the codes' variants."""
    stored = table.select(F.col("source_lang").alias("s"), F.col("target_lang").alias("t")).distinct()
    variants = asked.distinct().select("source_lang", "target_lang", F.explode(lookup_variants(F.col("source_lang"))).alias("s")).select(
        "source_lang", "target_lang", "s", F.explode(lookup_variants(F.col("target_lang"))).alias("t"))
    there = variants.join(stored, ["s", "t"], "left_semi").select("source_lang", "target_lang").distinct().withColumn("there", F.lit(True))
    return asked.join(there, ["source_lang", "target_lang"], "left").select("source_lang", "target_lang", F.coalesce("there", F.lit(False)).alias("found"))


def count_by_pair(table: DataFrame) -> DataFrame:
    """source_lang, target_lang, translation_count, total_frequency."""
    return table.groupBy("source_lang", "target_lang").agg(F.count("*").alias("translation_count"), F.sum("frequency").cast("bigint").alias("total_frequency"))


def table_summary(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("translation_count"), F.coalesce(F.sum("frequency"), F.lit(0)).cast("bigint").alias("total_frequency"))


def summary_of_pairs(pairs: DataFrame) -> DataFrame:
    """:func:`table_summary` from the counts by language pair."""
    return pairs.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("translation_count", "total_frequency")])


def pair_lines(pairs: DataFrame) -> DataFrame:
    """The first ``PAIR_LIMIT`` of counted language pairs with a line to print (fixed format)."""
    line = F.format_string("%s -> %s (%d pares, frequência %d)", "source_lang", "target_lang", "translation_count", "total_frequency")
    return pairs.withColumn("line", line).orderBy("source_lang", "target_lang").limit(PAIR_LIMIT)


def pair_summary(table: DataFrame) -> DataFrame:
    return pair_lines(count_by_pair(table))
