"""Text functions of the phrase table as Column expressions.

Every function takes a Column and gives a Column, all from built-in functions, so they
stay inside generated code.  Word characters and white space are ASCII in the patterns that
say so; ``BOUND`` is a word boundary between ASCII word characters and anything else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUND = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
SPACE = r"[\t-\r\x20]"
#: White space at ends: ASCII blanks, NEL and every Unicode separator.
EDGE = r"[\t-\r\x20\x85\p{Z}]"

# Contractions and their expansions, in the order in which they apply.
CONTRACTIONS = [
    ("can't", "cannot"),
    ("won't", "will not"),
    ("n't", " not"),
    ("i'm", "i am"),
]
SUFFIXES = [("re", " are"), ("ll", " will"), ("ve", " have"), ("d", " would"), ("s", "")]
OPTIONAL_WORDS = ["a", "an", "the", "please", "just"]


def trim_all(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{EDGE}+|{EDGE}+\z", "")


def normalize_whitespace(x: Column) -> Column:
    """Runs of ASCII white space become one space; the ends are trimmed of all white space."""
    return trim_all(F.regexp_replace(x, rf"{SPACE}+", " "))


def expand_contractions(x: Column) -> Column:
    for short, long in CONTRACTIONS:
        x = F.regexp_replace(x, f"{BOUND}{short}{BOUND}", long)
    for suffix, long in SUFFIXES:
        x = F.regexp_replace(x, rf"{BOUND}(\w+)'{suffix}{BOUND}", "$1" + long)
    return x


def normalize_for_lookup(x: Column) -> Column:
    """The form in which phrases are stored and looked up.

    Contractions and hyphens are only looked for in texts that have an apostrophe or a hyphen.
    """
    x = F.translate(F.lower(x), "‘’“”", "''\"\"")
    x = F.when(F.contains(x, F.lit("'")), expand_contractions(x)).otherwise(x)
    x = F.regexp_replace(x, r"[.,;:!?()\[\]{}\"']", " ")
    x = F.when(F.contains(x, F.lit("-")), F.regexp_replace(x, r"(?<=\p{L})-(?=\p{L})", " ")).otherwise(x)
    return normalize_whitespace(x)


def split_spaces(x: Column) -> Column:
    return F.filter(F.split(x, f"{SPACE}+"), lambda w: w != "")


def words(x: Column) -> Column:
    return split_spaces(normalize_for_lookup(x))


def compact(phrase_words: Column) -> Column:
    return F.filter(phrase_words, lambda w: ~w.isin(OPTIONAL_WORDS))


def lookup_candidates(phrase_words: Column) -> Column:
    """[exact] or [exact, compact]: the phrase itself, then without optional words if that leaves two or more."""
    short = compact(phrase_words)
    exact = normalize_for_lookup(F.array_join(phrase_words, " "))
    brief = F.when(F.size(short) >= 2, normalize_for_lookup(F.array_join(short, " ")))
    return F.array_distinct(F.filter(F.array(exact, brief), lambda c: c.isNotNull() & (c != "")))


def split_sentences(x: Column) -> Column:
    return F.filter(F.split(normalize_whitespace(x), rf"[.!?]+{SPACE}*"), lambda s: s != "")


# Characters beyond the basic plane count as two units, none of them a letter.
PAIRS = r"[\x{10000}-\x{10FFFF}]"


def units(x: Column) -> Column:
    """``x`` with each character beyond the basic plane as two section signs: its UTF-16 shape."""
    return F.regexp_replace(x, PAIRS, "§§")


def unit_length(x: Column) -> Column:
    return F.length(units(x))


def has_letters(x: Column) -> Column:
    return units(x).rlike(r"\p{L}")


def is_all_caps(x: Column) -> Column:
    return units(x).rlike(r"\p{L}") & ~units(x).rlike(r"\p{Ll}")


def starts_upper(x: Column) -> Column:
    return units(x).rlike(r"^[^\p{L}]*\p{Lu}")


def uppercase_first(x: Column) -> Column:
    """Upper-case the first letter, where that is a single character."""
    head = r"(?s)^((?:[^\p{L}]|" + PAIRS + r")*)(\p{L})(.*)\z"
    first = F.regexp_extract(x, head, 2)
    raised = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(first)
    return F.when(x.rlike(head) & ~first.rlike(PAIRS), F.concat(F.regexp_extract(x, head, 1), raised, F.regexp_extract(x, head, 3))).otherwise(x)


def apply_capitalization(source: Column, translation: Column) -> Column:
    return (F.when(~has_letters(source) | (translation == ""), translation)
            .when(is_all_caps(source), F.upper(translation))
            .when(starts_upper(source), uppercase_first(translation)).otherwise(translation))


TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'’_-]*"


def word_tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({TOKEN})"), 1)


def inline_marks(x: Column) -> Column:
    """Per word the commas, semicolons and colons that follow it before the next word."""
    pieces = F.regexp_extract_all(x, F.lit(rf"({TOKEN}|[,;:])"), 1)
    start = F.array().cast("array<string>")
    is_mark = lambda p: p.isin(",", ";", ":")
    extend = lambda acc, p: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), p)))
    return F.aggregate(pieces, start, lambda acc, p: F.when(~is_mark(p), F.concat(acc, F.array(F.lit("")))).when(F.size(acc) == 0, acc).otherwise(extend(acc, p)))


def reapply_marks(source: Column, translation: Column) -> Column:
    """Put the source's inline marks after the words of the translation at the same ordinals."""
    parts = split_spaces(translation)

    def with_marks(marks: Column) -> Column:
        mark = lambda i: F.coalesce(F.get(marks, i), F.lit(""))
        joined = F.array_join(F.transform(parts, lambda w, i: F.when(F.endswith(w, mark(i)), w).otherwise(F.concat(w, mark(i)))), " ")
        return F.when((F.size(marks) == 0) | (F.size(parts) == 0), translation).otherwise(joined)

    return F.get(F.transform(F.array(inline_marks(source)), with_marks), F.lit(0))


def leading_wrappers(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, rf"^((?:[\"(\[{{']|{EDGE})*)", 1), f"{EDGE}+", "")


def trailing_wrappers(x: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(x, rf"((?:[\")\]}}']|{EDGE})*)\z", 1), f"{EDGE}+", "")


def import_key(source_file: Column, target_file: Column, source_lang: Column, target_lang: Column) -> Column:
    return F.sha2(F.concat_ws("|", source_file, target_file, source_lang, target_lang), 256)


# Tokenizer names for the same functions.
split_words = words
clean_basic_punctuation = normalize_for_lookup
clean_text = normalize_whitespace
normalized_source_text = normalize_for_lookup
