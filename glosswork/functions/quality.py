"""Quality filters for sentence pairs, each rule a named boolean Column.

Import rules read the raw text after white-space cleaning, cleanup rules the stored
row.  All patterns below are fixed values.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BOUND as B
from .text import PAIRS, SPACE, normalize_for_lookup, split_spaces, trim_all, units

CI = "(?iu)"
# Word boundaries beside a word character: before one, and behind one.  They cost less than the general one.
L, R = r"(?<!\w)", r"(?!\w)"
MARKUP = CI + r"</?\w+|&(?:[a-z]+|#\d+);|<!DOCTYPE|<\?xml"
CSS_TAIL = rf"|\.[A-Za-z0-9_-]+\s*\{{|#(?:[A-Fa-f0-9]{{3}}){{1,2}}{R}"
STYLE = CI + r"(?:^|[\s;])(?:margin|padding|font-size|background|color|display|width|height)\s*:" + CSS_TAIL
STORED_STYLE = CI + r"(?:^|[\s;])(?:margin|padding|font-size|background|display|width|height)\s*:" + CSS_TAIL
URL = CI + rf"(?:https?|ftp)://|www\.|{L}\w+://"
OPERATORS = r"(?:->|=>|::|==|!=|<=|>=|&&|\|\|)"
CODE = CI + rf"{L}(?:function|class|return|if|else|while|for|var|let|const|import|include){R}\s*[({{;]|{OPERATORS}|[{{}}\[\];]{{2,}}"
STORED_CODE = CI + rf"{L}(?:function|class|return|while|for|var|let|const|include){R}\s*[({{;]|{OPERATORS}|[{{}}\[\];]{{3,}}"
VARIABLE = rf"%\d+|%[A-Za-z_]+|\$\{{?\w+\}}?|\{{\d+\}}|@[A-Za-z_]+@|__[A-Za-z0-9_]+__|{L}[A-Z_]{{3,}}{R}"
PID = CI + rf"{L}PID{R}|{L}process\s+id{R}"
STORED_PID = CI + rf"{L}PID\s*[:=#]?\s*\d+{R}|{L}process\s+id\s*[:=#]?\s*\d+{R}"
AUTH = CI + rf"{L}Authorization{R}|{L}Bearer{R}|{L}OAuth{R}|{L}API[-_ ]?Key{R}|{L}token{R}"
STORED_AUTH = CI + rf"Authorization\s*:\s*(?:Bearer|Basic)|{L}Bearer\s+[A-Za-z0-9._\-]{{16,}}|{L}OAuth{R}|{L}API[-_ ]?Key\s*[:=]|{L}token\s*[:=]\s*[A-Za-z0-9._\-]{{12,}}"
TOOLTIP = CI + rf"{L}tooltip{R}|tool\s*tip"
STORED_TOOLTIP = CI + r"<[^>]*tooltip|tooltip\s*[:=]\s*['\"<{]"
PATH = rf"[A-Za-z]:\\|/\w+/|\.\.?/|\w+/\w+\.\w{{1,6}}{R}"
EMAIL = CI + rf"{B}[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{{2,}}{R}"
CATALOG = CI + r"unit\s+synonyms\s+for\s+matching\s+user\s+input|amount\s+in\s+units\s*\((?:real|integer)\)"
NUMBERS = r"^[\d\s.,:/_\-+]+$"
LONG_TOKEN = rf"{B}[A-Za-z0-9_./\\-]{{35,}}{B}"

TECHNICAL = {"markup": MARKUP, "style": STYLE, "url": URL, "code": CODE, "variable": VARIABLE, "pid": PID, "auth": AUTH,
             "tooltip": TOOLTIP, "path": PATH, "email": EMAIL, "catalog": CATALOG}
STORED_JUNK = {"markup": MARKUP, "style": STORED_STYLE, "url": URL, "code": STORED_CODE, "auth": STORED_AUTH, "pid": STORED_PID,
               "tooltip": STORED_TOOLTIP, "email": EMAIL, "catalog": CATALOG}
LONGEST, SHORTEST, STORED_LONGEST = 500, 2, 800
#: What is neither a letter nor a number nor white space, on the UTF-16 shape of a text.
SYMBOL = r"[^\p{L}\p{N}\t-\r\x20\x85\p{Z}]"


def repeated_token(times: int) -> str:
    return CI + rf"{L}(\w+){R}(?:\s+\1{R}){{{times - 1},}}"


#: What a text must have for a pattern to match at all: a mark of ``MARKS``, a word of ``WORDS`` in any case, or capitals.  Prose mostly has none.
MARKS = r"[<&:{#}\[\];(>=|%$@_/\\]"
WORDS = ["www", "pid", "process", "authorization", "bearer", "oauth", "api", "token", "tool", "unit"]
ODD_CASE = "[ſİı\u212a]"  # their lower case is not what a pattern takes them for
NEEDS = {"markup": "m", "style": "m", "url": "mw", "code": "m", "variable": "mc", "pid": "w", "auth": "w", "tooltip": "w", "path": "m", "email": "m", "catalog": "w"}


class Side(NamedTuple):
    """One text of a pair with its UTF-16 shape, its form for lookup, and what it has of what patterns need (a string of the letters of
    ``NEEDS``), each to be computed once by whoever has many rules to ask."""

    text: Column
    shape: Column
    norm: Column
    has: Column


def has_of(x: Column) -> Column:
    lower = F.lower(x)
    words = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in WORDS])
    flag = lambda test, letter: F.when(test, letter).otherwise("")
    return F.concat(flag(x.rlike(MARKS), "m"), flag(words | x.rlike(ODD_CASE), "w"), flag(x.rlike("[A-Z]{3}"), "c"))


def side(x: Column) -> Side:
    return Side(x, units(x), normalize_for_lookup(x), has_of(x))


def pattern_rule(name: str, pattern: str):
    """``pattern`` on the texts that have what it needs."""
    def rule(s: Side) -> Column:
        may = reduce(lambda a, b: a | b, [F.contains(s.has, F.lit(letter)) for letter in NEEDS[name]])
        return may & s.text.rlike(pattern)

    return rule


def either(rule, source: Side, target: Side) -> Column:
    return rule(source) | rule(target)


def matches(pattern: str):
    return lambda x: x.rlike(pattern)


def of_text(rule):
    return lambda s: rule(s.text)


def bad_length(s: Side) -> Column:
    n = F.length(s.shape)
    return (n > LONGEST) | (n < SHORTEST)


def same_text(source: Side, target: Side) -> Column:
    return (source.norm != "") & (source.norm == target.norm)


def symbol_count(s: Side) -> Column:
    return F.length(F.regexp_replace(s.shape, rf"[\p{{L}}\p{{N}}\t-\r\x20\x85\p{{Z}}]+", ""))


def no_letters(s: Side) -> Column:
    return ~s.shape.rlike(r"[\p{L}\p{N}]")


def ratio(n: Column, s: Side) -> Column:
    return n.cast("double") / F.greatest(F.length(s.shape), F.lit(1)).cast("double")


def too_many_symbols(s: Side) -> Column:
    return no_letters(s) | (ratio(symbol_count(s), s) > 0.35) | s.shape.rlike(SYMBOL + "{4,}")


def single_word_over(s: Side, most: int) -> Column:
    return (F.size(split_spaces(s.text)) == 1) & (F.length(s.shape) > most)


def strange(s: Side) -> Column:
    long_token = s.text.rlike(r"[A-Za-z0-9_./\\-]{35}") & s.text.rlike(LONG_TOKEN)
    return s.text.rlike(NUMBERS) | s.text.rlike(repeated_token(4)) | long_token | single_word_over(s, 40)


def import_rules(source: Side, target: Side) -> dict[str, Column]:
    """Reasons to reject a cleaned raw pair, in the order in which they are looked at."""
    rules = {"empty": either(lambda s: s.text == "", source, target), "length": either(bad_length, source, target), "same": same_text(source, target)}
    rules |= {name: either(pattern_rule(name, pattern), source, target) for name, pattern in TECHNICAL.items()}
    return rules | {"symbols": either(too_many_symbols, source, target), "strange": either(strange, source, target)}


def control_noise(x: Column) -> Column:
    return x.rlike(r"[\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]")


def too_many_stored_symbols(s: Side) -> Column:
    lost = F.length(F.regexp_replace(s.text, "[^�]", ""))
    return no_letters(s) | (ratio(symbol_count(s), s) > 0.45) | s.shape.rlike(SYMBOL + "{6,}") | (ratio(lost, s) > 0.05)


def broken(s: Side) -> Column:
    return s.text.rlike(repeated_token(5)) | s.text.rlike(NUMBERS) | single_word_over(s, 80)


def cleanup_rules(source: Side, target: Side) -> dict[str, Column]:
    """Reasons to delete a stored pair."""
    rules = {"blank": either(lambda s: trim_all(s.text) == "", source, target), "same": same_text(source, target),
             "length": either(lambda s: F.length(s.shape) > STORED_LONGEST, source, target), "control": either(of_text(control_noise), source, target)}
    rules |= {name: either(pattern_rule(name, pattern), source, target) for name, pattern in STORED_JUNK.items()}
    return rules | {"symbols": either(too_many_stored_symbols, source, target), "broken": either(broken, source, target)}


def any_of(rules: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a | b, rules.values())


def first_reason(rules: dict[str, Column]) -> Column:
    """The first rule that holds, else null: for diagnostics."""
    return F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])


def is_valid_pair(source: Column, target: Column) -> Column:
    return ~any_of(import_rules(side(source), side(target)))


def is_invalid_stored_pair(source: Column, target: Column) -> Column:
    return any_of(cleanup_rules(side(source), side(target)))


__all__ = ["PAIRS", "SPACE", "cleanup_rules", "first_reason", "import_rules", "is_invalid_stored_pair", "is_valid_pair"]
