"""Language codes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim_all

TOKEN = r"^[A-Za-z]{2,3}(?:_[A-Za-z0-9]{2,8})?$"
BRAZILIAN = "pt_BR"


def underscored(code: Column) -> Column:
    return F.translate(trim_all(code), "-", "_")


def normalize_language(code: Column) -> Column:
    """The canonical form of a code: region kept as lower_UPPER but for pt, en, fr and es."""
    lower = F.lower(underscored(code))
    base = F.element_at(F.split(lower, "_"), 1)
    parts = F.filter(F.split(lower, "_"), lambda p: p != "")
    return (F.when(lower == "", "")
            .when((base == "pt") | lower.isin("por", "ptbr"), BRAZILIAN)
            .when(base.isin("en", "fr", "es"), base)
            .when(F.size(parts) >= 2, F.concat(F.element_at(parts, 1), F.lit("_"), F.upper(F.element_at(parts, 2))))
            .otherwise(lower))


def lookup_variants(code: Column) -> Column:
    """Codes under which stored rows may be found; none for an empty code."""
    canonical, lower = normalize_language(code), F.lower(underscored(code))
    more = F.when(canonical == BRAZILIAN, F.array(F.lit("pt_br"), F.lit("pt"))).otherwise(F.array().cast("array<string>"))
    return F.when(canonical == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(canonical, lower), more)))


def is_language_token(token: Column) -> Column:
    return token.rlike(TOKEN)
