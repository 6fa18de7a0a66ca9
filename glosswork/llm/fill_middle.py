"""Fill-in-middle transformation: a text's units (lines) are cut in prefix, middle and suffix and put in a new order.

One Arrow-batched pandas UDF does it: the regex library's ``finditer`` finds the units, of which only the end offsets are kept, in a
compact array; two look-ups in it slice the text; hashlib gives the seeds and the digests.  A row needs nothing
but itself, so there is no shuffle, and a text is read once.

Seeds are the first four 8-digit groups, as unsigned integers, of the hex sha256 of ``SEED:`` followed by the decimal doc_id.  The prefix
ends after the smaller of seed 1 and seed 2 modulo n + 1 units, the middle after the larger.  A text stays plain if it is empty,
holds a sentinel, or seed 3 modulo 100 is not below ``rate``; of the others those with seed 4 modulo 100 below ``spm_rate`` put the suffix
first (spm), the rest the prefix (psm).

Defined results: null text is empty; the decimal of a null doc_id is the empty string; rows that repeat a doc_id are cut
by the same seeds; a very long text is one row of its own batch; an empty table gives an empty result; only doc_id and text are
read, further columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import save

SEED, RATE, SPM_RATE = 7, 100, 50
# The sentinels before prefix, suffix and middle, and what a unit is.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """The end offsets of the units, with 0 in front."""
    ends = array("Q", [0])
    ends.extend(m.end() for m in unit.finditer(text))
    return ends


def seeds(doc_id: str, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]


def transformed(text: str, doc_id: str, unit: regex.Pattern, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output)."""
    ends = unit_ends(text, unit)
    n, (h1, h2, h3, h4) = len(ends) - 1, seeds(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((ends[h1 % (n + 1)], ends[h2 % (n + 1)]))
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def restored(output: str, form: str) -> str:
    """The text that :func:`transformed` was given.  No piece holds a sentinel, and none can arise where a piece meets one."""
    if form == "plain":
        return output
    head, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    first, _, rest = output[len(head):].partition(second)
    other, _, middle = rest.partition(MIDDLE)
    return first + middle + other if form == "psm" else other + middle + first


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str = LINES, with_output: bool = True) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, if asked for, output."""
    fields = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * with_output

    @F.pandas_udf(f"struct<{fields.replace(' ', ':').replace(',:', ', ')}>")
    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern, rows = regex.compile(unit), []
        for doc_id, text in zip(ids, texts, strict=True):
            n, form, before, inner, output = transformed(text, doc_id, pattern, seed, rate, spm_rate)
            row = (n, form, before, inner, sha(output), sha(restored(output, form)))
            rows.append((*row, output) if with_output else row)
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in fields.split(", ")])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    text, name = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return save(docs.select("doc_id", cut(name, text).alias("cut")).select("doc_id", "cut.*"), "fim-rows")


def fim_digests(docs: DataFrame) -> DataFrame:
    """:func:`fill_in_middle` without the texts."""
    return fill_in_middle(docs, with_output=False)


__all__ = ["fill_in_middle", "fim_digests", "restored", "transformed", "unit_ends"]
