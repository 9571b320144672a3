"""Fill-in-the-middle: texts cut at unit ends into prefix, middle and suffix, written in another order between sentinels.

A pandas UDF runs over Arrow batches. In it the ``regex`` library finds a text's units (lines, unless another pattern is
given), their end offsets go to a compact integer array, and two lookups in that array slice the text. What is cut where,
and in which order the parts are written, follows from a SHA-256 of the seed and the row's key, so a row always gives the
same output, on whatever executor. One scan, no shuffle; memory is one batch (text.small_batches) and eight bytes a unit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import small_batches

LINES = r"[^\n]*\n|[^\n]+"
#: Sentinels before prefix, suffix and middle; the text of a seed; shares in percent of rows that are cut and, of these, of
#: rows whose suffix comes first.
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = "7", 100, 50
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"

_CUT = "n_units long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def unit_ends(text: str, units: regex.Pattern) -> array:
    """The end offsets of the units, in code points."""
    return array("q", (m.end() for m in units.finditer(text)))


def cut(text: str, key: str, units: regex.Pattern, seed: str, rate: int, spm: int, sentinels: tuple[str, str, str]) -> tuple:
    """(units, form, code points of prefix and of middle, output); see :func:`transform`."""
    ends = unit_ends(text, units)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    first, second, whether, order = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(ends)
    if not text or any(s in text for s in sentinels) or whether % 100 >= rate:
        return n, PLAIN, None, None, text
    at, to = (ends[k - 1] if k else 0 for k in sorted((first % (n + 1), second % (n + 1))))
    p, s, m = sentinels
    if order % 100 < spm:
        return n, SPM_FORM, at, to - at, "".join((s, text[to:], p, text[:at], m, text[at:to]))
    return n, PSM, at, to - at, "".join((p, text[:at], s, text[to:], m, text[at:to]))


def rebuild(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that :func:`cut` was given."""
    if form == PLAIN:
        return output
    p, s, m = sentinels
    lead, between = (s, p) if form == SPM_FORM else (p, s)
    head, _, rest = output[len(lead) :].partition(between)
    tail, _, middle = rest.partition(m)
    prefix, suffix = (tail, head) if form == SPM_FORM else (head, tail)
    return "".join((prefix, middle, suffix))


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """Sentinels that can be told apart wherever they stand: none is empty or within another, and no end of one is the
    start of one."""
    for k, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (k != j and a in b) or any(b.startswith(a[i:]) for i in range(1, len(a))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")
    return sentinels


def _with_fields(docs: DataFrame, made: Column, source: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``docs`` (``source`` has them by position) and the fields of ``made``, which replace columns of the
    same names."""
    stay = [k for k, c in enumerate(docs.columns) if c not in names]
    rows = source.select(*(f"c{k}" for k in stay), made.alias("x"))
    return rows.select(*(f"c{k}" for k in stay), *(f"x.{c}" for c in names)).toDF(*(docs.columns[k] for k in stay), *names)


def _by_position(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = LINES, seed: str = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with n_units, form, prefix_chars, middle_chars, output and output_sha256 of each whole text, in place of
    columns of these names.

    Of the hex SHA-256 of ``seed:key`` the first four groups of eight digits are h1 to h4. With n units the prefix ends
    after min(h1 % (n + 1), h2 % (n + 1)) of them, the middle after the larger number, and the suffix is the rest. A row is
    ``plain`` (output is the text, no cut) if its text is null or empty, holds a sentinel, or h3 % 100 >= ``rate``; else
    ``spm`` (suffix, prefix, middle) if h4 % 100 < ``spm``, else ``psm``. A null key is an empty one. Equal rows are
    cut alike; an empty table gives an empty one; other columns stay, whatever their names. The pattern of ``units``
    must cover the text without gaps.
    """
    sentinels = _checked(sentinels)

    @F.pandas_udf(_CUT)
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        found = regex.compile(units)
        for keys, texts in batches:
            rows = [cut(t, k, found, seed, rate, spm, sentinels) for k, t in zip(keys, texts, strict=True)]
            out = pd.DataFrame(rows, columns=["n_units", "form", "prefix_chars", "middle_chars", "output"])
            out[["prefix_chars", "middle_chars"]] = out[["prefix_chars", "middle_chars"]].astype("Int64")
            out["output_sha256"] = [_sha(r[-1]) for r in rows]
            yield out

    src, at = _by_position(docs), docs.columns.index
    call = made(F.coalesce(F.col(f"c{at(key)}").cast("string"), F.lit("")), F.coalesce(F.col(f"c{at(text)}"), F.lit("")))
    return _with_fields(docs, call, src, ["n_units", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])


def restore(docs: DataFrame, output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``docs`` with restored and restored_sha256: the exact text (an empty one for null) that each output and form came
    from, in place of columns of these names. A null form is ``plain``."""
    sentinels = _checked(sentinels)

    @F.pandas_udf("restored string, restored_sha256 string")
    def made(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            back = [rebuild(o, f, sentinels) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"restored": back, "restored_sha256": [_sha(t) for t in back]})

    src, at = _by_position(docs), docs.columns.index
    call = made(F.coalesce(F.col(f"c{at(output)}"), F.lit("")), F.coalesce(F.col(f"c{at(form)}"), F.lit(PLAIN)))
    return _with_fields(docs, call, src, ["restored", "restored_sha256"])
