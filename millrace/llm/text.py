"""Word and shingle helpers that run in Arrow batches on the executors."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructField, StructType

#: Bytes of texts that a Python function gets at a time; a longer text comes alone.
SLICE = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_GAP = re.compile(rb"[ \t-\r]")
PIECE = 1 << 20


def word_pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of ``text`` (runs of bytes other than 0x20 and 0x09 to 0x0D), a list for about each ``size`` bytes."""
    if len(text) <= size:
        yield text.split()
        return
    at = 0
    while at < len(text):
        cut = _GAP.search(text, min(len(text), at + size))
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def shingle_pieces(text: bytes, n: int) -> Iterator[list[bytes]]:
    """The word ``n``-shingles of ``text`` in order, repeats included, joined by a space; a text of fewer words is one
    shingle of all its words, a text of no words has none."""
    tail: list[bytes] = []
    some = False
    for words in word_pieces(text):
        words = tail + words
        if len(words) >= n:
            some = True
            yield [b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)]
        tail = words[-(n - 1) :] if n > 1 else []
    if not some and tail:
        yield [b" ".join(tail)]


def small_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches hold at most SLICE bytes or a row: each is held several times over, in the JVM's
    direct memory and in Python."""
    try:
        now = int(spark.conf.get(_BATCH, None) or 1 << 62)
    except ValueError:  # written with a unit, so set on purpose
        return
    if now > SLICE:
        spark.conf.set(_BATCH, str(SLICE))


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts (views, no copies) of at most ``size`` bytes in column ``at``, a row at least."""
    column = batch.column(at)
    length = pc.multiply(pc.list_value_length(column), 4) if pa.types.is_list(column.type) else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, size + (ends[start - 1] if start else 0), "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(docs: DataFrame, text: str, make: Callable, extra: dict[str, str] | None = None, keep: bool = False, drop: tuple[str, ...] = (), binary: bool = False, done: Callable | None = None) -> DataFrame:
    """``docs`` with the columns ``extra`` (name: type) that ``make`` gives as Arrow arrays for each slice of texts; with
    ``keep`` only the rows for which it gives true. Columns of the names in ``extra`` or ``drop`` are left out.

    Each row goes to Python once, whatever its columns are called, and a slice of bounded size at a time. With ``binary``
    ``make`` gets the texts as bytes, which need not be UTF-8. ``done`` runs at a task's end.
    """
    small_batches(docs.sparkSession)
    extra = extra or {}
    at, names = docs.columns.index(text), [f"c{k}" for k in range(len(docs.columns))]
    src = docs.toDF(*names)
    stay = [k for k, c in enumerate(docs.columns) if c not in extra and c not in drop]
    out = [f"c{k}" for k in stay] + [f"x{k}" for k in range(len(extra))]
    schema = StructType([StructField(c, f.dataType) for c, f in zip(names, src.schema.fields, strict=True) if c in out] + [StructField(f"x{k}", DataType.fromDDL(t)) for k, t in enumerate(extra.values())])

    def run(batches):
        try:
            for b in batches:
                for part in slices(b, at):
                    got = make(part.column(at).cast(pa.binary()) if binary else part.column(at))
                    rows = [part.column(k) for k in stay]
                    yield pa.RecordBatch.from_arrays(rows, names=out).filter(got) if keep else pa.RecordBatch.from_arrays([*rows, *got], names=out)
        finally:
            if done:
                done()
            give_back()

    return src.mapInArrow(run, schema).toDF(*(docs.columns[k] for k in stay), *extra)
