"""Work on the texts of Arrow batches, a slice at a time, so that a task holds a bounded part of its rows."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import words as W


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Mapper) -> Mapper:
    """run, after which the worker gives the memory that it has freed back to the system, as it may wait long for its next task."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return tidied


def schema_of(ddl: str) -> tuple[T.StructType, pa.Schema]:
    kinds = T.StructType.fromDDL(ddl)
    return kinds, to_arrow_schema(kinds)


def map_texts(docs: DataFrame, id_col: str, text_col: str, work: Callable[[np.ndarray, np.ndarray], list], ddl: str, id_type: str = "long") -> DataFrame:
    """One row per input row: its id and the columns of ddl, which work makes from the UTF-8 bytes and bounds of a run of texts."""
    return map_beside(docs.select(F.col(id_col).cast(id_type).alias(id_col), F.col(text_col).cast("string").alias("text")), work, ddl)


def map_beside(base: DataFrame, work: Callable[[np.ndarray, np.ndarray], list], ddl: str, with_text: bool = False) -> DataFrame:
    """base: any column, and text. Returns that first column as it is, with_text the text, and the columns of ddl."""
    kinds, _ = schema_of(ddl)
    kept = 2 if with_text else 1
    kinds = T.StructType([*base.schema.fields[:kept], *kinds.fields])
    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, bounds in W.slices(batch.column(1)):
                made = work(data, bounds)
                cols = [*(batch.column(k).slice(row, len(bounds) - 1) for k in range(kept)), *made]
                yield pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, arrow.types, strict=True)], schema=arrow)

    return base.mapInArrow(tidy(run), kinds)


def beside(docs: DataFrame, text_col: str) -> DataFrame:
    """row, a struct of all columns but the text, whatever their names, and text."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others, F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))).alias("row"), F.col(text_col).cast("string").alias("text"))


def rejoined(docs: DataFrame, text_col: str, made: DataFrame, text: str, changed: bool = True) -> DataFrame:
    """The columns of docs in their order, from row and a text; if that has changed, n_chars, where docs has it, follows it."""
    out = []
    for c in docs.columns:
        kind = docs.schema[c].dataType
        if c == text_col:
            out.append(F.col(text).cast(kind).alias(c))
        elif c == "n_chars" and changed:
            out.append(F.length(text).cast(kind).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return made.select(*out)
