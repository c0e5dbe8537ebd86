"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop_written, written

__all__ = ["BLANK", "drop_written", "few", "give_back", "giving_back", "key_name", "let", "read", "ship", "vocabulary_path", "word_array", "written"]

#: Characters that part words (fixed values: space, and tab to carriage return).
BLANK = r"[\x20\x09-\x0D]+"


def give_back() -> None:
    """Returns freed memory to the system: Spark keeps a worker for later tasks, beside tasks that need the memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # a C library without it
        pass


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``work`` on a task's batches; at the task's end its memory goes back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return whole


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK, -1), "")


def few(df: DataFrame, most: int) -> DataFrame:
    """``df`` for a join: to be broadcast if its counted rows are ``most`` or fewer, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def key_name(df: DataFrame, stem: str) -> str:
    """A column name starting with ``stem`` that ``df`` does not have (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine; ``SILTSTONE_TOKENIZERS`` overrides the installed place."""
    base = os.environ.get("SILTSTONE_TOKENIZERS")
    if base:
        return os.path.join(base, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once per application, for those whose Python path lacks it."""
    context = spark.sparkContext
    if getattr(context, "_siltstone_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone.zip")
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(target)
    context._siltstone_shipped = True
