"""Helpers of the operators in this package."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wireloom.operators.scale import materialise

#: Everything outside 0-9, A-Z, a-z and the bytes of characters beyond ASCII becomes a space; A-Z become a-z.
_WORD_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of UTF-8 text after lower-casing A-Z; null has none.

    All bytes of a character beyond ASCII are 0x80 or above, so the pattern on code points and the one on
    bytes give the same words.
    """
    return text.translate(_WORD_BYTES).split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that a task holds the Python objects of few rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written to the shared folder and read back: later steps don't repeat it, and lost executors don't either."""
    return materialise(df, tag)


def part_count(df: DataFrame, units: float, unit: float) -> int:
    """Partitions of about `unit` units each, and as many as the session shuffles into at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(units // unit) + 1)


def text_column(df: DataFrame, name: str = "text"):
    """`name` as a string; nulls stay."""
    return F.col(name).cast("string").alias(name)
