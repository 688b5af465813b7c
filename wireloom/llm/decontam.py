"""Benchmark decontamination: Wu-Manber search for the word windows of test items in whole documents.

A window is `window` consecutive words of an item; an item of fewer words, but not none, is one window. The search
runs over words. For all windows of one length m it holds

- a shift table over blocks of two neighbouring words (of one word if m is 1): how far the end of the window may
  move on because no window has the block nearer to its end;
- buckets by the block at the end of a window (its suffix), and in a bucket by the first word of the window;
- the windows themselves, which are compared word by word before an occurrence counts.

The tables of `benchmark` go to the tasks in blocks of at most `block_chars` characters of item text, one pass over
the rows in a task for each block; the documents are never shuffled and an item set of any size keeps to that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import as_bytes, pieces, words_of


class WindowSearch:
    """Wu-Manber tables for windows of `m` words: {window: names of the items that have it}."""

    def __init__(self, m: int, windows: dict[tuple[bytes, ...], set[str]]):
        self.m, self.block = m, min(2, m)
        self.shift: dict[bytes, dict[bytes, int]] = {}  # last word of a block -> word before it -> shift
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], set[str]]]]] = {}
        for w, items in windows.items():
            for end in range(self.block - 1, m):
                before = w[end - 1] if self.block == 2 else b""
                row = self.shift.setdefault(w[end], {})
                row[before] = min(row.get(before, m), m - 1 - end)
            self.shift.setdefault(w[0], {})
            self.buckets.setdefault(w[m - self.block:], {}).setdefault(w[0], []).append((list(w), items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """First word and items of each occurrence, from left to right."""
        m, two, shift, buckets, n = self.m, self.block == 2, self.shift, self.buckets, len(words)
        at = m - 1  # last word of the window that is looked at
        while at < n:
            row = shift.get(words[at])
            if row is None:  # no window has this word
                at += m
                continue
            far = row.get(words[at - 1] if two else b"", m - self.block + 1)
            if far:
                at += far
                continue
            start = at - m + 1
            for window, items in buckets[tuple(words[at - self.block + 1:at + 1])].get(words[start], ()):
                if window == words[start:at + 1]:
                    yield start, items
                    break  # windows are distinct
            at += 1


def searches(items: list[tuple[str, bytes]], window: int) -> list[WindowSearch]:
    """One search for each length of window among the items (name, text)."""
    by_length: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
    for name, text in items:
        words = words_of(text)
        m = min(window, len(words))
        for at in range(len(words) - m + 1 if m else 0):
            by_length.setdefault(m, {}).setdefault(tuple(words[at:at + m]), set()).add(name)
    return [WindowSearch(m, w) for m, w in sorted(by_length.items())]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most `block_chars` characters (a longer item makes a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    for item, text in rows.filter("item is not null and text is not null").toLocalIterator():
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text.encode()))
        size += len(text)
    if block:
        yield block


def find_passages(documents: DataFrame, benchmark: DataFrame, window: int = 10,
                  block_chars: int = 4_000_000) -> DataFrame:
    """Occurrences of item windows: (doc_id, n_words, hit_spans, items), one row per row of `documents`.

    `hit_spans` are the word ranges [start, end) that occurrences cover, merged and in order; `items` the sorted
    distinct ids, as strings, of items with an occurring window. A null or empty text has no words and no hits.
    Items with a null id or without words have no windows. Repeated documents give a row each, repeated or equal
    items count by their ids. Other columns of both tables are not read. An empty benchmark gives no hits.
    """
    return _scanned(documents, F.col("doc_id"), benchmark, window, block_chars).withColumnRenamed("row", "doc_id")


def _scanned(documents: DataFrame, row: Column, benchmark: DataFrame, window: int, block_chars: int) -> DataFrame:
    """`find_passages` with `row` of each row of `documents` in place of its id."""
    spark = documents.sparkSession
    found = documents.select(row.alias("row"), F.col("text").cast("string").alias("text"), F.lit(0).cast("long").alias("n_words"),
                             F.array().cast("array<struct<start:long,stop:long>>").alias("hit_spans"),
                             F.array().cast("array<string>").alias("items"))
    schema = found.schema
    for block in [*item_blocks(benchmark, block_chars)] or [[]]:
        tables = spark.sparkContext.broadcast(block)

        def scan(batches, tables=tables):
            own = searches(tables.value, window)
            for b in pieces(batches):
                counts, spans, items = [], [], []
                for text, old, names in zip(as_bytes(b["text"]), b["hit_spans"].to_pylist(), b["items"].to_pylist(), strict=True):
                    words, hit, seen = words_of(text), [(x["start"], x["stop"]) for x in old], set(names)
                    for s in own:
                        for at, which in s.occurrences(words):
                            hit.append((at, at + s.m))
                            seen |= which
                    counts.append(len(words))
                    spans.append([{"start": a, "stop": z} for a, z in merged(hit)])
                    items.append(sorted(seen))
                yield pa.RecordBatch.from_arrays(
                    [b["row"], b["text"], pa.array(counts, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                     pa.array(items, pa.list_(pa.string()))], names=["row", "text", "n_words", "hit_spans", "items"])

        found = found.mapInArrow(scan, schema)
    return found.drop("text")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Digest of `find_passages`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["stop"] - s["start"])
    return find_passages(documents, benchmark, window).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 4_000_000) -> DataFrame:
    """`documents` without the rows in whose text a window occurs; each row is judged by itself, whatever its id."""
    return _scanned(documents, F.struct("*"), benchmark, window, block_chars).filter(F.size("hit_spans") == 0).select("row.*")
