"""Spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word is a binary vector: element (letter, k) is set if the letter stands in it k times or more. One replaced letter
moves that vector by two elements, one inserted or deleted letter by one. The elements are dealt into parts by a hash;
vectors at distance k differ in k parts at most, so they agree on all parts of at least one choice of `parts - k` of
them. Every such choice is a signature (its number, the length and the elements of its parts), near words meet in an
equi-join on one of them, and each candidate is verified: first a half of the word must be equal, as one edit leaves
one half alone, then the edit distance must be one. Words of equal letters can't be near, so equal multisets need no
candidates of their own.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import as_bytes, part_count, pieces, written

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()
_OTHER = bytes([*range(0x80), *range(0x80, 0xC0), 0xC3])
_RUN = re.compile("[a-zÀ-ÿ]+")
_PLACES = (1 << 64) - 1


def letter_runs(text: bytes | None) -> list[bytes]:
    """Maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of UTF-8 text with A-Z in lower case; null has none."""
    if not text:
        return []
    low = text.translate(_LETTERS)
    if low.isascii() or not low.translate(None, _OTHER):  # of characters beyond ASCII only U+00C0 to U+00FF
        return low.split()
    return [w.encode() for w in _RUN.findall(low.decode())]


def misspelt(runs: Counter, doc_id: str, found: Counter, least: int, every: int) -> None:
    """Adds the runs of one document to `found`; a run whose checksum with the id `every` divides loses a character."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for run, n in runs.items():
        if len(run) < least:
            continue
        h = zlib.crc32(run, start)
        if h % every == 0:
            word = run.decode()
            at = h % len(word)
            run = (word[:at] + word[at + 1:]).encode()
        found[run] += n


def word_counts(documents: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199, held: int = 200_000) -> DataFrame:
    """(word, n): words of all texts with at least `least_letters` code points and `least_count` occurrences.

    Tasks add up what they read and pass on `held` words at a time. A null text has no words, a null id counts as an
    empty one, repeated rows count repeatedly; other columns are not read.
    """
    def run(batches):
        found: Counter = Counter()

        def rows():
            words = [w for x in found if len(w := x.decode()) >= least_letters]
            counts = [found[w.encode()] for w in words]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["word", "n"])

        for b in pieces(batches, 64):
            for doc, text in zip(b["doc_id"].to_pylist(), as_bytes(b["text"]), strict=True):
                misspelt(Counter(letter_runs(text)), doc or "", found, least_letters, every)
                if len(found) >= held:
                    yield rows()
        yield rows()

    docs = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# ------------------------------------------------------------------ signatures
def _element(letter: str, k: int) -> int:
    """64-bit hash of one element of the vector."""
    x = (ord(letter) * 0x9E3779B97F4A7C15 + k * 0xC2B2AE3D27D4EB4F) & _PLACES
    x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & _PLACES
    return x ^ (x >> 32)


class Signatures:
    """Signatures of vectors within `distance`: the elements of every choice of `parts - distance` parts, and `length`."""

    def __init__(self, parts: int, distance: int):
        self.parts, self.choices = parts, [*combinations(range(parts), parts - distance)]
        self.known: dict[str, tuple[int, int]] = {}

    def of(self, word: str, length: int) -> list[int]:
        sums = [0] * self.parts
        for letter, n in Counter(word).items():
            for k in range(1, n + 1):
                key = letter if k == 1 else f"{letter}{k}"
                got = self.known.get(key)
                if got is None:
                    h = _element(letter, k)
                    got = (h >> 40) % self.parts, h
                    if k < 64:
                        self.known[key] = got
                sums[got[0]] += got[1]
        return [hash((i, length, *(sums[p] for p in choice))) for i, choice in enumerate(self.choices)]


def _half(part: str) -> int:
    return int(np.uint64(zlib.crc32(part.encode()) << 32 | zlib.adler32(part.encode())).astype(np.int64))


def signed(words: DataFrame, parts: int, distance: int, shorter: int) -> DataFrame:
    """(word, left, right, sig): one row for each signature. The signature holds the word's length less `shorter`, the
    halves (as checksums) are those of a word of that length: its first half, and as many last letters as are left."""
    def run(batches):
        own = Signatures(parts, distance)
        for b in pieces(batches, 512):
            out = ([], [], [], [])
            for w in b["word"].to_pylist():
                n = len(w) - shorter
                sigs, cut = own.of(w, n), n // 2
                for column, value in zip(out, (w, _half(w[:cut]), _half(w[len(w) - (n - cut):])), strict=False):
                    column.extend([value] * len(sigs))
                out[3].extend(sigs)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *[pa.array(x, pa.int64()) for x in out[1:]]], names=["word", "left", "right", "sig"])

    return words.select("word").mapInArrow(run, "word string, left long, right long, sig long")


def near_pairs(words: DataFrame, parts_replaced: int = 7, parts_inserted: int = 4) -> DataFrame:
    """(a, b): all pairs of `words` that differ by exactly one code point, each once.

    Words of equal length (one replaced letter, vectors two apart) and of lengths one apart (one inserted letter,
    vectors one apart) are joined by themselves. Candidates are compared inside the join and not written; a signature
    that many words share is split by the adaptive join. Spark knows neither how many rows a word gets nor what they take
    unpacked, and would broadcast them through the driver, so both joins shuffle.
    """
    def verified(a, b, more):
        x, y = a.alias("x"), b.hint("merge").alias("y")
        ok = (F.col("x.sig") == F.col("y.sig")) & more & ((F.col("x.left") == F.col("y.left")) | (F.col("x.right") == F.col("y.right")))
        return x.join(y, ok & (F.levenshtein("x.word", "y.word", 1) == 1)).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))

    same = signed(words, parts_replaced, 2, 0)
    short, long = signed(words, parts_inserted, 1, 0), signed(words, parts_inserted, 1, 1)
    return verified(same, same, F.col("x.word") < F.col("y.word")).union(verified(short, long, F.lit(True))).distinct()


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word on the way along the forms, which never turn back.

    Every round doubles the length of the steps, so the rounds are logarithmic in the longest way.
    """
    way = written(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        step = written(way.join(on.hint("merge"), "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")), "ways")
        way = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return way


def variant_groups(documents: DataFrame, least_letters: int = 6, least_count: int = 5, every: int = 199, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word.

    `form` is the near word of the largest count (ties: the smallest in code-point order) if it has at least `times`
    the count of the word, else null; `root` is the last word along the forms, the word itself if it has none.
    Without documents or words there are no rows; see `word_counts` for null and repeated rows.
    """
    words = written(word_counts(documents, least_letters, least_count, every), "words")
    size = part_count(words, words.count(), 50_000)
    pairs = written(near_pairs(words.repartition(size)), "near")
    both = pairs.union(pairs.select("b", "a"))
    best = (both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")).hint("merge"), "b").groupBy(F.col("a").alias("word"))
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("w"))).alias("top")))
    has = -F.col("top.m") >= times * F.col("n")
    rows = written(words.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                                           F.when(has, F.col("top.w")).alias("form"), F.when(has, -F.col("top.m")).alias("form_n")), "forms")
    root = followed(rows.filter("form is not null"))
    return rows.join(root.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
