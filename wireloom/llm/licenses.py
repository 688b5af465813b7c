"""License notices in whole documents: exact phrases, and short notices with a bounded number of edits.

A notice of n characters with k allowed edits is cut into k + 1 seeds: k edits leave one of them untouched (pigeonhole),
so every fuzzy occurrence holds a seed exactly. The places of seeds give windows; in each the `regex` library matches
the notice with at most k errors, best match first, and gives its span and the edits.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import as_bytes, pieces, words_of

# The phrases of the base search and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Opening words of public license notices (lower case, words only), with an ending that takes no edits
# because versions differ by one character.
NOTICES = (
    ("mit", "under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ""),
    ("apache-2", "apache license version ", "2"),
    ("cc-by-nc", "creative commons attribution noncommercial", ""),
    ("cc-by-sa", "creative commons attribution sharealike", ""),
    ("gpl-2", "gnu general public license version ", "2"),
    ("gpl-3", "gnu general public license version ", "3"),
    ("lgpl", "gnu lesser general public license", ""),
    ("agpl", "gnu affero general public license", ""),
    ("mpl", "mozilla public license version", ""),
    ("bsd", "redistribution and use in source and binary forms", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
)


@dataclass(frozen=True)
class Notice:
    label: str
    body: str
    tail: str
    edits: int
    seeds: tuple[tuple[int, str], ...]  # place in the body, text


def notice(label: str, body: str, tail: str = "", per_edit: int = 10, most: int = 3) -> Notice:
    """One edit for each `per_edit` characters of the body, `most` at most."""
    k = min(most, len(body) // per_edit)
    cuts = [len(body) * i // (k + 1) for i in range(k + 2)]
    return Notice(label, body, tail, k, tuple((a, body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))


@functools.cache
def _pattern(n: Notice):
    import regex

    return regex.compile(rf"(?b)\b(?:{regex.escape(n.body)}){{e<={n.edits}}}{regex.escape(n.tail)}\b", regex.V1)


def fuzzy_hits(text: str, notices: tuple[Notice, ...]) -> list[tuple[str, int, int, int, float]]:
    """(label, first word, last word, edits, similarity) in words joined by single spaces, best match of each window."""
    found: dict[tuple[str, int, int], tuple[int, float]] = {}
    for n in notices:
        seen: set[int] = set()
        for place, seed in n.seeds:
            at = text.find(seed)
            while at >= 0:
                if (start := at - place) not in seen:
                    seen.add(start)
                    low = max(0, start - n.edits - 1)
                    window = text[low:start + len(n.body) + len(n.tail) + n.edits + 1]
                    if m := _pattern(n).search(window):
                        a, b = low + m.start(), low + m.end()
                        a += len(text[a:b]) - len(text[a:b].lstrip())
                        first = text.count(" ", 0, a)
                        last = first + text[a:b].strip().count(" ")
                        edits = sum(m.fuzzy_counts)
                        key, value = (n.label, first, last), (edits, 1 - edits / len(n.body + n.tail))
                        if value[0] < found.get(key, (n.edits + 1,))[0]:
                            found[key] = value
                at = text.find(seed, at + 1)
    return [(*k, *v) for k, v in sorted(found.items())]


def exact_hits(joined: bytes) -> list[tuple[str, int, int]]:
    """(label, first word, last word) of the phrases; `joined` has a space before and after each word."""
    out = []
    for phrase, label in PHRASES.items():
        p = f" {phrase} ".encode()
        at = joined.find(p)
        while at >= 0:
            first = joined.count(b" ", 0, at)
            out.append((label, first, first + phrase.count(" ")))
            at = joined.find(p, at + 1)
    return sorted(out, key=lambda x: (x[1], x[0]))


def find_notices(documents: DataFrame, notices=NOTICES) -> DataFrame:
    """(doc_id, n_words, base, notices), one row per row of `documents`; whole texts are searched.

    `base`: array of (label, first_word, last_word), all places of the fixed phrases; `notices`: array of
    (label, first_word, last_word, edits, similarity) of the fuzzy search. Words are lower-cased (A-Z) and counted
    from 0. A null or empty text has no words. Repeated rows give equal rows; other columns are not read.
    """
    all_notices = tuple(notice(*n) for n in notices)
    seeds = sorted({s.encode() for n in all_notices for _, s in n.seeds})
    base_type = "array<struct<label:string,first_word:long,last_word:long>>"
    fuzzy_type = "array<struct<label:string,first_word:long,last_word:long,edits:int,similarity:double>>"
    span = [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
    base_arrow, fuzzy_arrow = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("edits", pa.int32()), ("similarity", pa.float64())]))

    def run(batches):
        for b in pieces(batches):
            counts, base, fuzzy = [], [], []
            for text in as_bytes(b["text"]):
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                counts.append(len(words))
                base.append([dict(zip(("label", "first_word", "last_word"), h, strict=True)) for h in exact_hits(joined)])
                hits = fuzzy_hits(joined[1:-1].decode(), all_notices) if any(s in joined for s in seeds) else []
                fuzzy.append([dict(zip(("label", "first_word", "last_word", "edits", "similarity"), h, strict=True)) for h in hits])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts, pa.int64()), pa.array(base, base_arrow), pa.array(fuzzy, fuzzy_arrow)],
                                             names=["doc_id", "n_words", "base", "notices"])

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, base {base_type}, notices {fuzzy_type}")


def notice_report(documents: DataFrame) -> DataFrame:
    """Digest of `find_notices`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is the similarity of the best occurrence: 1 for an exact phrase, 1 - edits / length for a fuzzy one, 0 for none.
    """
    base_labels = F.array_distinct(F.col("base")["label"])
    return find_notices(documents).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base")["first_word"]).alias("first_word"), F.array_max(F.col("base")["first_word"]).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.array_distinct(F.col("notices")["label"]))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("notices")["similarity"]), F.lit(0.0))).alias("score"),
        "notices")
