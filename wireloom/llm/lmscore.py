"""Cross-entropy difference of documents under a target and a background bigram model (Moore and Lewis).

Both models share the vocabulary (all words of the documents), the order and the smoothing; the target model counts the
target documents, the background model all others. A document of n words is a chain of n + 1 predictions (a boundary
stands before and after it); for each the loss under both models is taken, and the mean difference scores the document:
the lower, the closer to the target.

    P(w | v) = mix * c(v, w) / c(v) + (1 - mix) * (c(w) + 1) / (N + V + 2)

The counts grow with the corpus and are never gathered or broadcast. Tasks turn documents into blocks of chains. A block
sends its own count of each of its distinct words, then of each of its distinct bigrams, to a part by a hash of the key;
a part adds up the counts of its keys and answers each block with the sums, in the order in which the block asked. So a
word or bigram that all documents share costs a part one entry for each block. Keys are hashes of 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import as_bytes, part_count, pieces, words_of, written
from wireloom.llm.neardup import mixed

BLOCK_CHARS = 4_000_000


def marked(documents: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target int): whether a row's id is among those of `target` (doc_id)."""
    docs = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = target.select(F.col("doc_id").alias("_t")).filter("_t is not null").distinct().hint("merge")  # grows with the documents
    return docs.join(ids, F.col("doc_id") == F.col("_t"), "left").select("doc_id", "text", F.col("_t").isNotNull().cast("int").alias("target"))


# ------------------------------------------------------------------ packed arrays
def _packed(values: np.ndarray) -> bytes:
    """Number of values, bytes for each, then the values by planes: all lowest bytes first."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return len(values).to_bytes(4, "little") + bytes([width]) + planes.T.tobytes()


def _unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays of joined `_packed` values."""
    out, at = [], 0
    while at < len(data):
        n, width = int.from_bytes(data[at:at + 4], "little"), data[at + 4]
        planes = np.zeros((n, 8), np.uint8)
        planes[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(planes.view("<u8").ravel())
        at += 5 + n * width
    return out


# ------------------------------------------------------------------ blocks
def chains(docs: DataFrame) -> DataFrame:
    """(block, ids, docs, words, chain, n_words, n0, n1): blocks of documents. `docs` has their numbers of words and models,
    `words` the keys of the distinct words, the boundary first, `chain` the places in `words` of all documents' words with
    a boundary before and after those of a document that has any; n0 and n1 are the predictions of each model."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number, part = 0, TaskContext.get().partitionId()
        ids, lengths, targets, chain, own, chars = [], [], [], [], {b"": 0}, 0

        def row():
            n, t = np.array(lengths, np.int64), np.array(targets, np.int64)
            keys = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in own)
            sums = np.bincount(t, np.where(n > 0, n + 1, 0), 2).astype(np.int64).tolist()
            columns = [[part << 32 | number], [ids], [_packed(n) + _packed(t)], [keys], [_packed(np.concatenate(chain))], [len(own)], *([x] for x in sums)]
            types = [pa.int64(), pa.list_(kind_of), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["block", "ids", "docs", "words", "chain", "n_words", "n0", "n1"])

        for b in pieces(batches):
            kind_of = b["doc_id"].type
            for i, text, t in zip(b["doc_id"].to_pylist(), as_bytes(b["text"]), b["target"].to_pylist(), strict=True):
                words = words_of(text)
                ids.append(i)
                lengths.append(len(words))
                targets.append(t)
                chain.append(np.array([0, *[own.setdefault(w, len(own)) for w in words], 0] if words else [], np.uint32))
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    yield row()
                    number, ids, lengths, targets, chain, own, chars = number + 1, [], [], [], [], {b"": 0}, 0
        if ids:
            yield row()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, docs binary, words binary, chain binary, n_words long, n0 long, n1 long")


class Block:
    """The predictions of a block: `doc`, `model` and `place` in the distinct bigrams (`before`, `word`) of each."""

    def __init__(self, docs: bytes, words: bytes, chain: bytes):
        self.lengths, targets = (x.astype(np.int64) for x in _unpacked(docs))
        self.keys = np.frombuffer(words, "<u8")
        chain, = _unpacked(chain)
        owner = np.repeat(np.arange(len(self.lengths)), np.where(self.lengths > 0, self.lengths + 2, 0))
        same = owner[:-1] == owner[1:]
        self.doc = owner[1:][same]
        self.model = targets[self.doc]
        pairs, self.place = np.unique(chain[:-1][same] << np.uint64(32) | chain[1:][same], return_inverse=True)
        self.before, self.word = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def bigrams(self) -> np.ndarray:
        return mixed(mixed(self.keys[self.before]) * np.uint64(0x9E3779B97F4A7C15) + self.keys[self.word])

    def counts(self, of: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.bincount(of[self.model == m], minlength=n) for m in (0, 1)]


def _order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each key, and the order in which keys are sent and answered."""
    part = (mixed(keys) >> np.uint64(33)) % np.uint64(parts)
    return part, np.argsort(part, kind="stable")


def requests(blocks: DataFrame, parts: int, bigrams: bool) -> DataFrame:
    """(part, block, keys, counts): the distinct words or bigrams of a block in a part, and how often it has them."""
    def run(batches):
        for b in pieces(batches, 1):
            for name, docs, words, chain in zip(*(b[c].to_pylist() for c in ("block", "docs", "words", "chain")), strict=True):
                own = Block(docs, words, chain)
                keys, of = (own.bigrams(), own.place) if bigrams else (own.keys, own.word[own.place])
                counts = own.counts(of, len(keys))
                part, order = _order(keys, parts)
                at = part[order]
                starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
                rows = [(int(at[a]), name, keys[order[a:z]].astype("<u8").tobytes(), b"".join(_packed(c[order[a:z]]) for c in counts))
                        for a, z in zip(starts, [*starts[1:], len(at)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                 names=["part", "block", "keys", "counts"])

    return blocks.select("block", "docs", "words", "chain").mapInArrow(run, "part int, block long, keys binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(part, block, seen, sums): for each request the counts of its keys over all blocks. `seen` adds up to the number of
    distinct keys that occur in a prediction."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, "<u8") for k in group["keys"]]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        counts = [_unpacked(c) for c in group["counts"]]
        total = [np.bincount(at, np.concatenate([c[m] for c in counts]), len(every)).astype(np.int64) for m in (0, 1)]
        ends = np.cumsum([len(k) for k in keys])
        sums = [b"".join(_packed(t[at[z - len(k):z]]) for t in total) for k, z in zip(keys, ends, strict=True)]
        seen = np.zeros(len(group), np.int64)
        seen[0] = np.count_nonzero(total[0] + total[1])
        return pd.DataFrame({"part": group["part"], "block": group["block"], "seen": seen, "sums": sums})

    return asked.groupBy("part").applyInPandas(add, "part int, block long, seen long, sums binary")


def _sums(rows: pd.DataFrame, keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """The answers to a block's requests for `keys`, in their order."""
    order = _order(keys, parts)[1]
    got = [_unpacked(x) for x in rows.sort_values("part")["sums"]]
    out = [np.zeros(len(keys)) for _ in (0, 1)]
    for m in (0, 1):
        if got:
            out[m][order] = np.concatenate([g[m] for g in got])
    return out


def cross_entropy_difference(documents: DataFrame, target: DataFrame, mix: float = 0.7) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score), one row per row of `documents`.

    `target` (doc_id) names the target documents; all others are background. Losses are means per prediction in nats,
    score is their difference; n_tokens counts predictions. A text without words (null, empty) has n_tokens 0 and nulls.
    Repeated rows count as often as they stand and get a row each; other columns are not read. Without target documents
    the target model is uniform.
    """
    docs = marked(documents, target)
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = written(chains(docs), "chains")
    n_words, *predictions = (x or 0 for x in blocks.agg(F.sum("n_words"), F.sum("n0"), F.sum("n1")).first())
    word_parts, parts = part_count(documents, n_words, 1.5e6), part_count(documents, sum(predictions), 1.5e6)
    words = written(answers(requests(blocks, word_parts, bigrams=False)), "words")
    vocabulary = max(0, (words.agg(F.sum("seen")).first()[0] or 0) - 1)  # without the boundary
    pairs = written(answers(requests(blocks, parts, bigrams=True)), "bigrams")  # frees the requests' shuffle files
    answered = [x.select("block", F.lit(i).alias("step"), "part", "sums") for i, x in enumerate((words, pairs), 1)]
    rows = blocks.select("block", F.lit(0).alias("step"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("sums"), "ids", "docs", "words", "chain")
    for x in answered:
        rows = rows.unionByName(x, allowMissingColumns=True)

    def block(group: pd.DataFrame) -> pd.DataFrame:
        row = group[group["step"] == 0].iloc[0]
        own, ids = Block(row["docs"], row["words"], row["chain"]), row["ids"]
        single = _sums(group[group["step"] == 1], own.keys, word_parts)
        double = _sums(group[group["step"] == 2], own.bigrams(), parts)
        n = np.where(own.lengths > 0, own.lengths + 1, 0)
        mean = []
        for m in (0, 1):
            unigram = (single[m][own.word] + 1) / (predictions[m] + vocabulary + 2)
            loss = -np.log(mix * double[m] / np.maximum(single[m][own.before], 1) + (1 - mix) * unigram)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean.append(np.where(n > 0, np.bincount(own.doc, loss[own.place], len(n)) / n, np.nan))
        return pd.DataFrame({"doc_id": pd.array(list(ids), "Int64") if kind in ("bigint", "int") else list(ids), "n_tokens": n, "loss_target": mean[1], "loss_background": mean[0], "score": mean[1] - mean[0]})

    out = rows.groupBy("block").applyInPandas(block, f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double")
    return out.select("doc_id", "n_tokens", *[F.when(F.col("n_tokens") > 0, F.col(c)).alias(c) for c in ("loss_target", "loss_background", "score")])
