"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

A shingle is five consecutive words (all words of a shorter text). Its weight is its count in the document times
ln(1 + N / df), over what a shingle of one document has, ln(1 + N). The document frequencies of all shingles are taken:
tasks turn documents into blocks, a block sends each of its distinct shingles with the number of its documents that have
it to a part by ranges of the hash, and the part answers each block with the sums in the order in which the block asked.
So a shingle of all documents costs a part one entry for each block, and no table of shingles is gathered or broadcast.
With a `share` above 0, shingles in at most that share of the documents weigh alike, as min(ln(1 + N / df), ln(1 + 1 / share)).

Each document gives bands * rows samples; documents that agree in all samples of a band share its bucket. Equal texts
are one node. Buckets never give all their pairs: in a few rounds every bucket compares one member, its centre, with
those of its members that are not yet known to be in the same class; what is then left between different classes of a bucket is
compared in cells of at most `CELL` by `CELL` nodes, each cell in one task. Links are kept from `similarity` on; classes
are the connected components.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import as_bytes, part_count, pieces, words_of, written
from wireloom.operators.graph import components
from wireloom.operators.scale import release

SHINGLE = 5
CELL = 256
BLOCK_CHARS = 2_000_000
_STEP, _BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)


# ------------------------------------------------------------------ shingles
def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[list[bytes]], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), sorted, of texts given as words: hashes of 64 bits by array operations."""
    return joined_shingles(b" ".join(b" ".join(w) for w in texts if w) + b" ", np.array([len(w) for w in texts], np.int64), size)


def joined_shingles(words: bytes, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of all words of the texts, each followed by a space, and the number of words of each text."""
    if not counts.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = np.frombuffer(words, np.uint8)
    ends = np.flatnonzero(data == 0x20)
    power = np.cumprod(np.r_[np.uint64(1), np.full(len(data) - 1, _STEP, np.uint64)], dtype=np.uint64)
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)]
    starts = np.r_[0, ends[:-1] + 1]
    back = np.cumprod(np.r_[np.uint64(1), np.full(len(data) - 1, _BACK, np.uint64)], dtype=np.uint64)
    word = mixed((total[ends] - total[starts]) * back[starts])
    first = np.r_[0, np.cumsum(counts)[:-1]]
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.repeat(first, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    value = np.zeros(len(at), np.uint64)
    width = np.minimum(counts, size)[doc]
    padded = np.r_[word, np.zeros(size, np.uint64)]
    for k in range(size):
        value += np.where(k < width, padded[at + k] * _PLACES[k], np.uint64(0))
    value = mixed(value)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    return doc[new], value[new], np.diff(np.r_[new, len(doc)])


# ------------------------------------------------------------------ document frequencies
def blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, known, counts, words): documents in blocks of about `BLOCK_CHARS` characters. `known` has a byte for each
    document, whether it has an id, `ids` those ids, `counts` the numbers of words and `words` all words, packed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        number, part = 0, TaskContext.get().partitionId()
        ids, counts, words, chars = [], [], [], 0

        def row():
            data = b" ".join([*words, b""])
            columns = [[part << 32 | number], [[i for i in ids if i is not None]], [bytes(i is not None for i in ids)], [np.array(counts, "<u4").tobytes()],
                       [len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)]]
            types = [pa.int64(), pa.list_(kind_of), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(columns, types, strict=True)], names=["block", "ids", "known", "counts", "words"])

        for b in pieces(batches):
            kind_of = b["doc_id"].type
            for i, t in zip(b["doc_id"].to_pylist(), as_bytes(b["text"]), strict=True):
                own = words_of(t)
                ids.append(i)
                counts.append(len(own))
                if own:
                    words.append(b" ".join(own))
                chars += len(t or b"")
                if chars >= BLOCK_CHARS:
                    yield row()
                    number, ids, counts, words, chars = number + 1, [], [], [], 0
        if ids:
            yield row()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, known binary, counts binary, words binary")


def _opened(counts: bytes, words: bytes) -> tuple[np.ndarray, bytes]:
    """The numbers of words and the joined words of a block."""
    return np.frombuffer(counts, "<u4").astype(np.int64), pa.decompress(words[4:], int.from_bytes(words[:4], "little"), codec="zstd", asbytes=True)


def asked(rows: DataFrame, parts: int) -> DataFrame:
    """(part, block, keys, n): the distinct shingles of a block in a part, sorted, and in how many of its documents they are."""
    def run(batches):
        for b in pieces(batches, 1):
            for block, counts, words in zip(*(b[c].to_pylist() for c in ("block", "counts", "words")), strict=True):
                counts, words = _opened(counts, words)
                keys, n = np.unique(joined_shingles(words, counts)[1], return_counts=True)
                cuts = np.searchsorted((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32), np.arange(parts + 1))
                out = [(p, block, keys[a:z].astype("<u8").tobytes(), n[a:z].astype("<u4").tobytes()) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "keys", "n"])

    return rows.select("block", "counts", "words").mapInArrow(run, "part int, block long, keys binary, n binary")


def _totals(group: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each request of a part, all distinct keys, where each key is among those, and their sums."""
    keys = [np.frombuffer(k, "<u8") for k in group["keys"].to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, every, at, np.bincount(at, np.concatenate([np.frombuffer(n, "<u4") for n in group["n"].to_pylist()]), len(every)).astype(np.int64)


def answered(requests: DataFrame) -> DataFrame:
    """(part, block, df): for each request the document frequencies of its keys."""
    def add(group: pa.Table) -> pa.Table:
        keys, _, at, total = _totals(group)
        df, ends = total[at].astype("<u4"), np.cumsum([len(k) for k in keys])
        return pa.table({"part": group["part"], "block": group["block"], "df": pa.array([df[z - len(k):z].tobytes() for k, z in zip(keys, ends, strict=True)], pa.binary())})

    return requests.groupBy("part").applyInArrow(add, "part int, block long, df binary")


def _sized(docs: DataFrame) -> tuple[int, int]:
    """The number of rows, and of parts of some 1.5 million distinct shingles of blocks, about nine million characters."""
    total, chars = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return total, part_count(docs, (chars or 0) / 6, 1.5e6)


def common_shingles(docs: DataFrame, share: float) -> tuple[int, np.ndarray, np.ndarray]:
    """N, and hashes (sorted) and document frequencies of all shingles in more than `share` of the documents.

    There can be no more than (mean shingles of a document) / share of them.
    """
    total, parts = _sized(docs)

    def often(group: pa.Table) -> pa.Table:
        _, every, _, n = _totals(group)
        hit = n > share * total
        return pa.table({"key": every[hit].view(np.int64), "df": n[hit]})

    found = asked(blocks(docs), parts).repartition(parts, "part").groupBy("part").applyInArrow(often, "key long, df long").collect()
    keys = np.array([k for k, _ in found], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return total, keys[order], np.array([d for _, d in found], float)[order]


# ------------------------------------------------------------------ sketches
@lru_cache(2)
def _sampler(samples: int) -> Sampler:
    return Sampler(samples)


class Sampler:
    """Improved consistent weighted sampling: of each weighted set `samples` elements with their levels."""

    def __init__(self, samples: int, seed: int = 11):
        r = np.random.default_rng(seed)
        self.samples = samples
        self.salt = r.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)
        self.gamma = r.gamma(2, 1, 1 << 16).astype(np.float32)
        self.log_c = np.log(r.gamma(2, 1, 1 << 16)).astype(np.float32)
        self.beta = r.random(1 << 16, dtype=np.float32)

    def draw(self, starts: np.ndarray, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Hash of (element, level) for each set (they begin at `starts`) and sample."""
        logs = np.log(weights).astype(np.float32)[:, None]
        low = np.uint64(0xFFFF)
        x = mixed(keys[:, None] * self.salt[None, :])
        r = self.gamma[(x & low).astype(np.int64)]
        beta = self.beta[((x >> np.uint64(32)) & low).astype(np.int64)]
        level = np.floor(logs / r + beta)
        value = self.log_c[((x >> np.uint64(16)) & low).astype(np.int64)] - r * (level - beta + 1)
        least = np.minimum.reduceat(value, starts, axis=0)
        owner = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
        rows, cols = np.nonzero(value == least[owner])
        pick = np.zeros(least.shape, np.int64)
        pick[owner[rows[::-1]], cols[::-1]] = rows[::-1]  # of ties the first
        at = np.arange(self.samples)[None, :]
        return mixed(keys[pick] * np.uint64(3) + level[pick, at].astype(np.int64).astype(np.uint64))


def sketches(docs: DataFrame, share: float, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_key, bands, keys, weights) of documents with an id and words. keys and weights are the weighted set."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    total, parts = _sized(docs)
    own = written(blocks(docs), "blocks")
    sums = written(answered(asked(own, parts).repartition(parts, "part")), "frequencies")  # frees the requests' shuffle files
    both = own.withColumn("part", F.lit(-1)).unionByName(sums, allowMissingColumns=True)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        counts, words = _opened(group["counts"][0].as_py(), group["words"][0].as_py())
        doc, value, n = joined_shingles(words, counts)
        keys, at = np.unique(value, return_inverse=True)
        df = np.frombuffer(b"".join(group["df"].to_pylist()[1:]), "<u4")
        if len(df) != len(keys):
            raise ValueError("a block has other shingles than it asked for")
        most = np.log1p(1 / share if share else total)
        weight = n * np.where(df > share * total, np.log1p(total / df) / most, 1.0)[at]
        known = np.frombuffer(group["known"][0].as_py(), np.uint8)
        ids, place = group["ids"][0].values, np.cumsum(known) - 1
        ends = np.flatnonzero(np.frombuffer(words, np.uint8) == 0x20)
        last = np.cumsum(counts)
        has, starts = np.unique(doc, return_index=True)
        cuts = np.r_[starts, len(doc)]
        out, lo = [], 0
        while lo < len(has):
            hi = lo + max(1, int(np.searchsorted(cuts, cuts[lo] + 4096) - lo - 1))
            a, z = cuts[lo], cuts[hi]
            drawn = _sampler(bands * rows).draw(starts[lo:hi] - a, value[a:z], weight[a:z]).reshape(hi - lo, bands, rows)
            band = mixed((drawn * _PLACES[:rows]).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)
            for j in range(lo, hi):
                d = has[j]
                if known[d]:
                    s, e, first = cuts[j], cuts[j + 1], last[d] - counts[d]
                    w = b"" if (weight[s:e] == 1).all() else weight[s:e].astype("<f4").tobytes()
                    text = words[ends[first - 1] + 1 if first else 0:ends[last[d] - 1]]
                    out.append((place[d], hashlib.blake2b(text, digest_size=16).digest(), band[j - lo].tolist(), (value[s:e] >> np.uint64(32)).astype("<u4").tobytes(), w))
            lo = hi
        columns = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()))]
        return pa.Table.from_arrays([ids.take(columns[0]), *columns[1:]], names=["doc_id", "text_key", "bands", "keys", "weights"])

    drawn = written(both.repartition(parts, "block").groupBy("block").applyInArrow(run, f"doc_id {kind}, text_key binary, bands array<long>, keys binary, weights binary"), "sketches")
    release(own, sums)
    return drawn


# ------------------------------------------------------------------ verification
def _set(keys: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = np.frombuffer(keys, "<u4")
    return k, np.frombuffer(weights, "<f4").astype(float) if weights else np.ones(len(k))


def one_to_many(one: tuple, many: list[tuple]) -> np.ndarray:
    """Weighted Jaccard similarity (sum of minima over sum of maxima) of one weighted set to many."""
    keys, weights = one
    flat, w = np.concatenate([m[0] for m in many]), np.concatenate([m[1] for m in many])
    starts = np.cumsum([0, *[len(m[0]) for m in many]])[:-1]
    at = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    both = np.add.reduceat(np.where(keys[at] == flat, np.minimum(weights[at], w), 0.0), starts)
    return both / (weights.sum() + np.add.reduceat(w, starts) - both)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) with at least that similarity. Pairs grow with the documents, so they are never broadcast. A node that is `a` of very many pairs is dealt to several tasks."""
    parts = part_count(pairs, pairs.count(), 4000)
    group = F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(64))), F.lit(parts)).cast("int")
    left = pairs.withColumn("g", group).hint("merge").join(sets.select(F.col("node").alias("b"), "keys", "weights"), "b")
    wanted = pairs.select(group.alias("h"), F.col("a").alias("one")).distinct()
    right = wanted.hint("merge").join(sets.select(F.col("node").alias("one"), F.col("keys").alias("k1"), F.col("weights").alias("w1")), "one")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = {a: _set(k, w) for a, k, w in zip(right["one"], right["k1"], right["w1"], strict=True)}
        out = []
        for a, rows in left.groupby("a"):
            for lo in range(0, len(rows), 512):
                part = rows.iloc[lo:lo + 512]
                close = one_to_many(own[a], [_set(k, w) for k, w in zip(part["keys"], part["weights"], strict=True)]) >= similarity
                out += [(a, b) for b in part["b"][close]]
        return pd.DataFrame(out, columns=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return (left.select("g", "a", "b", "keys", "weights").groupBy("g").cogroup(right.select("h", "one", "k1", "w1").groupBy("h"))
            .applyInPandas(compare, f"a {kind}, b {kind}"))


def verified_cells(cells: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links in cells (cell, side, node, class): nodes of side 0 against those of side 1 of other classes.

    A cell reports no more links than connect what it found similar, fewer than it has nodes.
    """
    parts = part_count(cells, cells.count(), 4000)
    kind = cells.schema["node"].dataType.simpleString()
    rows = cells.hint("merge").join(sets.select("node", "keys", "weights"), "node").withColumn("g", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in group.groupby("cell"):
            left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
            many = [_set(k, w) for k, w in zip(right["keys"], right["weights"], strict=True)]
            parent: dict = {}

            def top(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            for a, cls, k, w in zip(left["node"], left["class"], left["keys"], left["weights"], strict=True):
                if many:
                    close = (one_to_many(_set(k, w), many) >= similarity) & (right["class"] != cls).to_numpy()
                    for b, other in zip(right["node"][close], right["class"][close], strict=True):
                        if (x := top(cls)) != (y := top(other)):
                            parent[x] = y
                            out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"])

    return rows.select("g", "cell", "side", "node", "class", "keys", "weights").groupBy("g").applyInPandas(compare, f"a {kind}, b {kind}")


def _classes(links: DataFrame) -> DataFrame:
    """(node, class) of linked nodes."""
    return written(components(links.select(F.lit(0).alias("circuit_id"), F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("vertex").alias("node"), F.col("component").alias("class")), "classes")


def near_links(members: DataFrame, sets: DataFrame, similarity: float, rounds: int = 2) -> DataFrame:
    """Links (a, b) that connect all similar nodes that share a bucket; members (bucket, node)."""
    links, labelled = None, members.withColumn("class", F.col("node"))
    for r in range(rounds):
        centre = F.min(F.struct(F.xxhash64("node", F.lit(r)), "node", "class")).alias("c")
        centres = labelled.groupBy("bucket").agg(centre).select("bucket", F.col("c.node").alias("a"), F.col("c.class").alias("ca"))
        pairs = labelled.join(centres, "bucket").filter("class <> ca").select("a", F.col("node").alias("b")).distinct()
        new = written(verified(written(pairs, "pairs"), sets, similarity), "links")
        links = new if links is None else links.unionByName(new)
        known = _classes(links)
        labelled = written(members.join(known, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class")), "labelled")
    sizes = labelled.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.groupBy("bucket").agg(F.max(F.struct("n", "class")).alias("m"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("n_classes")).filter("n_classes > 1")
    open_ = labelled.join(large.select("bucket", F.col("m.class").alias("largest"), (F.ceil(F.col("n_all") / CELL)).cast("int").alias("nc"),
                                       F.ceil((F.col("n_all") - F.col("m.n")) / CELL).cast("int").alias("oc")), "bucket")
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")
    other = open_.filter(F.col("class") != F.col("largest")).withColumn("o", place(F.col("oc"), 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("nc") - 1))).withColumn("side", F.lit(0))
    every = open_.withColumn("c", place(F.col("nc"), 2)).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("oc") - 1))).withColumn("side", F.lit(1))
    cells = other.select("bucket", "o", "c", "side", "node", "class").unionByName(every.select("bucket", "o", "c", "side", "node", "class"))
    cells = written(cells.select(F.xxhash64("bucket", "o", "c").alias("cell"), "side", "node", "class"), "cells")
    return links.unionByName(written(verified_cells(cells, sets, similarity), "links"))


def near_duplicates(documents: DataFrame, similarity: float = 0.8, bands: int = 12, rows: int = 3, share: float = 0.05) -> DataFrame:
    """(doc_id, class_id), one row per row of `documents`.

    class_id is the least id of the documents that equal or resemble each other, directly or through others. Texts are
    equal if their words are. With a `share` of 0 every shingle weighs by its own document frequency.
    A text without words (null, empty) is alone, and so is a row with a null id, whose class is null. Rows with one id
    are one document. Other columns are not read.
    """
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    drawn = sketches(docs, share, bands, rows)
    texts = drawn.groupBy("text_key").agg(F.min("doc_id").alias("node"))
    owner = written(drawn.select("doc_id", "text_key").join(texts, "text_key").select("doc_id", "node").distinct(), "owners")
    nodes = owner.filter("doc_id = node").select("node").distinct()
    every = (drawn.select(F.col("doc_id").alias("node"), "bands").join(nodes, "node").select("node", F.posexplode("bands").alias("band", "value"))
             .select(F.xxhash64("band", "value").alias("bucket"), "node").distinct())
    every = written(every, "members")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    members = written(every.join(shared, "bucket"), "shared-members")
    sets = written(drawn.select(F.col("doc_id").alias("node"), "keys", "weights").join(members.select("node").distinct().hint("merge"), "node", "left_semi"), "sets")
    links = near_links(members, sets, similarity)
    links = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "all-links")
    known = _classes(links)
    classes = known.groupBy("class").agg(F.min("node").alias("class_id"))
    named = owner.join(known.join(classes, "class").select("node", "class_id"), "node", "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("class_id", "node")).alias("class_id"))
    return (documents.select("doc_id").join(named.withColumnRenamed("doc_id", "_d"), F.col("doc_id") == F.col("_d"), "left")
            .select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")))


def one_of_each(documents: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`documents` with only the rows of one id of each class; rows with a null id stay."""
    gone = near_duplicates(documents, similarity, share=0.0).filter("class_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
