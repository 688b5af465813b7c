"""Alignment of two tokenizers: which tokens of one cover which tokens of the other, counted over the corpus.

Every text is encoded by both; byte offsets where tokens of both end cut it into groups, and each two tokens whose byte
ranges overlap are a link. For each pair of ids the corpus keeps an inverted bitmap: documents are dealt to blocks, and a
pair's part in one block is a compressed bitmap over the block's documents (sorted places or a bitset, whichever is
shorter). Bits of the documents of a block are ORed into it, blocks hold different documents, so the popcounts of a pair add up
to its count of documents. How often a pair is linked in a document stands in bit planes beside the bitmap: plane j has bit j of
the number of links less one. Scores of the pairs go back along the same postings to the documents of their blocks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.bpe import byte_symbols
from wireloom.llm.common import part_count, pieces, written

#: A pair of ids is one number: A id * SHIFT + B id (23 and 24 bits; 16 more are for the place in a block).
SHIFT = 1 << 24


# ------------------------------------------------------------------ compressed bitmaps
def pack(places: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """Posting of one pair in a block of `size` documents: sorted places, and the number of links at each of them.

    Byte 0 says how the bitmap is kept (0: places of 16 bits, 1: bitset), byte 1 the number of planes; then the number
    of documents, the bitmap and the planes.
    """
    as_places = 2 * len(places) <= (size + 7) // 8
    if as_places:
        body = places.astype("<u2").tobytes()
    else:
        bits = np.zeros(size, bool)
        bits[places] = True
        body = np.packbits(bits).tobytes()
    more = counts - 1
    planes = int(more.max()).bit_length()
    return (bytes([not as_places, planes]) + len(places).to_bytes(4, "little") + body
            + b"".join(np.packbits(more >> j & 1 != 0).tobytes() for j in range(planes)))


def popcount(posting: bytes) -> int:
    """Documents of a posting."""
    return int.from_bytes(posting[2:6], "little")


def link_count(posting: bytes) -> int:
    """Links of a posting: one for each document, and those that the planes add."""
    n, out = popcount(posting), popcount(posting)
    width, end = (n + 7) // 8, len(posting)
    for j in range(posting[1]):
        at = end - (posting[1] - j) * width
        out += int.from_bytes(posting[at:at + width], "big").bit_count() << j
    return out


def unpack(posting: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of links of a posting."""
    n = popcount(posting)
    if posting[0]:
        at = 6 + (size + 7) // 8
        places = np.flatnonzero(np.unpackbits(np.frombuffer(posting[6:at], np.uint8), count=size))
    else:
        at = 6 + 2 * n
        places = np.frombuffer(posting[6:at], "<u2").astype(np.int64)
    counts, width = np.ones(n, np.int64), (n + 7) // 8
    for j in range(posting[1]):
        counts += np.unpackbits(np.frombuffer(posting[at + j * width:at + (j + 1) * width], np.uint8), count=n).astype(np.int64) << j
    return places, counts


# ------------------------------------------------------------------ tokens
class Pair:
    """Both tokenizers with the byte lengths of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        of = {s: i for i, s in enumerate(byte_symbols())}
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = {v: k for k, v in ranks.items()}
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names]
        self.length_a = np.zeros(max(self.bytes_a) + 1, np.int64)
        for i, x in self.bytes_a.items():
            self.length_a[i] = len(x)
        self.length_b = np.array([len(x) for x in self.bytes_b])
        # every id as it is written in front of another one of its group, and at the end of its part
        n_a, n_b = len(self.length_a), len(self.length_b)
        self.written = [f"{i}{sign}" for i in range(n_a) for sign in ",|"] + [f"{i}{sign}" for i in range(n_b) for sign in ",;"]
        self.code_a, self.code_b = np.arange(n_a) * 2, np.arange(n_b) * 2 + 2 * n_a

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text by A and of text by B; None if there is no text or tokens don't spell it. A's are the
        bytes themselves, so they always do if their lengths add up."""
        if not text:
            return None
        spelt = " " + text
        a, b, data = self.a.encode_ordinary(spelt), self.b.encode(text, num_threads=1), spelt.encode()
        if b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        ids = np.array(a, np.int64)
        return (ids, np.array(b, np.int64)) if self.length_a[ids].sum() == len(data) else None


@functools.cache
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def linked(own: Pair, a: np.ndarray, b: np.ndarray) -> tuple[str, int, np.ndarray]:
    """The groups as text `a1,a2|b1;a3|b2,b3`, their number, and the pair number of every link: between two cuts of
    either tokenizer stands one token of each, and every such stretch is another link."""
    end_a, end_b = np.cumsum(own.length_a[a]), np.cumsum(own.length_b[b])
    ends = np.zeros(end_a[-1] + 1, np.uint8)
    ends[end_a] = 1
    ends[end_b] += 2
    kind = ends[ends > 0]  # at each cut: 1 a token of A ends, 2 one of B, 3 both
    is_a, is_b = kind & 1, kind >> 1
    at_a, at_b = np.cumsum(is_a, dtype=np.int64) - is_a, np.cumsum(is_b, dtype=np.int64) - is_b
    both = kind == 3
    last_a, last_b = at_a[both] + 1, at_b[both] + 1  # tokens up to the end of each group
    n_a, n_b = np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)
    # a group's tokens of A stand behind the tokens of B of earlier groups, its tokens of B behind those of A up to it
    code = np.empty(len(a) + len(b), np.int64)
    mark_a, mark_b = own.code_a[a], own.code_b[b]
    mark_a[last_a - 1] += 1
    mark_b[last_b - 1] += 1
    code[np.arange(len(a)) + np.repeat(last_b - n_b, n_a)] = mark_a
    code[np.arange(len(b)) + np.repeat(last_a, n_b)] = mark_b
    return "".join(map(own.written.__getitem__, code.tolist()))[:-1], len(last_a), a[at_a] * SHIFT + b[at_b]


# ------------------------------------------------------------------ corpus
_DOC = "doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string"
_NAMES = ["block", "place", "size", "pair", "n", "links", "posting", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _postings_of(block: int, size: int, keys: list[np.ndarray], counts: list[np.ndarray], id_type: pa.DataType):
    """Batches of the postings of one block. A key is the pair's number and, in its last 16 bits, the place."""
    key, n = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*counts, np.zeros(0, np.int64)])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    pair, place = key >> 16, key & 0xFFFF
    starts = np.flatnonzero(np.diff(pair, prepend=-1))
    ends = np.append(starts[1:], len(pair))
    for lo in range(0, len(starts), 4096):
        part = slice(lo, lo + 4096)
        data = [pack(place[s:e], n[s:e], size) for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
        m = len(data)
        yield pa.RecordBatch.from_arrays(
            [pa.array([block] * m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([size] * m, pa.int32()), pa.array(pair[starts[part]]), pa.array(map(popcount, data), pa.int64(), size=m),
             pa.array(map(link_count, data), pa.int64(), size=m), pa.array(data, pa.binary()), pa.nulls(m, id_type), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.string())], names=_NAMES)


def _documents_of(block: int, docs: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    size, cols = len(docs), list(zip(*docs, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array([block] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array([size] * size, pa.int32()), *[pa.nulls(size, pa.int64())] * 3, pa.nulls(size, pa.binary()),
         pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:5]], pa.array(cols[5], pa.string())], names=_NAMES)


def postings(documents: DataFrame, vocabularies: tuple[str, str] | None = None, digest: bool = False,
             block_docs: int = 4096, block_links: int = 2_000_000) -> DataFrame:
    """One table of two kinds of rows: documents (`pair` null) and postings (`place` null), to be written before use.

    A task puts its documents into blocks of `block_docs`, and begins a new one early once it holds `block_links`
    postings. A document is known by its block and place, so repeated and null ids do no harm. `groups` is the text
    `a1,a2|b1;a3|b2,b3`, with `digest` its SHA-256, and empty without tokens: for null and empty texts and those that
    the tokens don't spell. Other columns are not read; no rows give no rows.
    """
    paths, kind = vocabularies or default_vocabularies(), documents.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own, block = tokenizers(*paths), TaskContext.get().partitionId() << 32
        docs, keys, counts, held, id_type = [], [], [], 0, None
        for b in pieces(batches, 64):
            id_type = b["doc_id"].type
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                got = own.tokens(text)
                if got is None:
                    docs.append((doc, 0, 0, 0, 0, ""))
                else:
                    groups, n_groups, pairs = linked(own, *got)
                    pair, n = np.unique(pairs, return_counts=True)
                    keys.append(pair << 16 | len(docs))
                    counts.append(n)
                    held += len(n)
                    docs.append((doc, len(got[0]), len(got[1]), n_groups, len(pairs), hashlib.sha256(groups.encode()).hexdigest() if digest else groups))
                if len(docs) >= block_docs or held >= block_links:
                    yield from _postings_of(block, len(docs), keys, counts, id_type)
                    yield _documents_of(block, docs, id_type)
                    docs, keys, counts, held, block = [], [], [], 0, block + 1
        if docs:
            yield from _postings_of(block, len(docs), keys, counts, id_type)
            yield _documents_of(block, docs, id_type)

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, "block long, place int, size int, pair long, n long, links long, posting binary, " + _DOC.format(kind=kind))


def pair_counts(index: DataFrame) -> DataFrame:
    """(pair, a, b, documents, links, best): how many documents hold the pair linked, how many links they hold, and
    whether no other pair of the same A id stands in more documents. `index` is what `postings` gives."""
    a, b = F.floor(F.col("pair") / SHIFT).cast("long"), F.pmod("pair", F.lit(SHIFT))
    total = written(index.filter("pair is not null").groupBy("pair").agg(F.sum("n").alias("documents"), F.sum("links").alias("links")).withColumns({"a": a, "b": b}), "pairs")
    top = total.groupBy("a").agg(F.max("documents").alias("most"))
    return total.join(top, "a").select("pair", "a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))


def score_documents(index: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per document of `index`.

    Every posting takes its pair's score back to the block; a block's rows pass by in order, and two numbers for each
    of its documents are all that is kept.
    """
    kind = index.schema["doc_id"].dataType.simpleString()
    docs = index.filter("pair is null").drop("pair", "n", "links")
    back = (index.filter("pair is not null").select("block", "place", "size", "pair", "posting", *index.columns[7:])
            .join(counts.select("pair", "documents", "best"), "pair").drop("pair"))
    rows = docs.withColumns({"documents": F.lit(None).cast("long"), "best": F.lit(None).cast("boolean")}).unionByName(back)
    n = part_count(rows, index.count(), 400_000)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def run(batches):
        block, sums, own = None, None, []

        def done():
            for d in own:
                at = d["place"].to_numpy()
                yield pa.RecordBatch.from_arrays([*[d[c] for c in names[:5]], pa.array(sums[1][at]), pa.array(sums[0][at]), d["groups"]], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            blocks = b["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                part = b.slice(s, e - s)
                if blocks[s] != block:
                    yield from done()
                    block, size, own = blocks[s], part["size"][0].as_py(), []
                    sums = np.zeros((2, size), np.int64)
                is_doc = part["posting"].is_null()
                if is_doc.true_count:
                    own.append(part.filter(is_doc))
                got = part.filter(pc.invert(is_doc))
                if got.num_rows:
                    _add(sums, got["posting"].to_pylist(), got["documents"].to_numpy(), got["best"].to_numpy(zero_copy_only=False).astype(np.int64))
        yield from done()

    out = ", ".join(f"{c} {kind if c == 'doc_id' else 'string' if c == 'groups' else 'long'}" for c in names)
    return rows.repartition(n, "block").sortWithinPartitions("block", "place").mapInArrow(run, out)


def _add(sums: np.ndarray, data: list[bytes], documents: np.ndarray, best: np.ndarray) -> None:
    """Adds score times links of every posting to the sums of its documents; row 0: counts, row 1: best links."""
    plain = [not (d[0] or d[1]) for d in data]  # places without planes: one link each
    size, which = sums.shape[1], np.array(plain)
    bodies = [d[6:] for d, p in zip(data, plain, strict=True) if p]
    if bodies:
        place = np.frombuffer(b"".join(bodies), "<u2")
        times = [len(x) // 2 for x in bodies]
        for row, value in ((0, documents), (1, best)):
            np.add.at(sums[row], place, np.repeat(value[which], times))
    for d, n, x, p in zip(data, documents.tolist(), best.tolist(), plain, strict=True):
        if not p:
            place, links = unpack(d, size)
            sums[0][place] += n * links
            sums[1][place] += x * links


def align(documents: DataFrame, vocabularies: tuple[str, str] | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scored documents and counted pairs of a corpus; see `postings`, `pair_counts` and `score_documents`."""
    index = written(postings(documents, vocabularies, digest), "postings")
    counts = written(pair_counts(index), "pair-counts")
    return score_documents(index, counts), counts.drop("pair")


def alignment_report(documents: DataFrame, vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row per row of `documents`."""
    return align(documents, vocabularies, digest=True)[0].withColumnRenamed("groups", "groups_sha256")
