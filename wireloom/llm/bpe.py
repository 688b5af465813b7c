"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each leaf holds the rank of the pair that begins at a symbol, with its place as the tie-break, so the root is the
leftmost pair of the lowest rank. A merge changes three leaves at most, each in logarithmic time, until the root says
that no pair can be merged: a piece of n bytes takes O(n log n).

The vocabulary file is read by the tasks from `vocabulary`, a path that all machines have; it is never copied. The
normalisation and the split into pieces are those of the file, run by the tokenizers library; merges, ids and decoding
are done here.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import pieces

NONE = 1 << 62


def merge_piece(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges. `ranks`: pair of ids -> (rank, id of the merged symbol).

    `node` is the segment tree: leaf i, at size + i, is rank * n + i of the pair that begins at symbol i (NONE if it
    cannot be merged), every inner node the smaller of its two, so node[1] is the leftmost pair of the lowest rank.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    ids, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    rank = ranks.get
    leaves = [NONE if (r := rank(p)) is None else r[0] * n + i for i, p in enumerate(zip(ids, ids[1:], strict=False))]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    node = [NONE] * size + leaves + [NONE] * (size - n + 1)
    for i in range(size - 1, 0, -1):
        a, b = node[2 * i], node[2 * i + 1]
        node[i] = a if a < b else b
    while (top := node[1]) != NONE:
        i = top % n
        j = after[i]
        x = ids[i] = rank((ids[i], ids[j]))[1]
        ids[j] = -1
        after[i] = k = after[j]
        h = before[i]
        if k >= 0:
            before[k] = i
            changed = [(i, NONE if (r := rank((x, ids[k]))) is None else r[0] * n + i), (j, NONE)]
        else:
            changed = [(i, NONE)]
        if h >= 0:
            changed.append((h, NONE if (r := rank((ids[h], x))) is None else r[0] * n + h))
        for place, value in changed:
            place += size
            if node[place] == value:
                continue
            node[place] = value
            while place > 1:
                other = node[place ^ 1]
                if other < value:
                    value = other
                place >>= 1
                if node[place] == value:
                    break
                node[place] = value
    return [x for x in ids if x >= 0]


class Recent:
    """Lookup table in two generations: when the young one is full it becomes the old one, so what is used stays."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


#: Characters up to U+012F that print: normalisation leaves them alone, and letters are those of `isalpha`.
_SIMPLE = "\u0130"
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\w\s\xb2\xb3\xb9\xbc-\xbe]|_)+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library (BPE with an end-of-word suffix)."""

    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"merges": [], "vocab": {k: v for k, v in model["vocab"].items() if len(k) == 1}}}))
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        vocab, self.symbols = self.vocab, byte_symbols()
        self.ranks = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [""] * size
        for k, v in (vocab | self.special).items():
            self.token[v] = k
        self.chunks, self.merged = Recent(cached), Recent(cached)

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece, in byte symbols."""
        got = self.merged.get(piece)
        if got is None:
            vocab = self.vocab
            symbols = [vocab[s] for s in (*piece[:-1], piece[-1] + self.suffix) if s in vocab]
            got = np.array(merge_piece(symbols, self.ranks), "<u4").tobytes()
            if len(piece) <= 48:
                self.merged.put(piece, got)
        return got

    def _plain(self, text: str) -> bytes:
        """Ids of text without spaces and special tokens. Simple characters are cut here, others by the library."""
        if text.isprintable() and max(text) < _SIMPLE:
            pieces = _PIECES.findall(text.lower())
            if not text.isascii():
                symbols = self.symbols
                pieces = ["".join([symbols[b] for b in p.encode()]) for p in pieces]
        else:
            pieces = [p for p, _ in self.split(self.normalize(text))]
        return b"".join([self._piece(p) for p in pieces])

    def _chunk(self, chunk: str) -> bytes:
        if "<|" in chunk and (parts := self.special_pattern.split(chunk))[1:]:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) if p else b"" for p in parts)
        return self._plain(chunk)

    def encode_decode(self, text: str) -> tuple[bytes, str]:
        """Ids of a text, as little-endian unsigned 32-bit integers, and the text that they decode to. Neither a piece nor
        a special token holds a space, and no normalisation reaches across one, so the ids are those of the chunks
        between spaces, and the decoded text is theirs with spaces in between; chunks seen lately are looked up."""
        young, ids, words = self.chunks.young, [], []
        for chunk in text.replace("\n", " ").split(" "):
            if not chunk:
                continue
            got = young.get(chunk)
            if got is None:
                got = self.chunks.get(chunk)
                if got is None:
                    own = self._chunk(chunk)
                    got = own, self.decode(own)
                    if len(chunk) <= 48:
                        self.chunks.put(chunk, got)
                young = self.chunks.young
            if got[0]:
                ids.append(got[0])
                words.append(got[1])
        return b"".join(ids), " ".join(words)

    def encode(self, text: str) -> bytes:
        return self.encode_decode(text)[0]

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces: the file names no decoder, so byte symbols and suffixes stay as they are."""
        return " ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), one row per row of `documents`; whole texts, no truncation.

    `ids` holds little-endian unsigned 32-bit integers, `decoded` the text that `decode` gives for them. A null text
    is an empty one: no ids, empty `decoded`. Repeated rows give equal rows; other columns are not read.
    """
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        for b in pieces(batches, 64):
            done = [own.encode_decode(t or "") for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array([len(x) // 4 for x, _ in done], pa.int64()), pa.array([x for x, _ in done], pa.binary()),
                 pa.array([y for _, y in done], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        own = codec(path)
        for b in pieces(batches, 64):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([own.decode(x or b"") for x in b["ids"].to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
