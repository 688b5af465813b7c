"""Toxicity of whole documents after noisy-channel deobfuscation.

Spellings such as `1d10t`, `i.d.i.o.t`, `i d i o t` and `idiooot` come from plain words through a channel that swaps
letters for look-alikes, puts separators between them and repeats them. A suspicious token becomes a lattice: for each
character (or run of one character) the letters it can stand for, with a cost each. Viterbi decoding finds the path of
the lowest cost under the channel and a character trigram model; the path's text replaces the token, and the restored
text is scored.

The score rests on words and word beginnings that are much more frequent in toxic documents, learned from labelled
rows; their weights are summed over the distinct words of a document, and a logistic curve fitted on other labelled
rows turns the sum into a probability. Tokens seen before in a task are looked up, so the work per document is one
lookup per token.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm.common import pieces, words_of, written
from wireloom.operators.scale import release

# Letters that digits and symbols stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
              "!": "i", "|": "il", "+": "t", "*": "aeiou"}
SEPARATORS = "._-*'~^`|"
SWAP, DROP, KEEP, COLLAPSE, DOUBLE = 0.7, 0.5, 4.0, 0.3, 2.5
UNSEEN = 12.0  # cost of a trigram that training never met


# ------------------------------------------------------------------ channel
def core(token: str) -> str:
    """The token without what surrounds words in ordinary or noisy text: punctuation, runs of one symbol."""
    def edge(t: str) -> str:
        while t and not t[0].isalnum():
            run = len(t) - len(t.lstrip(t[0]))
            if t[0] in "@$|" and run < 3:
                break
            t = t[run:]
        return t
    return edge(edge(token)[::-1])[::-1]


def suspicious(token: str) -> bool:
    """Letters mixed with look-alikes or separators, or a character three times in a row."""
    if token.isalpha():
        return any(a == b == c for a, b, c in zip(token, token[1:], token[2:], strict=False))
    return any(c.isalpha() for c in token) and any(c in LOOKALIKES or c in SEPARATORS for c in token)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each run of one character: (letters, cost), the possible readings."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c, run = token[at], 1
        while at + run < len(token) and token[at + run] == c:
            run += 1
        if c.isalpha():
            reads = {c: 0.0} if run == 1 else {c: DOUBLE, c * 2: 0.0} if run == 2 else {c: COLLAPSE, c * 2: COLLAPSE}
        else:
            reads = {c * run: KEEP}
            for letter in LOOKALIKES.get(c, ""):
                reads[letter] = SWAP + COLLAPSE * (run > 1)
                if run > 1:
                    reads[letter * 2] = 2 * SWAP
            if c in SEPARATORS:
                reads[""] = DROP
        out.append(sorted(reads.items()))
        at += run
    return out


def decode(token: str, model: dict[str, float]) -> str:
    """Viterbi path through the lattice of a token; states are the last two letters, ties go to the smaller text."""
    best: dict[str, tuple[float, str]] = {"^^": (0.0, "")}
    for reads in [*lattice(token), [("$", 0.0)]]:
        step: dict[str, tuple[float, str]] = {}
        for state, (cost, text) in best.items():
            for letters, price in reads:
                s, total = state, cost + price
                for x in letters:
                    total += model.get(s + x, UNSEEN)
                    s = s[1] + x
                value = (total, text + letters)
                if s not in step or value < step[s]:
                    step[s] = value
        best = step
    return min(best.values())[1][:-1]


#: Marks tokens that may be noisy: a look-alike or separator between or beside letters, a letter three times.
NOISY = re.compile(rb"[a-z\x80-\xff](?:[0-9@$!|*+._'~^`-]+[a-z\x80-\xff]|[0-9@$|])|[0-9@$|][a-z\x80-\xff]|([a-z])\1\1")
_SHAPE = bytes(0x20 if chr(c).isspace() and c < 0x80 else 0x78 for c in range(256))
_CONTINUED = bytes(range(0x80, 0xC0))


def spelled(text: str) -> list[str]:
    """Runs of three or more single characters between spaces, joined; a run of one character only is no word."""
    out, single = [], []
    for token in [*text.split(), ""]:
        if len(token) == 1:
            single.append(token)
        else:
            if len(single) > 2 and len(set(single)) > 1:
                out.append("".join(single))
            single = []
    return out


def trigrams(word: str) -> list[str]:
    w = f"^^{word}$"
    return [w[i:i + 3] for i in range(len(w) - 2)]


#: Letters of the word beginnings that carry weights.
HEADS = (4, 5, 6)


def features(word: str) -> list[str]:
    """The word and its beginnings of four to six letters."""
    return [word + "$", *[word[:n] for n in HEADS if len(word) >= n]]


# ------------------------------------------------------------------ model
@dataclass
class Model:
    letters: dict[str, float]  # trigram -> cost
    weights: dict[str, float]  # feature -> weight
    curve: tuple[float, float] = (1.0, 0.0)
    cache: dict[str, tuple[tuple[str, float], ...]] = field(default_factory=dict)
    heads: frozenset[bytes] = frozenset()

    def __post_init__(self):
        self.heads = frozenset(f.removesuffix("$").encode()[:4] for f in self.weights)

    def restored(self, token: str) -> str:
        """A token as it reads after deobfuscation; ordinary tokens stay."""
        low = core(token.lower())
        return decode(low, self.letters) if suspicious(low) else token

    def evidence(self, token: str) -> tuple[tuple[str, float], ...]:
        """Words of the restored token that carry a weight, with the largest weight of their features."""
        got = self.cache.get(token)
        if got is None:
            words = [w.decode() for w in words_of(self.restored(token).encode())]
            got = tuple((w, x) for w in words if (x := self.weight(w)) > 0)
            if len(token) <= 40:
                if len(self.cache) >= 200_000:
                    self.cache.clear()
                self.cache[token] = got
        return got

    def total(self, text: str) -> float:
        """Sum of the weights of the distinct words of the text and of the readings that deobfuscation adds.

        Plain words are looked up by their first bytes; only tokens that a scan marks are decoded.
        """
        raw, found = text.encode(), {}
        for w in set(words_of(raw)):
            if w[:4] in self.heads and (x := self.weight(word := w.decode())) > 0:
                found[word] = x
        if NOISY.search(raw.lower()):
            for token in set(text.split()):
                if NOISY.search(token.lower().encode()):
                    found.update(self.evidence(token))
        if b" x x x " in (b" " + raw + b" ").translate(_SHAPE, _CONTINUED):
            for joined in spelled(text):
                found.update(self.evidence(joined))
        return sum(found.values())

    def weight(self, word: str) -> float:
        return max(self.weights.get(f, 0.0) for f in features(word))

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.curve[0] * self.total(text) + self.curve[1]))))


def restored_text(text: str, model: Model) -> str:
    """The whole text with deobfuscated tokens, single spaces between them."""
    out, single = [], []
    for token in [*text.split(), None]:
        if token is not None and len(token) == 1:
            single.append(token)
            continue
        if single:
            joined = "".join(single)
            out += [model.restored(joined)] if len(single) > 2 and len(set(single)) > 1 and model.evidence(joined) else single
            single = []
        if token is not None:
            out.append(model.restored(token))
    return " ".join(out)


def fold() -> Column:
    """crc32 of the document id as text, modulo 4."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic, calibrate) of all labelled documents with fold other than 2.

    Copies would make the words of one text look like words of its label, so of documents with the same least hash of
    five words (near copies mostly) and the same label one stays.
    """
    h = F.xxhash64(F.col("doc_id").cast("string"))
    known = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
             .filter(fold() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .select(F.col("doc_id").alias("_id"), "toxic", (F.pmod(h, F.lit(4)) == 0).alias("calibrate")))
    docs = documents.filter("doc_id is not null").filter(fold() != 2).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.join(known.hint("merge"), F.col("doc_id") == F.col("_id"))  # labels grow with the documents, so they are never broadcast
    least = lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - 4)), lambda i: F.xxhash64(F.slice(w, i, 5))))
    rows = rows.select("_id", "text", "toxic", "calibrate", F.transform(F.array(F.split(F.lower("text"), " ")), least)[0].alias("least"))  # words split once
    first = Window.partitionBy("least", "toxic").orderBy("_id", "text")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("text", "toxic", "calibrate")


#: Words and word beginnings that a task counts before it passes the counts on.
KEYS_AT_ONCE = 300_000


def count(batches):
    """Documents (clean, toxic) with each word (`f`, as `word$`) and word beginning, trigrams of distinct words, rows."""
    def table(words, heads, sizes):
        rows, letters = [("n", "", *sizes)], Counter()
        for w in words[0].keys() | words[1].keys():
            n0, n1 = words[0][w], words[1][w]
            rows.append(("f", w + "$", n0, n1))
            for g in trigrams(w):
                letters[g] += n0 + n1
        rows += [("f", h, heads[0][h], heads[1][h]) for h in heads[0].keys() | heads[1].keys()]
        rows += [("c", g, n, 0) for g, n in letters.items()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i < 2 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))], names=["kind", "key", "n0", "n1"])

    fresh = lambda: ((Counter(), Counter()), (Counter(), Counter()), [0, 0])
    words, heads, sizes = fresh()
    for b in pieces(batches):
        for text, toxic in zip(b["text"].to_pylist(), b["toxic"].to_pylist(), strict=True):
            sizes[toxic] += 1
            own = b" ".join(set(words_of(text.encode()))).decode().split(" ")
            if own != [""]:
                words[toxic].update(own)
                for n in HEADS:
                    heads[toxic].update({w[:n] for w in own if len(w) >= n})
        if sum(map(len, words + heads)) >= KEYS_AT_ONCE:
            yield table(words, heads, sizes)
            words, heads, sizes = fresh()
    if sum(sizes):
        yield table(words, heads, sizes)


def train(documents: DataFrame, labels: DataFrame, n_features: int = 5_000, n_trigrams: int = 50_000,
          least_toxic: int = 4, least_strength: float = 6.0) -> Model:
    """Model from all labelled rows that are not held out; three quarters give features and trigrams, the rest the curve.

    A feature must occur in `least_toxic` toxic documents; its weight, the logarithm of how much more frequent it is there
    than in others, times the square root of their number must reach `least_strength`.
    Without labelled rows the model knows nothing and every score is below one half.
    """
    rows = written(training_rows(documents, labels), "labelled")
    counts = rows.filter("not calibrate").select("text", "toxic").mapInArrow(count, "kind string, key string, n0 long, n1 long")
    counts = written(counts.groupBy("kind", "key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "label-counts")
    total = counts.filter("kind = 'n'").first()
    clean, toxic = (total.n0, total.n1) if total else (0, 0)
    ratio = ((F.col("n1") + 0.5) / (toxic + 1)) / ((F.col("n0") + 0.5) / (clean + 1))
    best = (counts.filter((F.col("kind") == "f") & (F.col("n1") >= least_toxic)).withColumn("weight", F.log(ratio)).withColumn("strength", F.col("weight") * F.sqrt("n1"))
            .filter(F.col("strength") >= least_strength).orderBy(F.desc("strength"), "key").limit(n_features).select("key", "weight").collect())
    grams = counts.filter("kind = 'c'").orderBy(F.desc("n0"), "key").limit(n_trigrams).select("key", "n0").collect()
    context: Counter[str] = Counter()
    for key, n in grams:
        context[key[:2]] += n
    model = Model({k: -math.log(n / (context[k[:2]] + 1)) for k, n in grams}, {k: w for k, w in best})
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def bins(batches):
        for b in pieces(batches):
            totals = [min(200, round(4 * shared.value.total(t))) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), b["toxic"]], names=["bin", "toxic"])

    held = rows.filter("calibrate").select("text", "toxic").mapInArrow(bins, "bin int, toxic int").groupBy("bin", "toxic").count().collect()
    model.curve = logistic([(b / 4, y, n) for b, y, n in held])
    release(rows, counts)
    return model


def logistic(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (value, label, rows), by Newton steps with a light prior."""
    a, b = 1.0, -2.0
    for _ in range(60):
        g0, g1, h00, h01, h11 = 0.01 * (a - 1), 0.01 * (b + 2), 0.01, 0.0, 0.01
        for x, y, n in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            d, h = n * (p - y), n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + d * x, g1 + d, h00 + h * x * x, h01 + h * x, h11 + h
        det = h00 * h11 - h01 * h01
        a, b = a - max(-1.0, min(1.0, (h11 * g0 - h01 * g1) / det)), b - max(-1.0, min(1.0, (h00 * g1 - h01 * g0) / det))
    return a, b


# ------------------------------------------------------------------ operator
def scores(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), one row per row of `documents`; null texts count as empty. Repeated rows give equal rows."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by n_features and n_trigrams

    def run(batches):
        own = shared.value
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([own.score(t or "") for t in b["text"].to_pylist()], pa.float64())], names=["doc_id", "score"])

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `documents`; learns only from rows that are not held out.

    A null id is not held out and never learned from. Empty tables give an empty result or scores of an untrained model.
    """
    return scores(documents, train(documents, labels)).select(
        "doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """`documents` without the rows whose text has a score at or above the threshold; each row is judged by itself, whatever its id."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))  # bounded by n_features and n_trigrams

    def run(batches):
        own = shared.value
        for b in pieces(batches):
            stays = pa.array([own.score(t or "") < threshold for t in b["text"].to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([b["row"]], names=["row"]).filter(stays)

    rows = documents.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
