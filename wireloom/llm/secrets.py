"""Secrets in whole documents: fixed patterns, and a character convolutional network over further candidates.

Every candidate (a long token of letters and digits, or a value behind a credential word) is read with the characters
around it by a small network in numpy: embedded characters, one convolution, max and mean over the places, one logit.
It is trained on labelled findings: those of the fixed patterns in all documents, other candidates there, and drawn
examples of public key formats and of look-alikes, put into their contexts. Many findings are dealt to parts, whose
networks are averaged between rounds. Logits are
calibrated (Platt) on findings left out of training; the threshold of each kind is the highest that still keeps the
wanted recall on those findings.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import pieces, written
from wireloom.operators.scale import release

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is a run that is not shorter
KINDS = ("assign", "access", "hex", "assigned", "key")
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

#: Further candidates: tokens with letters and digits, and what stands behind other words for credentials.
KEY = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
ASSIGNED = re.compile(r"""(?i:pwd|passphrase|bearer|authorization|credentials?|private[_ -]key|access[_ -]key|client[_ -]id)["']?\x20*(?:[:=]\x20*|\x20)["']?([^\s"'<>|,;]{6,})""", re.A)
_ASSIGNED_WORDS = ("pwd", "passphrase", "bearer", "authorization", "credential", "private", "access", "client")

BEFORE, INSIDE, AFTER = 24, 48, 24
WIDTH = BEFORE + INSIDE + AFTER


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by start and then by kind as listed."""
    low, out = text.lower(), []
    if ("=" in low or ":" in low) and any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything the network looks at, in order."""
    out, low = [], text.lower()
    if any(w in low for w in _ASSIGNED_WORDS):
        out += [("assigned", *m.span(1)) for m in ASSIGNED.finditer(text)]
    taken = {s[1:] for s in out}
    for m in KEY.finditer(text):
        t = m[0]
        if m.span() not in taken and any(c.isdigit() for c in t) and any(c.isalpha() for c in t):
            out.append(("key", *m.span()))
    return sorted(out, key=lambda s: s[1:])


# ------------------------------------------------------------------ network
_CODE = np.full(256, 96, np.uint8)
_CODE[32:127] = np.arange(95)
PAD = 97


def encoded(before: str, inside: str, after: str) -> np.ndarray:
    """Rows of WIDTH character codes; a long candidate gives a row for each window of it."""
    step = INSIDE // 2
    cuts = range(0, max(1, len(inside) - INSIDE + step), step)
    rows = np.full((len(cuts), WIDTH), PAD, np.uint8)
    for row, at in zip(rows, cuts, strict=True):
        left, mid, right = (inside[max(0, at - BEFORE):at] or before[-BEFORE:]), inside[at:at + INSIDE], (inside[at + INSIDE:at + INSIDE + AFTER] or after[:AFTER])
        for place, part in ((BEFORE - len(left), left), (BEFORE, mid), (BEFORE + INSIDE, right)):
            row[place:place + len(part)] = _CODE[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
    return rows


@dataclass
class Network:
    """Embedding -> convolution of 5 characters -> ReLU -> max and mean over places -> logit."""

    filters: int = 24
    depth: int = 8
    reach: int = 5
    seed: int = 7
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        r = np.random.default_rng(self.seed)
        self.weights = {"e": r.normal(0, 0.3, (98, self.depth)), "c": r.normal(0, 0.15, (self.reach * (self.depth + 1), self.filters)),
                        "b": np.zeros(self.filters), "o": r.normal(0, 0.1, 2 * self.filters), "z": np.zeros(1)}

    def _columns(self, codes: np.ndarray) -> np.ndarray:
        x = np.zeros((len(codes), WIDTH, self.depth + 1))
        x[:, :, :-1] = self.weights["e"][codes]
        x[:, BEFORE:BEFORE + INSIDE, -1] = codes[:, BEFORE:BEFORE + INSIDE] != PAD  # marks the candidate
        w = np.lib.stride_tricks.sliding_window_view(x, self.reach, axis=1)
        return np.swapaxes(w, 2, 3).reshape(len(codes), WIDTH - self.reach + 1, -1)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(codes), 256):
            h = np.maximum(self._columns(codes[at:at + 256]) @ self.weights["c"] + self.weights["b"], 0)
            out.append(np.concatenate([h.max(1), h.mean(1)], 1) @ self.weights["o"] + self.weights["z"][0])
        return np.concatenate(out)

    def fit(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.004) -> None:
        """Adam on the mean cross-entropy."""
        w, r, step = self.weights, np.random.default_rng(self.seed), 0
        m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        places = WIDTH - self.reach + 1
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for at in range(0, len(order), batch):
                pick = order[at:at + batch]
                x, n = self._columns(codes[pick]), len(pick)
                h = np.maximum(x @ w["c"] + w["b"], 0)
                top = h.argmax(1)
                pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
                error = (1 / (1 + np.exp(-(pooled @ w["o"] + w["z"][0]))) - labels[pick]) / n
                dp = error[:, None] * w["o"]
                dh = np.repeat(dp[:, None, self.filters:] / places, places, 1)
                np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :self.filters], 1)
                dh *= h > 0
                dx = (dh @ w["c"].T).reshape(n, places, self.reach, self.depth + 1)
                de = np.zeros_like(w["e"])
                for k in range(self.reach):
                    np.add.at(de, codes[pick][:, k:k + places], dx[:, :, k, :-1])
                grad = {"e": de, "c": np.tensordot(x, dh, ((0, 1), (0, 1))), "b": dh.sum((0, 1)), "o": pooled.T @ error, "z": np.array([error.sum()])}
                step += 1
                for k, g in grad.items():
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    w[k] -= rate * m[k] / (1 - 0.9 ** step) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)


def platt(logits: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """a, b of the calibrated probability 1 / (1 + exp(-(a x + b))), by Newton steps with smoothed targets; `counts` says how often each row stands."""
    n = np.ones_like(logits) if counts is None else counts
    pos, neg = (n * labels).sum(), (n * (1 - labels)).sum()
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, ab = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * (p - t)) + 1e-3 * (ab - [1, 0]))
        ab = ab - np.clip(step, -2, 2)
    return float(ab[0]), float(ab[1])


# ------------------------------------------------------------------ labelled findings
def _drawn(r: np.random.Generator, n: int) -> list[tuple[str, str, str, int]]:
    """n drawn findings (kind, text before, candidate, label): public key formats, and look-alikes."""
    pick = lambda chars, k: "".join(r.choice(list(chars), k))
    word = lambda: pick(string.ascii_lowercase, int(r.integers(3, 9)))
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    good = (
        lambda: ("key", "", "ghp_" + pick(alnum, 36)), lambda: ("key", "", "sk_live_" + pick(alnum, 24)),
        lambda: ("key", "", "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24)), lambda: ("key", "", "AIza" + pick(alnum + "-_", 35)),
        lambda: ("key", "", "eyJ" + pick(alnum, 17) + ".eyJ" + pick(alnum, 30) + "." + pick(alnum + "-_", 43)),
        lambda: ("key", "", pick(b64, int(r.integers(24, 44))) + "=" * int(r.integers(0, 3))), lambda: ("key", "key: ", pick(alnum, int(r.integers(20, 48)))),
        lambda: ("key", "", pick(alnum, int(r.integers(24, 48)))), lambda: ("key", "", pick("0123456789ABCDEF", int(r.choice([32, 40, 64])))),
        lambda: ("assigned", "pwd = ", pick(alnum + "!#%&*", int(r.integers(8, 20)))), lambda: ("assigned", "bearer ", pick(alnum + "-_.", int(r.integers(20, 60)))),
        lambda: ("assigned", "private_key: ", pick(b64, int(r.integers(24, 60)))), lambda: ("assigned", "passphrase: ", pick(alnum, int(r.integers(10, 24)))),
    )
    bad = (
        lambda: ("key", "@", f"mail{r.integers(99)}.{word()}.com"), lambda: ("key", "", f"www.{word()}{r.integers(99)}.example.org/{word()}"),
        lambda: ("key", "", f"{word()}/{word()}/{word()}_{r.integers(999)}.{word()[:3]}"), lambda: ("key", "", f"{word()}-{r.integers(9)}.{r.integers(20)}.{r.integers(9)}-{word()}"),
        lambda: ("key", "", f"20{r.integers(10, 30)}-0{r.integers(1, 9)}-1{r.integers(9)}T1{r.integers(9)}"), lambda: ("key", "", f"{word()}{word()}{word()}{r.integers(99)}"),
        lambda: ("key", "", f"{word()}_{word()}_{word()}_{r.integers(9)}"), lambda: ("key", "", pick("ab1", 1) * int(r.integers(16, 30)) + "1a"),
        lambda: ("key", "", f"{word()}.{r.integers(999)}.{word()}.{word()}"), lambda: ("key", "", f"{word()}-{word()}-{word()}-{r.integers(2030)}-{word()}"),
        lambda: ("assigned", "bearer ", word() + word()), lambda: ("assigned", "credentials ", word() + word()),
        lambda: ("assigned", "pwd = ", "<" + "x" * 8), lambda: ("assigned", "authorization ", word() + word() + "."),
    )
    out = []
    for i in range(n):
        group, label = (good, 1) if i % 2 == 0 else (bad, 0)
        out.append((*group[int(r.integers(len(group)))](), label))
    return out


@dataclass
class Detector:
    network: Network
    scale: tuple[float, float]
    thresholds: dict[str, float]

    def probabilities(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """Calibrated probability of each (before, candidate, after): the highest of its windows."""
        if not found:
            return np.zeros(0)
        rows = [encoded(*f) for f in found]
        p = 1 / (1 + np.exp(-np.clip(self.scale[0] * self.network.logits(np.concatenate(rows)) + self.scale[1], -30, 30)))
        return np.maximum.reduceat(p, np.cumsum([0, *map(len, rows)])[:-1])


def _with_drawn(sample: list[tuple[str, str, str, str, int]], drawn: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """The labelled findings with `drawn` drawn ones in contexts of the sample (without one, in blanks), and which of them are left out of training."""
    r = np.random.default_rng(seed)
    contexts = [(b, a) for _, b, _, a, _ in sample] or [("", "")]
    found = list(sample)
    for kind, before, inside, label in _drawn(r, drawn):
        b, a = contexts[int(r.integers(len(contexts)))]
        found.append((kind, (b.rsplit(" ", 1)[0] + " " + before)[-BEFORE:], inside, (" " + a.split(" ", 1)[-1])[:AFTER], label))
    return found, r.permutation(len(found)) % 5 == 0


def train(sample: list[tuple[str, str, str, str, int]], drawn: int = 2000, recall: float = 0.97, seed: int = 7) -> Detector:
    """Detector from labelled findings (kind, before, candidate, after, label) of documents and `drawn` drawn ones.

    Drawn findings stand in contexts of the sample (without one, in blanks). Every fifth finding is left out of
    training; on those the logits are calibrated and each kind gets the highest threshold of that recall.
    """
    found, held = _with_drawn(sample, drawn, seed)
    rows = [encoded(*f[1:4])[0] for f in found]
    codes, labels = np.stack(rows), np.array([f[4] for f in found], float)
    net = Network(seed=seed)
    net.fit(codes[~held], labels[~held])
    scale = platt(net.logits(codes[held]), labels[held])
    out = Detector(net, scale, {})
    p = out.probabilities([f[1:4] for f, h in zip(found, held, strict=True) if h])
    kinds = np.array([f[0] for f, h in zip(found, held, strict=True) if h])
    for kind in ("assigned", "key"):
        good = np.sort(p[(kinds == kind) & (labels[held] == 1)])
        out.thresholds[kind] = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
    return out


#: Findings of a part, rounds in which the parts' networks are averaged, and passes over a part in each.
PART_FINDINGS, ROUNDS, PASSES = 2000, 3, 2
#: Steps of a logit in which the findings left out of training are counted.
STEP = 1 / 64


def train_parts(findings: DataFrame, parts: int, drawn: int = 2000, recall: float = 0.97, seed: int = 7) -> Detector:
    """As `train`, from all rows of `findings` in `parts` parts, each with its own drawn ones.

    In each round every part goes on from the mean network of the round before, and the new networks are averaged by their
    findings; the parts of the mean and the counts of logits are added up by Spark, so the driver gets only those.
    """
    spark, part = findings.sparkSession, F.pmod(F.col("h"), F.lit(parts)).cast("int").alias("part")
    dealt = findings.select(part, "kind", "before", "inside", "after", "label").repartition(parts, "part").groupBy("part")  # small as bytes, but each part is seconds of work
    names = sorted(Network(seed=seed).weights)

    def rows_of(group: pd.DataFrame) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        group = group.sort_values(["kind", "before", "inside", "after", "label"])
        sample = list(group[["kind", "before", "inside", "after", "label"]].itertuples(index=False, name=None))
        found, held = _with_drawn(sample, drawn, seed + int(group["part"].iloc[0]))
        return found, held, np.stack([encoded(*f[1:4])[0] for f in found]), np.array([f[4] for f in found], float)

    def pass_from(shared, k: int):
        def go_on(group: pd.DataFrame) -> pd.DataFrame:
            _, held, codes, labels = rows_of(group)
            own = Network(seed=seed + k)
            own.weights = {n: w.copy() for n, w in shared.value.items()}
            own.fit(codes[~held], labels[~held], epochs=PASSES)
            flat = np.concatenate([own.weights[n].ravel() for n in names])
            return pd.DataFrame({"place": np.arange(len(flat)), "total": flat * (~held).sum(), "n": (~held).sum()})
        return go_on

    net = Network(seed=seed)
    for k in range(ROUNDS):
        go_on = pass_from(spark.sparkContext.broadcast(net.weights), k)  # some thousand numbers
        mean = dealt.applyInPandas(go_on, "place int, total double, n long").groupBy("place").agg((F.sum("total") / F.sum("n")).alias("w")).collect()
        flat = np.zeros(len(mean))
        flat[[x.place for x in mean]] = [x.w for x in mean]
        sizes = np.cumsum([net.weights[n].size for n in names])[:-1]
        net.weights = {n: x.reshape(net.weights[n].shape) for n, x in zip(names, np.split(flat, sizes), strict=True)}
    shared = spark.sparkContext.broadcast(net.weights)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        found, held, codes, labels = rows_of(group)
        own = Network(seed=seed)
        own.weights = shared.value
        first = own.logits(codes[held])
        windows = [encoded(*f[1:4]) for f, h in zip(found, held, strict=True) if h]
        best = np.maximum.reduceat(own.logits(np.concatenate(windows)), np.cumsum([0, *map(len, windows)])[:-1])
        step = lambda x: np.floor(np.clip(x, -60, 60) / STEP).astype(int)
        kinds = [f[0] for f, h in zip(found, held, strict=True) if h]
        return pd.DataFrame({"kind": kinds, "label": labels[held].astype(int), "first": step(first), "best": step(best)})

    judged = written(dealt.applyInPandas(judge, "kind string, label int, first int, best int"), "judged-findings")
    at = judged.groupBy("first", "label").count().collect()
    scale = platt(np.array([(x["first"] + 0.5) * STEP for x in at]), np.array([x.label for x in at], float), np.array([x["count"] for x in at], float))
    out = Detector(net, scale, {})
    good = judged.filter("label = 1").groupBy("kind", "best").count().orderBy("best").collect()
    for kind in ("assigned", "key"):
        rows = [x for x in good if x.kind == kind]
        below = np.cumsum([x["count"] for x in rows])
        if len(rows):
            lowest = rows[int(np.searchsorted(below, int((1 - recall) * below[-1]), "right"))]["best"] * STEP
            out.thresholds[kind] = float(1 / (1 + np.exp(-np.clip(scale[0] * lowest + scale[1], -30, 30))))
        else:
            out.thresholds[kind] = 0.5
    release(judged)
    return out


def _context(text: str, start: int, end: int) -> tuple[str, str, str]:
    return text[max(0, start - BEFORE):start], text[start:end], text[end:end + AFTER]


def labelled_findings(documents: DataFrame) -> DataFrame:
    """(kind, before, inside, after, label, h): the distinct findings with labels of all documents, and a hash of each."""
    docs = documents.filter("doc_id is not null").select(F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in pieces(batches):
            rows = []
            for text in filter(None, b["text"].to_pylist()):
                base = base_spans(text)
                for kind, s, e in base:
                    if kind == "assign":  # the network sees the value, with the word before it
                        s += ASSIGN.match(text[s:e]).start(2)
                    rows.append(("key", *_context(text, s, e), 1))
                rows += [(k, *_context(text, s, e), 0) for k, s, e in candidates(text) if not any(s < z and a < e for _, a, z in base)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int32() if i == 4 else pa.string()) for i in range(5)],
                                             names=["kind", "before", "inside", "after", "label"])

    found = docs.mapInArrow(run, "kind string, before string, inside string, after string, label int").distinct()
    return found.withColumn("h", F.xxhash64(*found.columns))


def detector(documents: DataFrame) -> Detector:
    """Detector trained on the findings of all `documents`; without any, on drawn findings alone."""
    found = written(labelled_findings(documents), "findings")
    parts = -(-found.count() // PART_FINDINGS)
    if parts <= 1:  # as many as a part holds
        cols = ["kind", "before", "inside", "after", "label"]
        out = train([tuple(x) for x in found.orderBy("h", *cols).select(*cols).collect()])
    else:
        out = train_parts(found, parts)
    release(found)
    return out


def find_secrets(documents: DataFrame, model: Detector | None = None) -> DataFrame:
    """(doc_id, spans), one row per row of `documents`: array of (kind, start, end, probability), in code points, end exclusive.

    Kinds `assign`, `access` and `hex` are the base patterns (probability 1); `assigned` and `key` are candidates that
    the network takes and that overlap no base span. Whole texts are read; a null text is an empty one, without spans.
    Repeated rows give equal rows; other columns are not read.
    """
    spark, model = documents.sparkSession, model or detector(documents)
    shared = spark.sparkContext.broadcast(model)  # some thousand numbers
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        own = shared.value
        for b in pieces(batches):
            base, more, views, where = [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                base.append(base_spans(text) if text else [])
                more.append([])
                for kind, s, e in candidates(text) if text else ():
                    if not any(s < z and a < e for _, a, z in base[-1]):
                        views.append(_context(text, s, e))
                        where.append((i, kind, s, e))
            for (i, kind, s, e), p in zip(where, own.probabilities(views), strict=True):
                if p >= own.thresholds[kind]:
                    more[i].append((kind, s, e, float(p)))
            spans = [sorted([(*x, 1.0) for x in one] + two, key=lambda x: (x[1], KINDS.index(x[0]))) for one, two in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([[dict(zip(("kind", "start", "end", "probability"), x, strict=True)) for x in s] for s in spans], kind_type)],
                                             names=["doc_id", "spans"])

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,probability:double>>")


def secret_report(documents: DataFrame, model: Detector | None = None) -> DataFrame:
    """Digest of `find_secrets`: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(documents, model).select("doc_id", count("assign"), count("access"), count("hex"),
                                                 F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
