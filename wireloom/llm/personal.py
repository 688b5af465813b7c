"""Personal data in whole documents: fixed patterns, and a skip-chain conditional random field for further forms.

Tokens (words, numbers, marks) within reach of a digit, an at sign or a written-out at or dot form chains; all others
are clear of entities, so chains are independent given the text. Each token has a label: other, email, ip, card or
phone. Node potentials come from hashed features of the token, its neighbours and the number or address it is part of;
chain potentials link neighbours; skip potentials link distant tokens of the same document that are repeated (equal)
or similar (numbers with the same last four digits), so that a number that is clearly a phone number in one place
counts as one in the others. Marginals come from loopy message passing over both kinds of edges.

It is trained here, on the gradient of the likelihood with the marginals of the same message passing: labelled by the
fixed patterns in a bounded sample of documents, and on drawn findings and look-alikes put into texts of that sample.
Numbers of the sample that might be personal data without matching a pattern are neither taught as such nor as others.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import pieces

# The base patterns. A run of digits is taken from its first one, which changes no match.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
#: Kinds of what the random field adds.
MORE = tuple(f"crf_{k}" for k in KINDS)


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    back = [int(d) for d in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _address(text: str) -> bool:
    """Whether the four parts are 255 at most."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind as listed, then by start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # from the sign on both sides, so that a long run without one is not read again from each of its places
        left = text[last:at]
        start = at - (len(left) - len(left.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    out += [("ip", *m.span()) for m in IP.finditer(text) if _address(m[0])]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(m[0]) - m[0].count(" ") - m[0].count("-") <= 19 and luhn(_digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# ------------------------------------------------------------------ tokens and features
LABELS = ("other", *KINDS)
TOKEN = re.compile(r"[A-Za-zÀ-ɏ]+|[0-9]+|[^\sA-Za-z0-9À-ɏ]")
ANCHOR = re.compile(r"[0-9@]+|[\[({<]\x20?(?:at|dot)\x20?[\])}>]|\x20dot\x20", re.I)
REACH = 48
SIZE = 1 << 13
_SEPARATORS = frozenset("+-.()/: ")


def windows(text: str) -> list[tuple[int, int]]:
    """Pieces of the text within reach of an anchor, ends moved out to white space or by as much again."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        s, e = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    for w in out:
        a, b = text.rfind(" ", max(0, w[0] - REACH), w[0]), text.find(" ", w[1], w[1] + REACH)
        w[0], w[1] = a if a >= 0 else max(0, w[0] - REACH), b if b >= 0 else min(len(text), w[1] + REACH)
    merged: list[list[int]] = []
    for w in out:
        if merged and w[0] <= merged[-1][1]:
            merged[-1][1] = max(w[1], merged[-1][1])
        else:
            merged.append(w)
    return [(a, b) for a, b in merged]


def _hashed(*parts: object) -> int:
    return zlib.crc32("\x00".join(map(str, parts)).encode()) % (SIZE - 1) + 1


def _number_groups(text: str, tokens: list[tuple[int, int]]) -> dict[int, tuple[str, ...]]:
    """Features of the number that a token is part of: digits with single separators between them."""
    out, i = {}, 0
    n = len(tokens)
    while i < n:
        s, e = tokens[i]
        if not (text[s] in "+(" or "0" <= text[s] <= "9"):
            i += 1
            continue
        j, last, digits = i, -1, 0
        while j < n:
            a, b = tokens[j]
            if j > i and a - tokens[j - 1][1] > 1 or not ("0" <= text[a] <= "9" or text[a] in _SEPARATORS):
                break
            if "0" <= text[a] <= "9":
                last, digits = j, digits + b - a
            j += 1
        if last < 0:
            i += 1
            continue
        body = text[tokens[i][0]:tokens[last][1]]
        plain = _digits(body)
        shape = re.sub("[0-9]+", lambda m: str(min(len(m[0]), 20)), body)[:40]
        dots = body.split(".")
        features = (f"gn{min(digits, 24)}", f"gs{shape}", f"gf{body[0] if body[0] in '+(' else '9'}{min(body.count('-'), 5)}{min(body.count('.'), 5)}{min(body.count(' '), 5)}{body.count('(')}{min(body.count(':'), 3)}{min(body.count('/'), 3)}",
                    f"gl{13 <= digits <= 19 and luhn(plain)}{12 < digits < 20}", f"gi{len(dots) == 4 and all(0 < len(p.strip()) < 4 for p in dots)}", f"gd{plain[:2]}{digits}")
        for k in range(i, last + 1):
            out[k] = features
        i = last + 1
    return out


FEATURES = 24


def features(text: str, tokens: list[tuple[int, int]]) -> Iterator[list[int]]:
    """FEATURES feature numbers of each token of one chain; 0 stands for none."""
    words = [text[s:e].lower() for s, e in tokens]
    kind = ["9" if "0" <= w[0] <= "9" else "a" if w[0].isalpha() else w[0] for w in words]
    glued = [i > 0 and tokens[i][0] == tokens[i - 1][1] for i in range(len(tokens))]
    groups, before = _number_groups(text, tokens), ["", ""]
    marks = [i for i, w in enumerate(words) if w == "@" or w == "at" and 0 < i < len(words) - 1]
    signs, at, seen, led = {}, 0, None, ("", "")
    for i, w in enumerate(words):
        while at < len(marks) and marks[at] < i - 8:
            at += 1
        near = [m for m in marks[at:at + 4] if abs(m - i) <= 8]
        if near:
            m = min(near, key=lambda x: abs(x - i))
            bracket = m > 0 and words[m - 1] in "[({<"
            dot = next((k for k in range(m + 1, min(m + 7, len(words))) if words[k] == "." and glued[k] and k + 1 < len(words) and glued[k + 1] or words[k] == "dot"), 0)
            signs[i] = (f"m{words[m]}{bracket}{bool(dot)}{max(-8, min(8, i - m))}", f"md{bool(dot)}{bracket}{(i > m) - (i < m)}{kind[i]}{i <= dot + 1 if dot else ''}")
    for i, w in enumerate(words):
        group = groups.get(i)
        if group is None or group is not seen:
            led = tuple(before)
        seen = group
        k = kind[i]
        out = [_hashed("b", k), _hashed("l", k, min(len(w), 20)), _hashed("p", kind[i - 1] if i else "^", k, glued[i]), _hashed("n", kind[i + 1] if i + 1 < len(words) else "$", k),
               _hashed("pp", kind[max(0, i - 2):i], k), _hashed("nn", kind[i + 1:i + 3], k)]
        if k == "a":
            out.append(_hashed("w", w[:12]))
        elif k == "9":
            out.append(_hashed("v", len(w) <= 3 and int(w) <= 255, len(w)))
        if group:
            out += [_hashed(g) for g in group]
            out += [_hashed("t1", led[-1]), _hashed("t2", led[-2]), _hashed("tn", led[-1], group[0]), _hashed("ps", text[max(0, tokens[i][0] - 1):tokens[i][0]], group[0])]
        if i in signs:
            out += [_hashed(x, k) for x in signs[i]]
        if k == "a":
            before = [before[-1], w]
        yield out + [0] * (FEATURES - len(out))


@dataclass
class Graph:
    """Tokens of many documents: chains one after the other, and skip edges between tokens of the same document."""

    spans: list[tuple[int, int, int]]   # document, start, end
    nodes: np.ndarray                   # feature numbers
    linked: np.ndarray                  # whether the next token is the next of the same chain
    skips: np.ndarray                   # (first, second, 0 equal or 1 similar)


def graph(texts: list[str]) -> Graph:
    """Each token of a kind is linked to the one before it, so a token that stands n times has n - 1 skip edges."""
    spans, rows, linked, skips = [], [np.zeros((0, FEATURES), np.uint16)], [], []
    for d, text in enumerate(texts):
        last: dict[str, int] = {}
        for s, e in windows(text):
            tokens = [m.span() for m in TOKEN.finditer(text, s, e)]
            if not tokens:
                continue
            for at in range(0, len(tokens), 20_000):  # long chains are read in steps; a step looks some tokens beyond its ends
                lo, hi = max(0, at - 64), min(len(tokens), at + 20_064)
                got = np.array(list(features(text, tokens[lo:hi])), np.uint16)
                rows.append(got[at - lo:at - lo + min(20_000, len(tokens) - at)])
            for a, b in tokens:
                i, w = len(spans), text[a:b].lower()
                spans.append((d, a, b))
                linked.append(True)
                if "0" <= w[0] <= "9" and len(w) > 2 or w[0].isalpha() and len(w) > 3:
                    if w in last:
                        skips.append((last[w], i, 0))
                    last[w] = i
                    if w[0] <= "9" and len(w) > 3:
                        tail = "~" + w[-4:]
                        if tail in last and not (skips and skips[-1][:2] == (last[tail], i)):
                            skips.append((last[tail], i, 1))
                        last[tail] = i
            linked[-1] = False
    return Graph(spans, np.concatenate(rows), np.array(linked, bool), np.array(skips, np.int64).reshape(-1, 3))


# ------------------------------------------------------------------ random field
def _summed(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@dataclass
class Field:
    """Weights: of features by label, of labels of neighbours, and of equal labels at the two ends of a skip edge."""

    nodes: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @staticmethod
    def empty() -> Field:
        n = len(LABELS)
        return Field(np.zeros((SIZE, n)), np.eye(n) * 0.5, np.full((2, n), 0.3))

    def potentials(self, g: Graph) -> np.ndarray:
        out = [np.zeros((0, len(LABELS)))]
        for at in range(0, len(g.nodes), 10_000):
            out.append(self.nodes[g.nodes[at:at + 10_000]].sum(1))
        return np.concatenate(out)

    def messages(self, local: np.ndarray, linked: np.ndarray, skips: np.ndarray, rounds: int = 12, damping: float = 0.5):
        """Sum-product messages: of each token to the next, to the one before, and along skip edges both ways.

        All are sent at once in every round. On chains alone the marginals are exact after as many rounds as a chain
        has tokens; skip messages are damped, as they close loops.
        """
        n, m = len(local), len(skips)
        ahead, behind = np.zeros((n, len(LABELS))), np.zeros((n, len(LABELS)))
        there, back = np.zeros((m, len(LABELS))), np.zeros((m, len(LABELS)))
        u, v, same = skips[:, 0], skips[:, 1], self.skip[skips[:, 2]]
        on = np.flatnonzero(linked)

        def along(x):  # message over a skip edge: only equal labels gain
            total = _summed(x, 1)[:, None]
            return np.logaddexp(total, x + np.log(np.expm1(np.maximum(same, 1e-6))))

        for _ in range(rounds):
            belief = self.beliefs(local, ahead, behind, there, back, skips)
            new_ahead, new_behind = np.zeros_like(ahead), np.zeros_like(behind)
            # ahead[i]: message of i - 1 to i; behind[i]: message of i + 1 to i
            new_ahead[on + 1] = _summed((belief[on] - behind[on])[:, :, None] + self.chain, 1)
            new_behind[on] = _summed((belief[on + 1] - ahead[on + 1])[:, None, :] + self.chain, 2)
            ahead, behind = new_ahead - new_ahead.mean(1, keepdims=True), new_behind - new_behind.mean(1, keepdims=True)
            if m:
                x, y = along(belief[u] - back), along(belief[v] - there)
                there = damping * there + (1 - damping) * (x - x.mean(1, keepdims=True))
                back = damping * back + (1 - damping) * (y - y.mean(1, keepdims=True))
        return ahead, behind, there, back

    @staticmethod
    def beliefs(local, ahead, behind, there, back, skips) -> np.ndarray:
        out = local + ahead + behind
        np.add.at(out, skips[:, 1], there)
        np.add.at(out, skips[:, 0], back)
        return out

    def marginals(self, g: Graph, rounds: int = 12) -> np.ndarray:
        local = self.potentials(g)
        b = self.beliefs(local, *self.messages(local, g.linked, g.skips, rounds), g.skips)
        return np.exp(b - _summed(b, 1)[:, None])

    def fit(self, g: Graph, labels: np.ndarray, steps: int = 70, rate: float = 0.12, penalty: float = 2e-4) -> None:
        """Adam on the likelihood of the tokens whose label is known (0 or more); -1 stands for an open label."""
        known = labels >= 0
        truth = np.zeros((len(labels), len(LABELS)))
        truth[np.flatnonzero(known), labels[known]] = 1
        on = np.flatnonzero(g.linked)
        on = on[known[on] & known[on + 1]]
        edges = g.skips[known[g.skips[:, 0]] & known[g.skips[:, 1]]] if len(g.skips) else g.skips
        weights, scale = [self.nodes, self.chain, self.skip], 1 / max(1, known.sum())
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        used = g.nodes[known]
        for step in range(1, steps + 1):
            local = self.potentials(g)
            ahead, behind, there, back = self.messages(local, g.linked, g.skips, rounds=6)
            b = self.beliefs(local, ahead, behind, there, back, g.skips)
            p = np.exp(b - _summed(b, 1)[:, None])
            error = (truth - p)[known]
            nodes = np.stack([np.bincount(used.ravel(), np.repeat(error[:, c], FEATURES), SIZE) for c in range(len(LABELS))], 1)
            nodes[0] = 0
            both = (b[on] - behind[on])[:, :, None] + self.chain + (b[on + 1] - ahead[on + 1])[:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            chain = truth[on].T @ truth[on + 1] - (both / both.sum((1, 2), keepdims=True)).sum(0)
            skip = np.zeros_like(self.skip)
            for kind in (0, 1):
                e = edges[edges[:, 2] == kind]
                at = np.flatnonzero(np.isin(np.arange(len(g.skips)), np.flatnonzero((g.skips[:, 2] == kind) & known[g.skips[:, 0]] & known[g.skips[:, 1]]))) if len(g.skips) else []
                if len(e):
                    x, y = b[e[:, 0]] - back[at], b[e[:, 1]] - there[at]
                    joint = x[:, :, None] + y[:, None, :] + np.diag(self.skip[kind])
                    joint = np.exp(joint - joint.max((1, 2), keepdims=True))
                    joint /= joint.sum((1, 2), keepdims=True)
                    skip[kind] = (truth[e[:, 0]] * truth[e[:, 1]]).sum(0) - np.einsum("nii->i", joint)
            for w, grad, m, v in zip(weights, (nodes, chain, skip), first, second, strict=True):
                grad = grad * scale - penalty * w
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                w += rate * m / (1 - 0.9 ** step) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
            np.maximum(self.skip, 0, out=self.skip)  # equal labels never cost


# ------------------------------------------------------------------ findings
_SIGN = re.compile(r"@|\bat\b", re.I)


def _whole(kind: str, body: str) -> bool:
    """Least form of a finding."""
    digits = _digits(body)
    if kind == "email":
        sign = _SIGN.search(body)
        return bool(sign and sign.start() > 0 and re.search(r"[A-Za-z0-9]\s?(?:\.|\bdot\b|[\[({<]\s?dot\s?[\])}>])\s?[A-Za-z]", body[sign.end():], re.I))
    if kind == "ip":
        return len(re.findall("[0-9]+", body)) >= 4 and (body.count(".") == 3 or body.count(":") >= 2) or body.count(":") >= 3
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def found(texts: list[str], field: Field, threshold: float = 0.6) -> list[list[tuple[str, int, int, float]]]:
    """(kind, start, end, probability) of each text: runs of tokens of one label whose mean marginal is high enough."""
    g = graph(texts)
    p = field.marginals(g)
    label = p.argmax(1) if len(p) else np.zeros(0, int)
    out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    hot = np.flatnonzero(label > 0).tolist()
    i = 0
    while i < len(hot):
        j = i
        while j + 1 < len(hot) and hot[j + 1] == hot[j] + 1 and g.linked[hot[j]] and label[hot[j + 1]] == label[hot[i]] and g.spans[hot[j + 1]][1] - g.spans[hot[j]][2] <= 1:
            j += 1
        a, b, kind = hot[i], hot[j], KINDS[label[hot[i]] - 1]
        d, text = g.spans[a][0], texts[g.spans[a][0]]
        while a < b and not (text[g.spans[a][1]].isalnum() or text[g.spans[a][1]] == "+" or kind == "phone" and text[g.spans[a][1]] == "("):
            a += 1
        while b > a and not text[g.spans[b][1]].isalnum():
            b -= 1
        sure, s, e = float(p[a:b + 1, label[hot[i]]].mean()), g.spans[a][1], g.spans[b][2]
        if kind == "email" and (sign := _SIGN.search(text, s, e)):  # words in front of the name are not part of it
            s += text[s:sign.start()].rstrip(" [({<").rfind(" ") + 1
        if sure >= threshold and _whole(kind, text[s:e]):
            out[d].append((f"crf_{kind}", s, e, sure))
        i = j + 1
    return out


# ------------------------------------------------------------------ labelled findings
def _drawn(r: np.random.Generator) -> tuple[str, list[tuple[str, str]]]:
    """One drawn text and its findings (kind, string): forms beyond the base patterns, and look-alikes without any."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))
    word = lambda: "".join(r.choice(list("abcdefghijklmnoprstuvwxyz"), int(r.integers(3, 9))))
    part = lambda: str(r.integers(1, 256))

    def card(n):
        body = pick("4", "5", "37", "6") + num(n)
        body = body[:n - 1]
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))

    area, mid, tail, host = str(r.integers(200, 990)), str(r.integers(200, 990)), num(4), f"{word()}{pick('', '.example', str(r.integers(9)))}"
    n15, n16, p4 = card(15), card(16), [part() for _ in range(4)]
    lead = pick("", "tel ", "phone: ", "call ", "mobile ", "fax ", "contact ", "reach me on ")
    phones = [f"({area}) {mid}-{tail}", f"{area}-{mid}-{tail}", f"{area}.{mid}.{tail}", f"{area} {mid} {tail}", f"0049 {area[:2]} {mid}{tail}", f"00{pick('1', '33', '34')} {area} {mid} {tail}", f"0{area} {mid}{tail}"]
    i = int(r.integers(16))
    if i < 4:
        p = pick(*phones)
        if r.random() < 0.5:
            return f"{word()} {lead}{p} {word()}", [("phone", p)]
        again = pick(f"{mid}-{tail}", f"{area}{mid}{tail}", f"{area} {mid} {tail}", f"{mid} {tail}")
        return f"{word()} {pick('tel ', 'phone: ', 'call ')}{p} {' '.join(word() for _ in range(12))}. {word()} {again} {word()}", [("phone", p), ("phone", again)]
    if i == 4:
        p = f"{pick('tel ', 'phone: ', 'call ', 'mobile ')}"
        b = pick(area + mid + tail, mid + tail, f"{mid} {tail}", f"{mid}-{tail}")
        return f"{word()} {p}{b} {word()}", [("phone", b)]
    if i < 8:
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("[at]", "[dot]"), ("(at)", "."), (" [at] ", "."), (" (AT) ", "."), (" @ ", "."))
        m = f"{word()}{pick('', '.' + word(), num(2))}{at}{host.replace('.', dot)}{dot}{pick('com', 'org', 'net', 'de', 'fr', 'es')}"
        return f"{word()} {pick('', 'mail ', 'write to ', 'e-mail: ')}{m} {word()}", [("email", m)]
    if i == 8:
        c = pick(f"{n15[:4]} {n15[4:10]} {n15[10:]}", n15, f"{n15[:4]}-{n15[4:10]}-{n15[10:]}", f"{n16[:4]}.{n16[4:8]}.{n16[8:12]}.{n16[12:]}", f"{n16[:4]}/{n16[4:8]}/{n16[8:12]}/{n16[12:]}")
        return f"{word()} {pick('', 'card ', 'visa ', 'amex: ', 'credit card ')}{c} {word()}", [("card", c)]
    if i == 9:
        a = pick(" . ".join(p4), ":".join(f"{r.integers(1, 65536):x}" for _ in range(8)), f"fe80::{r.integers(1, 65536):x}:{r.integers(1, 65536):x}:{r.integers(1, 65536):x}")
        return f"{word()} {pick('', 'host ', 'from ', 'ip ')}{a} {word()}", [("ip", a)]
    year, order = r.integers(1900, 2030), num(int(r.integers(6, 13)))
    plain = pick(f"{year}-0{r.integers(1, 9)}-1{r.integers(9)}", f"v{r.integers(9)}.{r.integers(20)}.{r.integers(30)}", f"version {r.integers(9)}.{r.integers(9)}.", f"1{r.integers(9)}:{r.integers(10, 60)}:{r.integers(10, 60)}",
                 f"${r.integers(1, 999)},{num(3)}.50", f"{year}-{year + 7}", f"ISBN 978-{r.integers(9)}-{num(2)}-{num(6)}-{r.integers(9)}", f"order {order}", f"no. {order} and {order}", f"{r.integers(99)}.{r.integers(99)} %",
                 f"section {r.integers(9)}.{r.integers(9)}.{r.integers(9)}", f"@{word()}", f"at {r.integers(1, 12)} {word()} dot {word()}", f"met at {word()}. {word()}", f"id {num(16)}", f"{word()} dot {word()}", f"token = \"{r.integers(1 << 60):x}{r.integers(1 << 60):x}\"",
                 f"AKIA{word().upper()}{num(3)}{word().upper()}", f"{r.integers(30)}.{r.integers(13)}.{year}", f"{r.integers(9)}.{r.integers(9)}.", f"x{num(4)} {num(4)}", f"invoice {area}-{mid}-{tail}", f"{num(3)} {num(3)} {num(3)} units", f"1. {word()} 2. {word()}")
    return f"{word()} {plain} {word()}", []


def labelled(text: str, spans: list[tuple[str, int, int]], open_numbers: bool) -> tuple[Graph, np.ndarray]:
    """Graph of one text with its labels. With `open_numbers`, numbers outside the spans that have the digits of a phone
    or card number, and what stands at an at sign, have no known label."""
    g = graph([text])
    labels = np.zeros(len(g.spans), np.int64)
    if open_numbers:
        for m in CARD.finditer(text):
            if 7 <= len(_digits(m[0])) <= 19:
                labels[[i for i, (_, s, e) in enumerate(g.spans) if s < m.end() and m.start() < e]] = -1
        for i, (_, s, e) in enumerate(g.spans):
            if "@" in text[max(0, s - 24):e + 24]:
                labels[i] = -1
    for kind, s, e in spans:
        for i, (_, a, b) in enumerate(g.spans):
            if a < e and s < b:
                labels[i] = LABELS.index(kind)
    return g, labels


def joined(parts: list[tuple[Graph, np.ndarray]]) -> tuple[Graph, np.ndarray]:
    spans, skips, at = [], [], 0
    for d, (g, _) in enumerate(parts):
        spans += [(d, s, e) for _, s, e in g.spans]
        skips.append(g.skips + [at, at, 0] if len(g.skips) else g.skips)
        at += len(g.spans)
    return Graph(spans, np.concatenate([g.nodes for g, _ in parts]), np.concatenate([g.linked for g, _ in parts]), np.concatenate(skips)), np.concatenate([y for _, y in parts])


def train(pieces_of_texts: list[str], drawn: int = 1500, seed: int = 7) -> Field:
    """Field fitted on labelled pieces of documents and `drawn` drawn texts; without pieces, on the drawn ones alone."""
    r = np.random.default_rng(seed)
    parts = [labelled(t, base_spans(t), True) for t in pieces_of_texts]
    for _ in range(drawn):
        text, spans = _drawn(r)
        if pieces_of_texts and r.random() < 0.5:  # the words around it come from the corpus
            context = re.sub(r"\S*[0-9@]\S*", "", pieces_of_texts[int(r.integers(len(pieces_of_texts)))])[:60]
            text = f"{context.strip()} {text}"
        at, where = 0, []
        for kind, s in spans:
            at = text.index(s, at)
            where.append((kind, at, at + len(s)))
            at += len(s)
        parts.append(labelled(text, where, False))
    field = Field.empty()
    field.fit(*joined(parts))
    return field


def sampled_pieces(documents: DataFrame, sample_documents: int, sample_pieces: int) -> list[str]:
    """At most `sample_pieces` windows around anchors from at most `sample_documents` documents, both by a hash."""
    h = F.xxhash64(F.col("doc_id").cast("string"))
    ids = [x[0] for x in documents.filter("doc_id is not null").select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").limit(sample_documents).select("doc_id").collect()]

    def run(batches):
        for b in pieces(batches):
            rows = [t[s:e][:2000] for t in filter(None, b["text"].to_pylist()) for s, e in windows(t)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["piece"])

    cut = documents.filter(F.col("doc_id").isin(ids)).select(F.col("text").cast("string").alias("text")).mapInArrow(run, "piece string").distinct()
    return [x[0] for x in cut.withColumn("h", F.xxhash64("piece")).orderBy("h", "piece").limit(sample_pieces).select("piece").collect()]


def model(documents: DataFrame, sample_documents: int = 3000, sample_pieces: int = 800) -> Field:
    """Field trained on a bounded sample of `documents`: at most `sample_pieces` pieces of `sample_documents` documents."""
    return train(sampled_pieces(documents, sample_documents, sample_pieces))


def find_personal(documents: DataFrame, field: Field | None = None, threshold: float = 0.6) -> DataFrame:
    """(doc_id, spans), one row per row of `documents`: array of (kind, start, end, probability), in code points, end exclusive.

    Kinds `email`, `ip`, `card` and `phone` are the base patterns (probability 1); `crf_...` are runs that the random
    field finds and that overlap no base span. Whole texts are read; null and empty texts have no spans. Repeated rows
    give equal rows; other columns are not read.
    """
    spark, field = documents.sparkSession, field or model(documents)
    shared = spark.sparkContext.broadcast(field)  # a fixed number of weights
    order = {k: i for i, k in enumerate((*KINDS, *MORE))}
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches):
        own = shared.value
        for b in pieces(batches, 128):
            texts = [t or "" for t in b["text"].to_pylist()]
            rows = []
            for base, more in zip(map(base_spans, texts), found(texts, own, threshold), strict=True):
                taken = sorted(x[1:] for x in base)
                clear = [m for m in more if not any(s < m[2] and m[1] < e for s, e in taken)] if len(taken) < 50 or not more else _clear(more, taken)
                rows.append(sorted([(*x, 1.0) for x in base] + clear, key=lambda x: (order[x[0]], x[1])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([[dict(zip(("kind", "start", "end", "probability"), x, strict=True)) for x in s] for s in rows], kind_type)],
                                             names=["doc_id", "spans"])

    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,probability:double>>")


def _clear(more: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Findings that overlap none of the spans `taken`, in one pass over both."""
    far, top = [], 0
    for _, e in taken:
        top = max(top, e)
        far.append(top)
    starts, out = [s for s, _ in taken], []
    for m in more:
        i = int(np.searchsorted(starts, m[2]))
        if i == 0 or far[i - 1] <= m[1]:
            out.append(m)
    return out


def personal_report(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Digest of `find_personal`: doc_id, n_email, n_ip, n_card, n_phone of the base, base_sha256, spans."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find_personal(documents, field).select("doc_id", *[count(k) for k in KINDS],
                                                  F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*KINDS))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
