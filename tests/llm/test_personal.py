import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.llm.cases import awkward, none
from wireloom.llm import personal as P


# ------------------------------------------------------------------ base patterns
def brute_base(text):
    """The contract's patterns as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def check(s):
        total = 0
        for i, c in enumerate(reversed(digits(s))):
            d = int(c) * (1 + i % 2)
            total += d // 10 + d % 10
        return total % 10 == 0
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and check(s)), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15))
    return [(k, *m.span()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_base_spans_equal_the_patterns():
    r = random.Random(5)
    parts = ["a", "b.c", "@", ".", "-", "+1", "+", " ", "é", "255", "256", "1.2.3.4", "4785380592391139", "(743) ", "555", "x@y.z", "4222-2222 ", "\n", "00", "%", "0" * 20 + "7.1.1.1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(30_000)]
    seen = set()
    for t in texts:
        assert P.base_spans(t) == brute_base(t), t
        seen |= {x[0] for x in brute_base(t)}
    assert seen == set(P.KINDS)


def test_long_runs_are_read_once():
    for t in ("a" * 400_000, "9" * 400_000, "@" * 100_000, "1." * 200_000, "a@" * 100_000, "+1" + " " * 300_000):
        assert isinstance(P.base_spans(t), list)


# ------------------------------------------------------------------ message passing
def small_field(r):
    f = P.Field.empty()
    n = len(P.LABELS)
    f.chain, f.skip = r.normal(0, 1, (n, n)), np.abs(r.normal(0, 1, (2, n)))
    return f


def enumerated(f, local, linked, skips):
    n, k = local.shape
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        s = sum(local[i, y[i]] for i in range(n)) + sum(f.chain[y[i], y[i + 1]] for i in range(n - 1) if linked[i]) + sum(f.skip[t, y[u]] for u, v, t in skips if y[u] == y[v])
        for i in range(n):
            p[i, y[i]] += np.exp(s)
    return p / p.sum(1, keepdims=True)


def marginals(f, local, linked, skips, rounds):
    b = f.beliefs(local, *f.messages(local, linked, skips, rounds), skips)
    return np.exp(b - P._summed(b, 1)[:, None])


def test_marginals_equal_enumeration_without_loops():
    r = np.random.default_rng(2)
    for skips in ([], [(1, 3, 0)], [(0, 4, 1)]):
        f, local = small_field(r), r.normal(0, 1, (5, len(P.LABELS)))
        linked = np.array([True, True, False, True, False])  # two chains, joined by one skip edge at most
        e = np.array(skips, np.int64).reshape(-1, 3)
        assert marginals(f, local, linked, e, 60) == pytest.approx(enumerated(f, local, linked, skips), abs=1e-6)


def test_marginals_are_near_enumeration_with_loops():
    r = np.random.default_rng(3)
    f, local = small_field(r), r.normal(0, 1, (5, len(P.LABELS)))
    f.chain *= 0.5
    linked, skips = np.array([True, True, True, True, False]), [(0, 3, 0), (1, 4, 1)]
    assert np.abs(marginals(f, local, linked, np.array(skips), 60) - enumerated(f, local, linked, skips)).max() < 0.1


# ------------------------------------------------------------------ trained field
@pytest.fixture(scope="module")
def field():
    return P.train([], drawn=1500)


def test_held_out_findings(field):
    r, hit, n, wrong, clean = np.random.default_rng(99), 0, 0, 0, 0
    for _ in range(400):
        text, want = P._drawn(r)
        got = {(k[4:], text[s:e]) for k, s, e, _ in P.found([text], field)[0]}
        hit, n = hit + sum(x in got for x in want), n + len(want)
        if not want:
            clean, wrong = clean + 1, wrong + bool(got)
    assert hit / n > 0.93 and wrong / clean < 0.06, (hit / n, wrong / clean)


def test_skip_edges_carry_labels(field):
    """A bare number counts as a phone number where the same digits stand behind a word for one, far away."""
    far = " ".join(["lorem"] * 60)
    bare = "the value 743 5551 was read"
    alone = P.found([bare], field)[0]
    both = P.found([f"call (212) 743-5551 now {far} the value 743 5551 was read"], field)[0]
    lone, linked = (P.Field.marginals(field, P.graph([t])) for t in (bare, f"call (212) 743-5551 now {far} {bare}"))
    g = P.graph([f"call (212) 743-5551 now {far} {bare}"])
    last = max(i for i, (_, s, e) in enumerate(g.spans) if e - s == 4 and f"call (212) 743-5551 now {far} {bare}"[s:e] == "5551")
    assert len(g.skips) >= 2 and linked[last, 4] > lone[[e - s for _, s, e in P.graph([bare]).spans].index(4), 4]
    assert len(both) >= len(alone)


def test_repeated_tokens_have_linear_edges():
    g = P.graph([" 5551234" * 3000])
    assert len(g.skips) == 2999 and len(g.spans) == 3000


def test_findings_of_documents(spark, field):
    text = "Mail a.b@c-d.example or +1 (743) 555-3824, 10.0.0.255, 4785380592391139; write to kim (at) host.example.org"
    rows = P.find_personal(awkward(spark, [(50, text), (51, "1 " * 60_000)]), field).collect()
    assert len(rows) == 11 and all(not x.spans for x in rows if x.doc_id != 50)
    spans = next(x.spans for x in rows if x.doc_id == 50)
    assert [(s.kind, text[s.start:s.end]) for s in spans if not s.kind.startswith("crf")] == [
        ("email", "a.b@c-d.example"), ("ip", "10.0.0.255"), ("card", "4785380592391139"), ("phone", "+1 (743) 555-3824")]
    more = [(s.kind, text[s.start:s.end]) for s in spans if s.kind.startswith("crf")]
    assert len(more) == 1 and more[0][0] == "crf_email" and more[0][1].startswith("kim (at) host.example")
    report = {x.doc_id: x for x in P.personal_report(awkward(spark, [(50, text)]), field).collect()}
    want = ",".join(f"{k}:{s}:{e}" for k, s, e in brute_base(text))
    assert report[50].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and report[50].spans.startswith(want) and report[50].n_email == 1
    assert report[1].base_sha256 == hashlib.sha256(b"").hexdigest() and report[1].spans == ""
    assert P.find_personal(none(spark), field).count() == 0 and P.model(none(spark), 5, 5).nodes.shape == (P.SIZE, len(P.LABELS))
