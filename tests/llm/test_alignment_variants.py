import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import awkward, none
from wireloom.llm import alignment as A
from wireloom.llm import variants as V


# ------------------------------------------------------------------ alignment
@pytest.fixture(scope="module")
def own():
    return A.Pair(*A.default_vocabularies())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(A.default_vocabularies()[0])
    t.encode_special_tokens = True
    return t


def texts(n, seed):
    r = random.Random(seed)
    pool = [*map(chr, range(32, 127)), "\n", "\t", "é", "ß", "▁", "　", "中", "😀", "́", "ﬁ", "\r", "\x00", "<|endoftext|>", "<s>", "<0x41>", " the", " of", "ing", "'s", "12", "  "]
    return ["".join(r.choice(pool) for _ in range(r.randint(0, 20))) for _ in range(n)]


def walked(own, library, text):
    """Both token lists walked side by side: None without tokens, else (a, b, groups, links)."""
    if not text:
        return None
    a, b, data = library.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text), (" " + text).encode()
    x, y = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if b"".join(x) != data or b"".join(y) != data:
        return None
    links, groups, ga, gb, i, j, ends = [], [], [a[0]], [b[0]], 0, 0, [len(x[0]), len(y[0])]
    while True:
        links.append((a[i], b[j]))
        move = ends[0] <= ends[1], ends[1] <= ends[0]
        if all(move):
            groups.append((ga, gb))
            ga, gb = [], []
        if i + move[0] == len(a) and j + move[1] == len(b):
            return a, b, groups, links
        if move[0]:
            i += 1
            ends[0] += len(x[i])
            ga.append(a[i])
        if move[1]:
            j += 1
            ends[1] += len(y[j])
            gb.append(b[j])


def test_tokens_equal_the_library(own, library):
    for t in texts(3000, 1):
        want = walked(own, library, t)
        got = own.tokens(t)
        assert (got is None) == (want is None), t
        if got:
            groups, n, pairs = A.linked(own, *got)
            assert got[0].tolist() == want[0] and groups == ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in want[2])
            assert n == len(want[2]) and pairs.tolist() == [a * A.SHIFT + b for a, b in want[3]]


def test_postings_round_trip():
    r = np.random.default_rng(1)
    for size, n in ((1, 1), (64, 3), (64, 60), (4096, 2), (4096, 3000), (10, 10)):
        places, counts = np.sort(r.choice(size, n, replace=False)), r.integers(1, 9, n)
        for c in (counts, np.ones(n, np.int64)):
            posting = A.pack(places, c, size)
            got = A.unpack(posting, size)
            assert got[0].tolist() == places.tolist() and got[1].tolist() == c.tolist()
            assert A.popcount(posting) == n and A.link_count(posting) == c.sum()


def test_alignment_equals_brute_force(spark, own, library):
    more = [(100 + i, t) for i, t in enumerate([*texts(150, 2), *["the cat of the the house"] * 40, "naïve 　 text"])]
    docs = awkward(spark, more)
    rows = [(i, t) for i, t in ((x.doc_id, x.text) for x in docs.collect())]
    done = {t: walked(own, library, t) for _, t in rows if t is None or len(t) < 10_000}
    long = next(t for _, t in rows if t and len(t) >= 10_000)
    done[long] = walked(own, library, long)
    count, links, top = Counter(), Counter(), Counter()
    for _, t in rows:
        if done[t]:
            count.update(set(done[t][3]))
            links.update(done[t][3])
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    want = Counter()
    for i, t in rows:
        w = done[t]
        want[(i, *((0,) * 6 if w is None else (len(w[0]), len(w[1]), len(w[2]), len(w[3]), sum(count[x] == top[x[0]] for x in w[3]), sum(count[x] for x in w[3]))),
              "" if w is None else hashlib.sha256(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in w[2]).encode()).hexdigest())] += 1
    assert Counter(map(tuple, A.alignment_report(docs).collect())) == want
    index = A.written(A.postings(docs.repartition(3), block_docs=16), "small-blocks")  # many blocks give the same counts
    counts = A.pair_counts(index)
    got = {(x.a, x.b): (x.documents, x.links, x.best) for x in counts.collect()}
    assert got == {p: (n, links[p], n == top[p[0]]) for p, n in count.items()}
    scored = A.score_documents(index, counts)
    assert Counter((x.doc_id, x.n_links, x.n_best, x.count_sum) for x in scored.collect()) == Counter((k[0], k[4], k[5], k[6]) for k in want.elements())
    assert A.alignment_report(none(spark)).count() == 0


# ------------------------------------------------------------------ variants
def edits(w):
    return {w[:i] + w[i + 1:] for i in range(len(w))}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and s in edits(t)


def brute(rows, least=6, count=5, every=199, times=5):
    import re
    found = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            found[w] += 1
    words = {w: n for w, n in found.items() if len(w) >= least and n >= count}
    by = {w: [v for v in words if v != w and near(v, w)] for w in words}
    form = {}
    for w, vs in by.items():
        top = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= times * words[w] else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(by[w]), words[form[w]] if form[w] else None))
    return out


def test_runs_equal_the_pattern():
    import re
    r = random.Random(1)
    pool = [*"abzAZ09_-' \n", "À", "ÿ", "×", "Ā", "中", "¿", "é", "\xa0"]
    for _ in range(5000):
        t = "".join(r.choice(pool) for _ in range(r.randint(0, 12)))
        want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", t)]
        assert [w.decode() for w in V.letter_runs(t.encode())] == want, t


def test_variants_equal_brute_force(spark):
    r = random.Random(3)
    roots = ["".join(r.choice("abcé") for _ in range(r.randint(5, 9))) for _ in range(40)]

    def spoilt(w):
        i = r.randrange(len(w))
        return r.choice([w[:i] + w[i + 1:], w[:i] + r.choice("abcéÿ") + w[i:], w[:i] + r.choice("abcéÿ") + w[i + 1:], w])
    vocabulary = roots + [spoilt(r.choice(roots)) for _ in range(120)]
    vocabulary += [spoilt(w) for w in vocabulary[-60:]]
    docs = [(200 + i, " ".join(r.choice(vocabulary[:1 + r.randrange(len(vocabulary))]) for _ in range(60)).replace("a", "A", 2)) for i in range(150)]
    table = awkward(spark, [*docs, (5, "aaaaaa " * 7 + "AAAAAAA " * 40 + "aaaaaaaa " * 300 + ("b" * 5000 + " ") * 6 + ("b" * 5001 + " ") * 30)])
    rows = [(x.doc_id, x.text) for x in table.select("doc_id", "text").collect()]
    got = [tuple(x) for x in V.variant_groups(table).collect()]
    want = brute(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] and x[1] != x[2] for x in want)
    assert V.variant_groups(none(spark)).count() == 0


def test_signatures_of_near_words_meet():
    r = random.Random(4)
    for parts, k in ((7, 2), (5, 2), (4, 1)):
        own = V.Signatures(parts, k)
        for _ in range(2000):
            w = "".join(r.choice("abcdeé") for _ in range(r.randint(6, 12)))
            i = r.randrange(len(w))
            v = w[:i] + r.choice("abcdez") + w[i + 1:] if k == 2 else w[:i] + w[i + 1:]
            if v != w:
                assert set(own.of(w, 0)) & set(own.of(v, 0))


def test_long_ways_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i:03d}", f"w{i + 1:03d}") for i in range(100)], "word string, form string")
    assert {x.root for x in V.followed(forms).collect()} == {"w100"} and V.followed(forms.limit(0)).count() == 0


def test_signatures_and_words_are_never_broadcast(spark, tmp_path):
    """A packed file of few bytes holds many words, and each gets 21 signatures: Spark must not send them through the driver."""
    spark.createDataFrame([(f"abcdef{i:04d}", i) for i in range(300)], "word string, n long").write.parquet(f"{tmp_path}/words")
    words = spark.read.parquet(f"{tmp_path}/words")
    for table in (V.near_pairs(words), V.variant_groups(spark.createDataFrame([(1, "letter letter letter letter letter")], "doc_id long, text string"))):
        assert "Broadcast" not in table._jdf.queryExecution().executedPlan().toString()
