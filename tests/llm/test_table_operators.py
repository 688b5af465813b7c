import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import awkward, none
from wireloom.llm import hamming, linedup, lmscore, neardup, warc
from wireloom.llm.common import words_of


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def classes_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


# ------------------------------------------------------------------ line dedup
def noisy_lines(edits, n=250):
    r, out = random.Random(edits), set()
    for _ in range(n):
        a = [r.choice("abé") for _ in range(r.randint(edits + 1, 22))]
        out.add("".join(a))
        for _ in range(r.randint(1, edits + 2)):
            place, kind = r.randrange(len(a)), r.randrange(3)
            a[place:place + (kind > 0)] = [r.choice("abé")] * (kind < 2)
            if not a:
                break
        if len(a) > edits:
            out.add("".join(a))
    return sorted(out)


@pytest.mark.parametrize("edits", [1, 2])
def test_line_join_equals_brute_force(spark, edits):
    lines = noisy_lines(edits)
    got = {(min(x), max(x)) for x in linedup.similar_lines(spark.createDataFrame(list(enumerate(lines)), "lid long, line string").repartition(3), edits).collect()}
    want = {(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= edits and edit_distance(lines[i], lines[j]) <= edits}
    assert got == {(b, a) for a, b in want}


def test_line_dedup(spark):
    base = "this is a line of some length"
    docs = [(30, f"{base}\nshort\nshort\n{base}"), (31, f"{base}!\nanother line that stays here"), (32, f"{base[:-1]}\nanother line that stays here\n"), (33, "this is a line of one length")]
    rows = {x.doc_id: x for x in linedup.dedup_lines(awkward(spark, docs)).collect()}
    assert rows[30].text == f"{base}\nshort\nshort" and rows[30].n_links == 2
    assert rows[31].text == "another line that stays here" and (rows[32].text, rows[32].n_kept) == ("", 1)
    assert rows[33].text == docs[3][1] and rows[1].text == "" and rows[1].n_lines == 1
    assert rows[3].text == "one two three four five six seven" and rows[None].n_kept == 1
    assert linedup.dedup_lines(none(spark)).count() == 0
    out = linedup.rewritten(awkward(spark, docs))
    assert out.columns == awkward(spark).columns and out.count() == 13
    assert out.filter("doc_id = 31").first().n_chars == len("another line that stays here") and out.filter("doc_id = 1").first().text is None


# ------------------------------------------------------------------ near-duplicates
def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    docs, n = [], 20
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.randint(3, 60))]
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 0, 1, 2])):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append((n, " ".join(copy)))
            n += 1
    table = awkward(spark, docs)
    rows = table.select("doc_id", "text").collect()
    total, common, df = neardup.common_shingles(table.select("doc_id", "text"), 0.05)
    ids = [x.doc_id for x in rows if x.doc_id is not None]
    texts = [words_of((x.text or "").encode()) for x in rows if x.doc_id is not None]
    doc, value, count = neardup.shingles([words_of((x.text or "").encode()) for x in rows])
    freq = Counter(value.tolist())
    assert total == len(rows) and dict(zip(common.tolist(), df.tolist())) == {k: c for k, c in freq.items() if c > 0.05 * len(rows)}
    weight = [{} for _ in ids]
    for d, v, c in zip(*(x.tolist() for x in neardup.shingles(texts))):
        weight[d][v] = c * (math.log1p(total / freq[v]) / math.log1p(1 / 0.05) if freq[v] > 0.05 * total else 1)
    links = []
    for i, a in enumerate(weight):
        for j in range(i):
            both = sum(min(w, weight[j].get(k, 0)) for k, w in a.items())
            if both and both / (sum(a.values()) + sum(weight[j].values()) - both) >= 0.8:
                links.append((ids[i], ids[j]))
    want = classes_of(set(ids), links)
    got = neardup.near_duplicates(table).collect()
    assert len(got) == len(rows)
    assert {x.doc_id: x.class_id for x in got} == want | {None: None}


def test_every_shingle_weighs_by_its_own_frequency(spark):
    """Shingles in 4 of 200 documents weigh less than those of one document: two texts that share them are not similar, though
    they would be if all rare shingles weighed alike."""
    common, rest = [f"c{i}" for i in range(44)], lambda n: [f"r{n}x{i}" for i in range(4)]  # 40 shared shingles, 4 of their own
    docs = [(i, " ".join(common + rest(i))) for i in range(4)] + [(i, " ".join(f"t{i}w{k}" for k in range(9))) for i in range(4, 200)]
    weight = lambda df: math.log1p(200 / df)
    assert 40 / 48 > 0.8 > 40 * weight(4) / (40 * weight(4) + 8 * weight(1))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    classes = lambda share: {x.doc_id: x.class_id for x in neardup.near_duplicates(table, share=share).collect()}
    assert classes(0.0) == {i: i for i in range(200)}
    assert classes(0.05) == {i: 0 if i < 4 else i for i in range(200)}
    assert neardup.one_of_each(table).count() == 200


def test_near_duplicates_of_no_rows(spark):
    assert neardup.near_duplicates(none(spark)).count() == 0


def test_sampling_follows_weighted_similarity():
    keys, r = np.arange(1, 41, dtype=np.uint64) * np.uint64(0x1234567), np.random.default_rng(3)
    a, b = r.random(40) + 0.1, r.random(40) + 0.1
    sampler = neardup.Sampler(4000)
    same = (sampler.draw(np.array([0, 40]), np.r_[keys, keys], np.r_[a, b])[0] == sampler.draw(np.array([0]), keys, b)[0]).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_cells_find_all_links_of_a_bucket(spark):
    """One bucket of a chain of sets, each similar to its neighbours only: no link may be lost."""
    sets = [np.arange(i * 3, i * 3 + 60, dtype="<u4").tobytes() for i in range(60)]
    frame = spark.createDataFrame([(i, bytearray(s), bytearray(b"")) for i, s in enumerate(sets)], "node long, keys binary, weights binary")
    members = spark.createDataFrame([(1, i) for i in range(60)], "bucket long, node long")
    links = {(min(a, b), max(a, b)) for a, b in neardup.near_links(members, frame, 0.8).collect()}
    assert len(set(classes_of(range(60), links).values())) == 1


# ------------------------------------------------------------------ language model
def test_cross_entropy_equals_plain_counts(spark):
    docs = [(20, "a b a b c"), (21, "a b b"), (22, "c c c c"), (23, "a")]
    table, target = awkward(spark, docs), {3, 20, 22}
    rows = table.select("doc_id", "text").collect()
    chains = [(x.doc_id, [w.decode() for w in words_of((x.text or "").encode())]) for x in rows]
    uni, big, voc = (Counter(), Counter()), (Counter(), Counter()), set()
    for i, w in chains:
        if w:
            m = int(i in target)
            voc |= set(w)
            uni[m].update([*w, ""])
            big[m].update(zip(["", *w], [*w, ""]))
    got = lmscore.cross_entropy_difference(table, spark.createDataFrame([(i,) for i in target] + [(None,)], "doc_id long")).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x for x in got}
    for i, w in chains:
        if not w:
            assert by[i].n_tokens == 0 and by[i].score is None
            continue
        loss = [sum(-math.log(0.7 * big[m][p] / max(1, uni[m][p[0]]) + 0.3 * (uni[m][p[1]] + 1) / (sum(uni[m].values()) + len(voc) + 2)) for p in zip(["", *w], [*w, ""])) / (len(w) + 1) for m in (0, 1)]
        assert (by[i].loss_background, by[i].loss_target, by[i].score) == pytest.approx((*loss, loss[1] - loss[0]))
    assert lmscore.cross_entropy_difference(none(spark), spark.createDataFrame([], "doc_id long")).count() == 0


def test_no_word_is_unknown(spark):
    """70,000 words that occur once each, more than ids of 16 bits can name: a text of known words differs from one of new ones."""
    rare = [f"w{i}" for i in range(70_000)]
    table = spark.createDataFrame([(1, " ".join(rare)), (2, " ".join(rare[:40_000])), (3, "zero " * 9 + "w7"), (4, "zero " * 9 + "one")], "doc_id long, text string")
    got = {x.doc_id: x for x in lmscore.cross_entropy_difference(table, spark.createDataFrame([(2,)], "doc_id long")).collect()}
    chains = {x.doc_id: ["", *x.text.split(), ""] for x in table.collect()}
    single, double = ([Counter(), Counter()] for _ in "ab")
    for i, c in chains.items():
        single[i == 2].update(c[1:])
        double[i == 2].update(zip(c, c[1:]))
    n_words = len(set(single[0]) | set(single[1])) - 1
    assert n_words == 70_002
    for i, c in chains.items():
        loss = [sum(-math.log(0.7 * double[m][v, w] / max(1, single[m][v]) + 0.3 * (single[m][w] + 1) / (sum(single[m].values()) + n_words + 2)) for v, w in zip(c, c[1:])) / (len(c) - 1) for m in (0, 1)]
        assert (got[i].loss_background, got[i].loss_target) == pytest.approx(loss)


# ------------------------------------------------------------------ top-k search
def test_search_equals_brute_force(spark):
    r = random.Random(9)
    codes = [(i, r.getrandbits(16) - (1 << 15)) for i in range(300)] + [(i, 77) for i in range(300, 420)] + [(5, 1), (5, 1)]
    table = spark.createDataFrame(codes, "id long, code long")
    got = {}
    for x in hamming.search_codes(table, table.filter("id % 25 = 0"), k=6).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.distance, x.id))
    for q, c in set(codes):
        if q % 25 == 0:
            best = {}
            for i, d in codes:
                if i != q:
                    best[i] = min(best.get(i, 99), bin((c ^ d) & (1 << 64) - 1).count("1"))
            want = sorted((d, i) for i, d in best.items())[:6]
            assert sorted(got[q]) == [(n, d, i) for n, (d, i) in enumerate(want, 1)]


def test_vectors_with_nulls(spark):
    rows = [(0, [1.0, -1.0, None]), (50, [1.0, 1.0]), (51, None), (None, [1.0]), (1, []), (1, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("x")).withColumn("id", F.lit(1))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.distance) for x in hamming.nearest(table).collect())
    assert got == [(0, 1, 1, 1), (0, 2, 50, 1), (50, 1, 0, 1), (50, 2, 1, 2)]
    assert hamming.nearest(table.limit(0)).count() == 0


# ------------------------------------------------------------------ WARC
def test_derivatives(spark):
    html = "<!DOCTYPE html><html lang='fr'><head><title>A\n b</title><script>x='</p>'</script></head><body><p>one&nbsp;two &#233;&#x4e2d;&#99999999;<br>&lt;b&gt; &amp;amp;</p><!-- no --><div>three</div></body></html>"
    pages = spark.createDataFrame([(1, "http://a", html, "x"), (2, None, None, "x"), (None, "u", "", "x"), (1, "http://a", html, "x")], "page_id long, url string, html string, block string")
    source = warc.responses(pages)
    records = warc.derivatives(source)
    rows = records.collect()
    text = [x.block for x in rows if x.page_id == 1 and x.warc_type == "conversion"]
    assert text == ["one two é中&#99999999;\n<b> &amp;\nthree"] * 2
    by = {x.page_id: x for x in source.collect()}
    assert all(x.refers_to == by[x.page_id].record_id and x.source_digest == by[x.page_id].payload_digest and x.content_length == len(x.block.encode()) for x in rows)
    meta = next(x.block for x in rows if x.page_id == 1 and x.warc_type == "metadata")
    assert "title: A b\r\n" in meta and "language: fr\r\n" in meta and by[1].http_header in meta and by[1].block_digest in meta
    back = {(x.page_id, x.headers["WARC-Type"]): x for x in warc.parsed(warc.serialized(records)).collect()}
    for x in rows:
        y = back[x.page_id, x.warc_type]
        assert y.block == x.block and y.headers["WARC-Refers-To"] == x.refers_to and y.headers.get("WARC-Target-URI") == x.target_uri
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0
