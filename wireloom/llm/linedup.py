"""Line deduplication: a segment-partition edit join over the distinct lines of all documents, in DataFrame operations.

Lines within `edits` edits of each other are cut into edits + 1 segments; one segment of the shorter line stands
unchanged in the longer one, near its own place (pigeonhole). Every distinct line indexes its segments by length,
number and text, and probes the index of each length from its own down to `edits` less with the substrings that may
match there: for segment i at p and a line longer by d the starts from p + max(1 - i, d - edits - 1 + i) to
p + min(i - 1, d + edits + 1 - i). Keys that very many lines share are refined by
further segments. Matching lines whose letter counts differ too much drop out in the join; the rest are cut down to what differs between their common beginning and end, and verified there by bit-parallel edit distance in
a band of 2 * edits + 1 diagonals.

Copies of a line are one row before the join, so a line that many documents share costs one row there. Linked lines
form classes (connected components); of a class one line stays, at its first place in one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wireloom.llm.common import written
from wireloom.operators.graph import components
from wireloom.operators.scale import release

#: Letters whose counts make up the signature of a line, a byte each.
COUNTED = "etanisro"


# ------------------------------------------------------------------ segments
def _place(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 1) of a line: the last ones take the remainder."""
    parts = edits + 1
    base, rest = F.floor(length / parts).cast("int"), length % parts
    short = F.lit(parts) - rest  # segments of the base length come first
    start = F.lit(1) + base * (i - 1) + F.greatest(F.lit(0), F.lit(i - 1) - short)
    return start, base + (F.lit(i) > short).cast("int")


def _keys(text: Column, length: Column, edits: int, before: Column, own: Column, longer: Column | None) -> Column:
    """Array of (key, d, own, at, width): substrings that may match a segment of a text shorter by d.

    `before` is the key of what matched already; `own` says whether the text may stand in the index, which its own
    segments then do; `longer` is d where it is known.
    """
    out = []
    for d in range(edits + 1):
        for i in range(1, edits + 2):
            start, width = _place(length - d, i, edits)
            for shift in range(max(1 - i, d - edits - 1 + i), min(i - 1, d + edits + 1 - i) + 1):
                at = start + shift
                key = F.xxhash64(before, F.lit(i), length - d, F.substring(text, at, width))
                fits = (length >= d) & (at >= 1) & (at + width - 1 <= length) & (F.lit(True) if longer is None else longer == d)
                out.append(F.when(fits, F.struct(key.alias("key"), F.lit(d).alias("d"), (own & F.lit(d == 0 and shift == 0)).alias("own"), at.alias("at"), width.alias("width"))))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def _signature(line: Column) -> Column:
    total = None
    for i, c in enumerate(COUNTED):
        n = F.shiftleft((F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long").bitwiseAND(F.lit(255)), 8 * i)
        total = n if total is None else total.bitwiseOR(n)
    return total


def _apart(a: Column, b: Column) -> Column:
    """Sum of the differences of the counts, around the byte: at most twice the edits."""
    total = None
    for i in range(len(COUNTED)):
        d = F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255)))
        d = F.least(d, F.lit(256) - d)
        total = d if total is None else total + d
    return total


# ------------------------------------------------------------------ verification
def _common(a: Column, b: Column, edits: int) -> Column:
    """Length of the common beginning less edits + 1 (0 at least), found by halving."""
    longest = F.least(F.length(a), F.length(b))
    steps = F.transform(F.reverse(F.sequence(F.lit(0), F.ceil(F.log2(longest + F.lit(1.0))).cast("int"))), lambda k: F.call_function("shiftleft", F.lit(1), k))
    found = F.aggregate(steps, F.lit(0), lambda n, k: F.when((n + k <= longest) & (F.substring(a, n + 1, k) == F.substring(b, n + 1, k)), n + k).otherwise(n))
    return F.greatest(F.lit(0), found - (edits + 1))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of a and b, longer by `edits` at most (code points), where it is at most `edits`, else something above.

    Bit k of a vector stands for row j - edits + k of column j, that is for one of the 2 * edits + 1 diagonals around
    the main one. Down to the last row of `a` the distance is read along the lowest diagonal, then along that row.
    """
    if not 1 <= edits <= 30:
        raise ValueError("edits must be between 1 and 30: the band has to fit a word")
    width, m = 2 * edits + 1, F.length(a)
    ones = F.lit((1 << width) - 1).cast("long")
    def invert(x):
        return F.bitwise_not(x).bitwiseAND(ones)
    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(edits).alias("n"), F.split(a, "").alias("a"))

    def column(s, jc):
        j, c = jc["j"], jc["c"]
        eq = F.lit(0).cast("long")
        for k in range(width):
            row = j - edits + k
            eq = eq.bitwiseOR(F.when((row >= 1) & (row <= m) & (F.get(s["a"], row - 1) == c), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
        d0 = (((eq.bitwiseAND(s["vp"]) + s["vp"]).bitwiseAND(ones).bitwiseXOR(s["vp"])).bitwiseOR(eq).bitwiseOR(s["vn"]))
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["n"].alias("n"), s["a"].alias("a"), d0.alias("d0"), j.alias("j"))

    def advance(s):
        hp, hn = s["vn"].bitwiseOR(invert(s["d0"].bitwiseOR(s["vp"]))), s["d0"].bitwiseAND(s["vp"])
        half = F.shiftrightunsigned(s["d0"], 1)
        diagonal = s["j"] + edits <= m
        bit = F.lit(2 * edits) - (s["j"] + edits - m)  # of the last row in this column
        at = lambda v: F.call_function("shiftrightunsigned", v, bit.cast("int")).bitwiseAND(F.lit(1)).cast("int")
        n = s["n"] + F.when(diagonal, F.lit(1) - F.shiftrightunsigned(s["d0"], 2 * edits).bitwiseAND(F.lit(1)).cast("int")).otherwise(at(hp) - at(hn))
        return F.struct(hn.bitwiseOR(invert(half.bitwiseOR(hp))).alias("vp"), half.bitwiseAND(hp).alias("vn"), n.alias("n"), s["a"].alias("a"))

    columns = F.transform(F.split(b, ""), lambda c, i: F.struct((i + 1).alias("j"), c.alias("c")))
    return F.aggregate(columns, start, lambda s, jc: F.transform(F.array(column(s, jc)), advance)[0], lambda s: s["n"])


def _differing(pairs: DataFrame, edits: int) -> DataFrame:
    """(a, b, la, lb) with the common beginning and end of la and lb cut off. Each step is written, so that the next one
    reads columns: inside a lambda function an expression would be evaluated for every element."""
    for turned in (False, True):
        side = F.reverse if turned else (lambda c: c)
        cut = pairs.withColumn("_n", _common(side("la"), side("lb"), edits) if turned else _common(F.col("la"), F.col("lb"), edits))
        keep = (lambda c: F.substring(c, F.lit(1), F.length(c) - F.col("_n"))) if turned else (lambda c: F.substring(c, F.col("_n") + 1, F.length(c)))
        before, pairs = pairs, written(cut.select("a", "b", keep("la").alias("la"), keep("lb").alias("lb")), "differing")
        if turned:
            release(before)
    return pairs


# ------------------------------------------------------------------ join
#: A key that more index entries than this share is refined instead of joined.
HOT = 64
DEPTH = 8


def _candidates(lines: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of line ids that share a key and hardly differ in their letter counts.

    Lines with a common half (of copies that differ elsewhere, or of a form with other numbers) would all meet under
    its key. Such a key is refined: the segment is cut out of the lines that have it, what is left is within `edits`
    edits again, so it is cut into segments once more and the key of one of those is added; and so on.
    """
    spread = lambda text, length, before, own, longer: F.explode(_keys(F.col(text), F.col(length), edits, before, own, longer)).alias("k")
    columns = ("lid", "sig", "k.key", "k.d", "k.own", "k.at", "k.width")
    keys = written(lines.select("lid", "sig", spread("line", "len", F.lit(0).cast("long"), F.lit(True), None)).select(*columns), "keys")
    found = []
    for level in range(DEPTH):
        index = keys.filter("own").select("key", F.col("lid").alias("a"), F.col("sig").alias("sa"))
        hot = written(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select("key"), "hot-keys")
        more = level < DEPTH - 1 and not hot.isEmpty()
        cold = index.join(hot, "key", "left_anti") if more else index
        probe = keys.select("key", "d", F.col("lid").alias("b"), F.col("sig").alias("sb"))
        close = ((F.col("d") > 0) | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")) & (_apart(F.col("sa"), F.col("sb")) <= 2 * edits)
        new = written(cold.join(probe, (cold["key"] == probe["key"]) & close).select("a", "b").distinct(), "candidates")
        found.append(new)
        if not more:
            release(keys, hot)
            break
        rest = keys.join(hot, "key")
        if level == 0:
            rest = rest.join(_few(lines.select("lid", F.col("line").alias("rest")), rest.select("lid").distinct()), "lid")
        cut = F.concat(F.substring("rest", F.lit(1), F.col("at") - 1), F.substring("rest", F.col("at") + F.col("width"), F.length("rest")))
        rest = rest.select("lid", "sig", "d", "own", "key", cut.alias("rest")).withColumn("len", F.length("rest"))
        before, keys = keys, written(rest.select("lid", "sig", "rest", spread("rest", "len", F.col("key"), F.col("own"), F.col("d"))).select("rest", *columns), "keys")
        release(before, hot)
    if len(found) == 1:
        return found[0]
    out = written(reduce(DataFrame.unionByName, found).distinct(), "candidates")
    release(*found)
    return out


def _few(rows: DataFrame, lids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """`rows` whose lid is among `lids`; these go to all tasks if they are few, else both sides are shuffled."""
    lids = written(lids, "lids")
    return rows.join(F.broadcast(lids) if lids.count() <= most else lids, "lid", "left_semi")


def similar_lines(lines: DataFrame, edits: int) -> DataFrame:
    """(a, b): line ids of `lines` (lid, line), distinct lines longer than `edits`, within `edits` edits."""
    lines = lines if "sig" in lines.columns else lines.withColumns({"sig": _signature(F.col("line")), "len": F.length("line")})
    candidates = _candidates(lines, edits)
    texts = written(_few(lines.select("lid", "line"), candidates.select(F.col("a").alias("lid")).union(candidates.select("b")).distinct()), "candidate-lines")
    pairs = (candidates.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("la")), "a")
             .join(texts.select(F.col("lid").alias("b"), F.col("line").alias("lb")), "b"))
    shorter = F.length("la") <= F.length("lb")
    pairs = pairs.select("a", "b", F.when(shorter, F.col("la")).otherwise(F.col("lb")).alias("la"), F.when(shorter, F.col("lb")).otherwise(F.col("la")).alias("lb"))
    differing = _differing(pairs, edits)
    release(candidates, texts)
    links = written(differing.filter(banded_distance(F.col("la"), F.col("lb"), edits) <= edits).select("a", "b"), "links")
    release(differing)
    return links


def _split_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, row, lines): `row` tells apart rows of one id with different texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("row"), F.split(text, "\n").alias("lines"))


def line_rules(documents: DataFrame, edits: int, least_chars: int) -> DataFrame:
    """(h1, h2, keep_doc, links): lines that occur more than once or have near ones. `keep_doc` is the document in
    which the line stays, null if another line of its class does; `keeps` says which of the two."""
    each = _split_rows(documents).select("doc_id", F.explode("lines").alias("line")).filter(F.length("line") >= least_chars)
    lines = each.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).withColumns({"lid": F.monotonically_increasing_id(), "sig": _signature(F.col("line")), "len": F.length("line")})
    lines = written(lines, "lines")
    links = similar_lines(lines, edits)
    ends = links.select(F.col("a").alias("lid")).union(links.select("b"))
    degrees = ends.groupBy("lid").agg(F.count(F.lit(1)).alias("links"))
    classes = components(links.select(F.lit(0).alias("circuit_id"), F.col("a").alias("u"), F.col("b").alias("v")), batched=False).select(F.col("vertex").alias("lid"), F.col("component").alias("class"))
    linked = written(_few(lines, degrees.select("lid")).join(degrees, "lid").join(classes, "lid"), "linked")
    keepers = linked.groupBy("class").agg(F.min(F.struct(F.col("first_doc").isNull(), "first_doc", "line", "lid"))["lid"].alias("keeper"))
    named = linked.join(keepers, "class").select("lid", "links", (F.col("lid") == F.col("keeper")).alias("keeps"))
    hashed = lines.select("lid", "first_doc", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))
    out = hashed.join(named, "lid", "left").filter("n > 1 or links > 0")
    keeps = F.coalesce("keeps", F.lit(True))
    rules = written(out.select("h1", "h2", F.when(keeps, F.col("first_doc")).alias("keep_doc"),
                               keeps.alias("keeps"), F.coalesce("links", F.lit(0)).cast("long").alias("links")), "rules")
    release(lines, links, linked)
    return rules


def removals(documents: DataFrame, edits: int = 1, least_chars: int = 16) -> DataFrame:
    """(doc_id, row, gone, links): for each text with repeated or near lines the places of the lines that go, from 0, and the
    number of near links of its distinct lines."""
    rules = line_rules(documents, edits, least_chars)
    at = (_split_rows(documents).distinct().select("doc_id", "row", "lines", F.posexplode("lines").alias("pos", "line")).filter(F.length("line") >= least_chars)
          .select("doc_id", "row", "pos", (F.array_position("lines", F.col("line")) == F.col("pos") + 1).alias("first"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2")))
    hit = at.join(rules, ["h1", "h2"])
    stays = F.col("first") & F.col("keeps") & F.col("doc_id").eqNullSafe(F.col("keep_doc"))
    return hit.groupBy("doc_id", "row").agg(F.collect_list(F.when(~stays, F.col("pos"))).alias("gone"), F.sum(F.when(F.col("first"), F.col("links")).otherwise(0)).alias("links"))


def _joined(documents: DataFrame, edits: int, least_chars: int) -> tuple[DataFrame, Column]:
    """The rows of `documents` with the places of lines that go (`_gone`, `_links`), and the array of lines that stay."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    gone = removals(documents, edits, least_chars).select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("gone").alias("_gone"), F.col("links").alias("_links"))
    both = documents.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_r")), "left")
    lines = F.split(text, "\n")
    return both, F.when(F.size(F.coalesce("_gone", F.array().cast("array<int>"))) == 0, lines).otherwise(F.filter(lines, lambda _, i: ~F.array_contains("_gone", i)))


def dedup_lines(documents: DataFrame, edits: int = 1, least_chars: int = 16) -> DataFrame:
    """(doc_id, n_lines, n_kept, n_links, text), one row per row of `documents`; `text` has the lines that stay.

    Lines (between newlines) of `least_chars` code points or more that are equal or within `edits` edits, directly or through
    others, form a class. Of each class one line stays: that with the least document id (nulls last), then the least
    text, at its first place in that document. Shorter lines all stay. A null text is an empty one, with one empty
    line. Rows with the same id are one document: equal rows are cut alike, and a line that stays does so in each of
    them that has it. n_links counts the near links of a row's distinct lines. Other columns are not read.
    """
    both, kept = _joined(documents.select("doc_id", "text"), edits, least_chars)
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    return both.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.size(kept).cast("long").alias("n_kept"),
                       F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.array_join(kept, "\n").alias("text"))


def rewritten(documents: DataFrame, edits: int = 1, least_chars: int = 16) -> DataFrame:
    """`documents` with the text that `dedup_lines` leaves, and n_chars to match where that column is; null texts stay null."""
    both, kept = _joined(documents, edits, least_chars)
    text = F.when(F.col("text").isNotNull(), F.array_join(kept, "\n"))
    new = {"text": text} | ({"n_chars": F.length(text).cast(documents.schema["n_chars"].dataType)} if "n_chars" in documents.columns else {})
    return both.select(*[new[c].alias(c) if c in new else F.col(c) for c in documents.columns])
