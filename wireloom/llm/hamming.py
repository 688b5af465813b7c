"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into m segments of about log2(n) bits, each with an index of its own. Round r looks up, for every
unfinished query and segment, all values that differ in exactly r bits, and verifies the codes found by their full
Hamming distance. After round r every code within m * (r + 1) - 1 bits has been met (if all segments differed in more
than r bits, the codes would differ in m * (r + 1) at least), so a query ends once its k-th distance is no larger.

Equal codes are one index entry with the smallest ids of its rows, so a vector that a third of all rows share costs
one row; queries with equal codes share one search.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wireloom.llm.common import written


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str, bits: int = 64) -> DataFrame:
    """(id, code): bit i is set where component i is 0 or more; missing and null components are 0.

    A null vector has no code and gives no row; components beyond `bits` (64 at most) are not part of the code.
    """
    code = f"aggregate(transform(slice(v, 1, {bits}), (x, i) -> if(x >= 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    return vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("v is not null and id is not null").select("id", F.expr(code).alias("code")).distinct()


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments for n codes."""
    m = max(1, min(bits, round(bits / max(1.0, math.log2(max(2, n))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _segment(code: str, first: int, width: int):
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def search_codes(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """(query_id, rank, id, distance): for each row (id, code) of `queries` the k nearest other ids of `codes`.

    Neighbours are ordered by distance and then id; the query's own id is none of them. Fewer than k other ids give
    fewer rows, an empty table on either side none. Repeated rows count once.
    """
    spark, need = codes.sparkSession, k + 1  # one more: the query's own id is left out at the end
    per_code = Window.partitionBy("code").orderBy("id")
    index = written(codes.distinct().withColumn("n", F.row_number().over(per_code)).filter(F.col("n") <= need)
                    .groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    cuts = segments(bits, index.count())
    m, widest = len(cuts), max(w for _, w in cuts)
    entries = written(index.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n_ids"),
                                   F.explode(F.array(*[F.struct(F.lit(i).alias("seg"), _segment("code", a, w).alias("value")) for i, (a, w) in enumerate(cuts)])).alias("s"))
                      .select("s.seg", "s.value", "code", "least", "n_ids"), "segments")
    asked = written(queries.select(F.col("code").alias("q")).distinct(), "queries")
    open_, found, done = asked, None, None
    best = Window.partitionBy("q").orderBy("distance", "least")
    for r in range(widest + 1):
        masks = [(i, sum(1 << b for b in bs)) for i, (_, w) in enumerate(cuts) if r <= w for bs in combinations(range(w), r)]
        table = spark.createDataFrame([(i, x if x < 1 << 63 else x - (1 << 64)) for i, x in masks], "seg int, mask long")
        value = F.expr("case seg " + " ".join(f"when {i} then shiftrightunsigned(q, {a}) & {(1 << w) - 1 if w < 64 else -1}L" for i, (a, w) in enumerate(cuts)) + " end")
        probes = open_.join(F.broadcast(table)).select("q", "seg", value.bitwiseXOR(F.col("mask")).alias("value"))  # the masks of one radius
        met = (probes.join(entries, ["seg", "value"]).select("q", "code", "least", "n_ids").distinct()
               .withColumn("distance", F.bit_count(F.col("q").bitwiseXOR(F.col("code"))).cast("int")))
        met = met if found is None else met.unionByName(found.join(open_, "q", "left_semi")).distinct()
        found = written(met.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= need).drop("n"), "found")
        covered = m * (r + 1) - 1 if r < widest else bits
        full = (found.filter(F.col("distance") <= covered).groupBy("q").agg(F.sum("n_ids").alias("got"))
                .filter((F.col("got") >= need) | F.lit(r == widest)).select("q"))
        ended = written(found.join(full, "q", "left_semi"), "done")
        done = ended if done is None else done.unionByName(ended)
        open_ = written(open_.join(full, "q", "left_anti"), "open")
        if open_.isEmpty():
            break
    near = done.join(index, "code").select("q", "distance", F.explode("ids").alias("id"))
    pairs = queries.distinct().select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(near, "q").filter("id <> query_id")
    pairs = pairs.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = Window.partitionBy("query_id").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def nearest(vectors: DataFrame, k: int = 10, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", bits: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, distance) for the rows whose id is divisible by `every`, against all rows."""
    codes = written(sign_codes(vectors, id_col, vector_col, bits), "signs")
    return search_codes(codes, codes.filter(F.col("id") % every == 0), k, bits).withColumnRenamed("id", id_col)
