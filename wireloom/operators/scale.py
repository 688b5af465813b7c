"""Helpers that keep hot groups out of single tasks and cut the lineage of iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


# ------------------------------------------------------------------ written tables
def shared_dir(spark: SparkSession) -> str:
    """Folder the cluster names for checkpoints; in local mode, where none is set, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jdir.get() if jdir.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-wireloom-")
        spark.sparkContext.setCheckpointDir(root)  # found again by the next call
    return root.rstrip("/")


#: Spark takes the size of a scan from its files. Columns of ids pack to one or two bytes a row and a hash table of them takes
#: over a hundred, so tables of millions of rows would pass for small and be broadcast through the driver.
_FACTOR = "spark.sql.sources.fileCompressionFactor"
UNPACKED = 50.0


def expect_packed_files(spark: SparkSession) -> None:
    """Let Spark plan with what rows take in memory; a factor that the session sets itself stays."""
    if float(spark.conf.get(_FACTOR)) == 1.0:
        spark.conf.set(_FACTOR, str(UNPACKED))


#: Removes the shuffle files of an execution when it ends; what is written is read from the files from then on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(_CLEANUP, before)


class Store:
    """A growing table in the shared folder; every part is written once and then read back.

    Parts are Parquet folders, so a lost executor re-reads files instead of replaying earlier rounds.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/wireloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
        self.parts: list[str] = []
        self.written = 0
        self.schema = None

    def append(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.written:05d}"
        self.written += 1
        _write(df, path)
        self.schema = self.schema or df.schema
        self.parts.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts)

    def forget(self, keep_last: int = 1) -> None:
        """Delete parts that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        last = len(self.parts) - keep_last
        for path in self.parts[:last]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.parts = self.parts[last:]


def materialise(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write `df` to the shared folder and continue from the files."""
    store = Store(df.sparkSession, tag)
    out = store.append(df)
    out._written = store  # for `release`
    return out


def release(*frames: DataFrame) -> None:
    """Delete the files of tables that `materialise` wrote. Only for those that no plan that is still to run reads."""
    for df in frames:
        df._written.forget(keep_last=0)


# ------------------------------------------------------------------ loops over frames
#: Rows of a front that are still sent to every task; a larger one is shuffled.
SMALL_FRONT = 100_000


def front_side(front: DataFrame, rows: int) -> DataFrame:
    """The written front of a round as the side of a join: a small one spares the shuffle of the table it meets."""
    return F.broadcast(front) if rows <= SMALL_FRONT else front


def closure(seeds: DataFrame, expand: Callable[[DataFrame], DataFrame], keys: Sequence[str],
            tag: str = "closure", max_rounds: int | None = None) -> DataFrame:
    """All key rows reachable from `seeds`; `round` is the step in which a row was first met."""
    keys = list(keys)
    store = Store(seeds.sparkSession, tag)
    frontier = store.append(seeds.select(*keys).distinct().withColumn("round", F.lit(0)))
    step = 0
    while (rows := frontier.count()) and (max_rounds is None or step < max_rounds):
        step += 1
        fresh = (expand(front_side(frontier.drop("round"), rows)).select(*keys).distinct()
                 .join(store.all().drop("round"), keys, "left_anti"))
        frontier = store.append(fresh.withColumn("round", F.lit(step)))
    return store.all()


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], tag: str = "stable",
                 max_rounds: int = 10_000) -> DataFrame:
    """Repeat `step` until the set of rows stops changing (row count and hash sum are equal)."""
    store = Store(state.sparkSession, tag)
    current = store.append(state)
    mark = _fingerprint(current)
    for _ in range(max_rounds):
        current = store.append(step(current))
        store.forget(keep_last=1)
        new = _fingerprint(current)
        if new == mark:
            return current
        mark = new
    raise ValueError(f"no fixed point after {max_rounds} rounds")


def _fingerprint(df: DataFrame) -> tuple:
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"),
                 F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s")).first()
    return tuple(row)


# ------------------------------------------------------------------ ranking
def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank") -> DataFrame:
    """First `k` rows per group. Each task cuts its rows to `k` per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def uniform(seed: int, *keys) -> Column:
    """Number in [0, 1) from the seeded hash of the keys: the same whatever the partitioning."""
    h = F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed))
    return h.bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """`row_number` per group where one group may hold most of the rows.

    Rows are range partitioned on (group, order); each slice is numbered by itself and shifted by the
    sizes of the slices before it. `order` must be total within a group.
    """
    group = list(group)
    sliced = materialise(
        df.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_slice", F.spark_partition_id()),
        "numbered")
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    return (sliced.withColumn("_row", F.row_number().over(local))
            .join(offsets, [*group, "_slice"])
            .withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
            .drop("_slice", "_before", "_row"))


def running_total(df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[Column],
                  totals: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per group. `slice_col` cuts a group into consecutive pieces in `order`."""
    group, names = list(group), list(totals)
    df = df.withColumns({f"_v_{n}": v for n, v in totals.items()})
    sizes = df.groupBy(*group, slice_col).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in names])
    before = Window.partitionBy(*group).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, slice_col, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in names])
    local = Window.partitionBy(*group, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(local) for n in names}).join(offsets, [*group, slice_col])
    return (rows.withColumns({n: F.col(f"_b_{n}") + F.col(f"_r_{n}") for n in names})
            .drop(*[f"_{k}_{n}" for k in "vrb" for n in names]))


def sample_list(df: DataFrame, group: Sequence[str], value: str, k: int, name: str,
                order: Sequence[Column] | None = None) -> DataFrame:
    """Sorted array of the first `k` distinct values per group; never gathers more than `k` values."""
    rows = df.select(*group, value).filter(F.col(value).isNotNull()).distinct()
    kept = top_k(rows, group, order or [F.col(value)], k, "_k")
    return kept.groupBy(*group).agg(F.array_sort(F.collect_list(value)).alias(name))


def carry_forward(df: DataFrame, group: Sequence[str], slice_col: Column, order: Sequence[Column],
                  value: Column, name: str, backward: bool = False, strict: bool = False) -> DataFrame:
    """Last non-null `value` at or before each row (after it with `backward`), null before the first one.

    `strict` leaves out the row itself.

    A group is cut into slices along `order`; the last value of each slice is carried over the slices
    first, so no task sees a whole group.
    """
    group, keys = list(group), list(order)
    df = df.withColumn("_sl", slice_col).withColumn("_v", value)
    if backward:
        order = [o.desc() for o in order]
    first_key = F.desc("_sl") if backward else F.asc("_sl")
    w = Window.partitionBy(*group, "_sl").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    rows = df.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    at = F.when(F.col("_v").isNotNull(), keys[0] if len(keys) == 1 else F.struct(*keys))
    ends = df.groupBy(*group, "_sl").agg((F.min_by if backward else F.max_by)("_v", at).alias("_end"))  # combined map side
    over = Window.partitionBy(*group).orderBy(first_key).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, "_sl", F.last("_end", ignorenulls=True).over(over).alias("_before"))
    return (rows.join(carried, [*group, "_sl"]).withColumn(name, F.coalesce("_in", "_before"))
            .drop("_sl", "_v", "_in", "_before"))
