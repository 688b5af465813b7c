"""Dataset tables: cell library, graph dataset, predictions, bills of materials, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wireloom import schema as S
from wireloom.operators.scale import top_k

C = "circuit_id"


def derive_cell_library(pins: DataFrame) -> DataFrame:
    """Union of the pins seen on each cell; `varies` marks cells whose instances use different pin sets.

    A cell varies when one of its pins is missing on some instance, so pin sets are never collected.
    """
    per = pins.select(C, "gate_id", "cell", "pin").distinct()
    pin_n = per.groupBy("cell", "pin").agg(F.count(F.lit(1)).alias("n"))
    inst = pins.select(C, "gate_id", "cell").distinct().groupBy("cell").agg(F.count(F.lit(1)).alias("instances"))
    full = pin_n.join(inst, "cell")
    varies = full.groupBy("cell").agg(F.bool_or(F.col("n") < F.col("instances")).alias("varies"))
    direction = F.when(F.upper("pin").isin(*S.OUTPUT_PINS), "output").otherwise("input")
    return full.join(varies, "cell").select("cell", "pin", direction.alias("direction"), "instances", "varies")


# ------------------------------------------------------------------ graph dataset
def train_edges(edges: DataFrame, roles: DataFrame) -> DataFrame:
    return edges_by_split(edges, roles, "tr")


def edges_by_split(edges: DataFrame, roles: DataFrame, role: str = "tr") -> DataFrame:
    """`tr`: both ends are train gates. `va`: no end is a test gate."""
    keep = roles.filter(F.col("split") == "tr") if role == "tr" else roles.filter(F.col("split") != "te")
    k = keep.select(C, "gate_id")
    return (edges.join(k.withColumnRenamed("gate_id", "src"), [C, "src"], "left_semi")
            .join(k.withColumnRenamed("gate_id", "dst"), [C, "dst"], "left_semi"))


def write_graph(path: str, nodes: DataFrame, edges: DataFrame, roles: DataFrame) -> None:
    """Nodes (features, labels, split), all edges and train edges as Parquet; nodes are laid out by split."""
    nodes.write.mode("overwrite").partitionBy("split").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    train_edges(edges, roles).write.mode("overwrite").parquet(f"{path}/train_edges")


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("nodes", "edges", "train_edges")}


def dataset_profile(nodes: DataFrame) -> DataFrame:
    """Gates per split with the percentage of each class."""
    n = F.count(F.lit(1))
    pct = [(F.count_if(F.col("label") == i) * 100.0 / n).alias(f"pct_{i}") for i in range(len(S.CLASS_NAMES))]
    return nodes.groupBy("split").agg(n.alias("gates"), F.countDistinct(C).alias("circuits"), *pct)


# ------------------------------------------------------------------ predictions
ALL_PREDICTIONS = ("node_id long, cell_name string, circuit_file string, role string, true_class int, pred_class int, "
                   "is_correct boolean")
PROB_COLUMNS = ("prob_0_adder", "prob_1_multiplier", "prob_2_control", "prob_3_subtractor", "prob_4_comparator")
TEST_PREDICTIONS = ("node_id long, cell_name string, circuit_file string, true_class int, pred_class int, is_correct boolean, "
                    + ", ".join(f"{p} double" for p in PROB_COLUMNS))


def read_predictions(spark: SparkSession, all_csv: str, test_csv: str | None = None) -> DataFrame:
    """Predicted classes of all gates with the probabilities of the test gates joined in.

    Gates without probabilities get zeros; without a test file every gate gets a one-hot vector. The gate
    id is the position of the node id inside its circuit.
    """
    from wireloom.operators.scale import numbered
    a = spark.read.csv(all_csv, schema=ALL_PREDICTIONS, header=True)
    if test_csv is None:
        prob = F.array(*[(F.col("pred_class") == i).cast("double") for i in range(len(PROB_COLUMNS))])
        a = a.withColumn("prob", prob)
    else:
        t = spark.read.csv(test_csv, schema=TEST_PREDICTIONS, header=True)
        a = a.join(t.select("circuit_file", "cell_name", *PROB_COLUMNS), ["circuit_file", "cell_name"], "left")
        a = a.withColumn("prob", F.array(*[F.coalesce(p, F.lit(0.0)) for p in PROB_COLUMNS]))
    a = numbered(a.withColumnRenamed("circuit_file", C), [C], [F.col("node_id")], "_n")
    return a.select(C, (F.col("_n") - 1).cast("int").alias("gate_id"), "node_id", F.col("cell_name").alias("inst"),
                    "role", "true_class", "pred_class", "prob")


# ------------------------------------------------------------------ bill of materials file
BOM_COLUMNS = ("cell", "family", "description", "function (naming convention)", "drive (from name)", "count", "share",
               "blocks", "inputs", "outputs", "area_each", "area_total", "leakage_each", "leakage_total", "data_source")


def bom_table(bom: DataFrame) -> DataFrame:
    """The fifteen columns of the bill-of-materials file, keyed by circuit in front."""
    none = F.lit(None).cast("string")
    have = set(bom.columns)
    col = lambda name, alias: (F.col(name) if name in have else none).alias(alias)
    source = F.when(F.col("area_each").isNotNull(), "liberty").otherwise("cell_library.json + naming convention")
    names = ["cell", "family", "description", "function", "drive", "count", "share", "blocks", "inputs", "outputs",
             "area_each", "area_total", "leakage_each", "leakage_total"]
    return bom.select(C, *[col(n, a) for n, a in zip(names, BOM_COLUMNS)], source.alias(BOM_COLUMNS[-1]))


def write_bom_csv(bom: DataFrame, path: str) -> None:
    """One folder of CSV files per circuit."""
    bom_table(bom).write.mode("overwrite").partitionBy(C).csv(path, header=True)


# ------------------------------------------------------------------ fingerprints and retention
def fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    """SHA-256 of the text with uniform line ends, lines stripped on the right and the whole trimmed."""
    t = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t\f\x0B]+$", "")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return df.withColumn("fingerprint", F.sha2(t, 256))


def match_known(new: DataFrame, known: DataFrame) -> DataFrame:
    """Known name of each new text with the same fingerprint; the first name in order wins."""
    first = known.groupBy("fingerprint").agg(F.min("name").alias("known_as"))
    return new.join(first, "fingerprint", "left")


def retain_latest(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    """The newest `n` rows; every task keeps at most `n` before the final merge."""
    return df.orderBy(F.col(order).desc()).limit(n)


# ------------------------------------------------------------------ training logs
def parse_training_log(logs: DataFrame) -> DataFrame:
    """Epoch, losses and validation micro-F1 of log records (log_id, text), wherever their parts stand.

    The text is cut at the words that open a part; a record is a training part, the next validation part behind it and
    the next epoch behind that, as in the order of the log. A part holds `name = value` pairs.
    """
    opens = "(?i)(?=TRAIN \\(Ep avg\\):|VALIDATION:|Epoch\\s*[0-9])"
    part = logs.withColumn("_text", F.monotonically_increasing_id()).select("log_id", "_text", F.posexplode(F.split("text", opens)).alias("pos", "part"))
    kind = F.when(F.upper("part").startswith("TRAIN"), "train").when(F.upper("part").startswith("VALIDATION"), "val").when(F.upper("part").startswith("EPOCH"), "epoch")
    value = lambda name: F.expr(f"try_cast(regexp_extract(part, '(?i){name} *= *([0-9]+[.][0-9]+)', 1) as double)")
    p = part.select("log_id", "_text", "pos", kind.alias("kind"), value("loss").alias("loss"), value("mic").alias("mic"),
                    F.regexp_extract("part", "(?i)^Epoch\\s*([0-9]+)", 1).alias("epoch")).filter("kind is not null")
    w = Window.partitionBy("log_id", "_text").orderBy("pos")
    p = p.withColumns({"k1": F.lag("kind").over(w), "k2": F.lag("kind", 2).over(w), "val_loss": F.lag("loss").over(w), "val_mic": F.lag("mic").over(w), "train_loss": F.lag("loss", 2).over(w)})
    r = p.filter("kind = 'epoch' and k1 = 'val' and k2 = 'train' and train_loss is not null and val_loss is not null and val_mic is not null")
    return r.select("log_id", F.col("epoch").cast("int").alias("epoch"), "train_loss", "val_loss", "val_mic")


def best_epoch(log: DataFrame) -> DataFrame:
    """First epoch with the highest validation score per log."""
    return log.groupBy("log_id").agg(F.max(F.struct("val_mic", (-F.col("epoch")).alias("e"))).alias("b")).select(
        "log_id", (-F.col("b.e")).alias("best_epoch"), F.col("b.val_mic").alias("best_val_mic"))
