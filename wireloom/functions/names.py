"""Column expressions over instance, cell and net names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wireloom import schema as S


def cell_base(cell) -> Column:
    """Function of a cell without its drive suffix: ADDF_X1M_A9TH gives ADDF."""
    return F.regexp_replace(F.col(cell) if isinstance(cell, str) else cell, r"_X\w+$", "")


def cell_family(cell) -> Column:
    """Function of a cell without the number of its inputs: NAND2_X1M gives NAND, ADDF_X1M gives ADDF."""
    return F.regexp_replace(cell_base(cell), r"\d+$", "")


def drive_strength(cell) -> Column:
    """Drive multiple from the name (X0P5 gives 0.5); null when the name has none."""
    c = F.concat(F.col(cell) if isinstance(cell, str) else cell, F.lit("_"))
    whole = F.regexp_extract(c, r"_X(\d+)(?:P(\d+))?[A-Z]*_", 1)
    part = F.regexp_extract(c, r"_X(\d+)(?:P(\d+))?[A-Z]*_", 2)
    text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    return F.when(whole != "", text.cast("double"))


def clean_instance(inst) -> Column:
    return F.trim(F.regexp_replace(inst, r"^\\+", ""))


def hier_prefix(inst) -> Column:
    """Path of an instance up to its last slash; empty at the top."""
    return F.regexp_extract(clean_instance(inst), r"^(.*)/[^/]*$", 1)


def block_of(prefix) -> Column:
    p = F.col(prefix) if isinstance(prefix, str) else prefix
    return F.when(p == "", F.lit("top")).otherwise(F.split_part(p, F.lit("/"), F.lit(1)))


def normal_net(net) -> Column:
    """Trim, and close the gap before a bit index, except in escaped names."""
    t = F.trim(net)
    return F.when(t.startswith("\\"), t).otherwise(F.regexp_replace(t, r"\s+\[", "["))


def name_label(text: Column) -> Column:
    """Class id from the words in a name; the first word of the fixed order wins."""
    low = F.lower(text)
    out = None
    for word, label in S.LABEL_WORDS:
        out = F.when(low.contains(word), label) if out is None else out.when(low.contains(word), label)
    return out.otherwise(S.DEFAULT_LABEL)


def is_constant(net) -> Column:
    return (F.col(net) if isinstance(net, str) else net).rlike(S.CONSTANT_NET)


def is_sequential(cell) -> Column:
    return (F.col(cell) if isinstance(cell, str) else cell).rlike(S.SEQUENTIAL_CELL)


def finding_label(rank) -> Column:
    """F001, F002, ... (wider when needed)."""
    r = F.col(rank) if isinstance(rank, str) else rank
    return F.concat(F.lit("F"), F.when(r < 1000, F.lpad(r.cast("string"), 3, "0")).otherwise(r.cast("string")))
