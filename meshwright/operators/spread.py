"""Small tables joined to large ones whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.cut import cut

#: A side of at most so many rows is broadcast; beyond it rows of a key that has over ``HOT_ROWS`` are dealt to ``SALTS`` places.
BROADCAST_ROWS = 20_000
HOT_ROWS = 100_000
SALTS = 64
#: Triangles that one task should measure: some seconds of work, in few bytes.
TASK_TRIANGLES = 8_000
#: Tasks a core at most; beyond that tasks only grow.
WAVES = 64
#: Rows of a batch that goes to Python: a worker holds a batch, and rows a task grow with the table.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``; its session's Arrow batches have at most ``rows`` rows."""
    conf = df.sparkSession.conf
    at = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if not 0 < at <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fits(small: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table (cheap to read: written, or an aggregate of few groups) has at most ``rows`` rows."""
    return small.limit(rows + 1).count() <= rows


def evenly(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join by a shuffle of both sides. The optimizer takes the bytes of a table's file for the size of what is derived from it, and
    would send the rows that explodes make of few bytes through the driver to every executor."""
    return left.join(right.hint("merge"), keys, how)


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = SALTS, hot: int = HOT_ROWS) -> DataFrame:
    """``big`` joined (inner, left, left_semi or left_anti) with ``small``, which has a row a key.

    A small side of checked size is broadcast. Else both are shuffled, and keys of more than ``hot`` rows are repeated for each salt,
    where rows of ``big`` get one of their other columns; there are no more such keys than ``hot`` goes into the rows.
    """
    if fits(small, rows):
        return big.join(F.broadcast(small), keys, how)
    others = [F.col(f"`{c}`") for c in big.columns if c not in keys] or [F.lit(0)]
    heavy = cut(big.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).select(*keys, F.lit(True).alias("_hot")))
    if heavy.isEmpty():
        return evenly(big, small, keys, how)
    marked = lambda df: df.join(F.broadcast(heavy), keys, "left")
    deal = F.coalesce("_hot", F.lit(False)) | F.greatest(*(F.col(f"`{k}`").isNull() for k in keys), F.lit(False))  # a null meets nothing
    salted = marked(big).withColumn("_salt", F.when(deal, F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    repeated = marked(small).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return evenly(salted, repeated, [*keys, "_salt"], how).drop("_salt")


def dealt(rows: DataFrame, key: str, triangles: int, a_task: int = TASK_TRIANGLES) -> DataFrame:
    """``rows`` over as many tasks as their meshes, of ``triangles`` a row, call for: bytes of a table of sizes say nothing of them.

    One shuffle of the few columns that meshes are made of, where the table gives fewer tasks (its rows are counted from the files' footers).
    """
    wanted = min(-(-rows.count() * triangles // a_task), WAVES * rows.sparkSession.sparkContext.defaultParallelism)
    return rows if wanted <= 1 or rows.rdd.getNumPartitions() >= wanted else rows.repartition(int(wanted), key)
