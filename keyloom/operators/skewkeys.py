"""Problem 5: per-key results when a few keys hold most rows.

Exact offset chunking. Rows are first combined to one partial row per (key, sub-key), on the
map side too. The partial rows are put in the total order (key, sub-key) over range
partitions; the rows per partition are counted, the prefix sum of the counts gives each
partition's offset, and offset + position numbers every row without a gap. Equal runs of
``chunk_rows`` numbers are the work units: a key with a third of all rows is spread over many
chunks, thousands of small keys share one. A chunk yields one state per key it touches
(rows, distinct sub-keys, first and last sub-key, latest sequence); states of a key that
crosses chunk borders are merged in chunk order, counting a sub-key that straddles a border
once.

Defined results: null keys and null sub-keys are values of their own (null equals null; a
null sub-key is not counted as a distinct one, as in SQL); the latest sequence ignores nulls;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.runtime import materialize, shuffle_partitions

_POS_BITS = 33  # monotonically_increasing_id keeps the position in its lower 33 bits


def number_rows(df: DataFrame, order: list[str], label: str = "numbered") -> DataFrame:
    """``df`` in the total order of ``order`` with a gap-free ``__rn`` from 0.

    The sorted partitions are written once, so that numbers cannot change between the count
    and the use; only one row per partition reaches the single-task prefix sum.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    mid = F.monotonically_increasing_id()
    placed = materialize(ranged.select("*", F.shiftright(mid, _POS_BITS).cast("int").alias("__pid"), mid.bitwiseAND(F.lit((1 << _POS_BITS) - 1)).alias("__pos")), label)
    counts = placed.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__pid", before.alias("__offset"))
    # one row per partition: bounded by spark.sql.shuffle.partitions
    return placed.join(F.broadcast(offsets), "__pid").withColumn("__rn", F.col("__offset") + F.col("__pos")).drop("__pid", "__pos", "__offset")


def key_totals(df: DataFrame, keys: list[str], sub_key: str, seq: str, *, chunk_rows: int = 100_000) -> DataFrame:
    """Rows, distinct sub-keys and latest sequence of every key.

    Returns ``keys``, ``n_rows``, ``n_sub_keys``, ``last_seq`` and ``n_chunks`` (how many work
    units held the key).
    """
    renamed = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(sub_key).alias("s"), F.col(seq).alias("q"))
    ks = [f"k{i}" for i in range(len(keys))]
    partial = renamed.groupBy(*ks, "s").agg(F.count(F.lit(1)).alias("n"), F.max("q").alias("q"))
    numbered = number_rows(partial, [*ks, "s"], "keychunks")
    chunked = numbered.withColumn("chunk", F.floor(F.col("__rn") / chunk_rows))
    states = chunked.groupBy(*ks, "chunk").agg(
        F.sum("n").alias("n"), F.count("s").alias("d"), F.max("q").alias("q"), F.min("s").alias("first_s"), F.max("s").alias("last_s"),
    )
    # a key crosses few chunk borders: at most its rows / chunk_rows states
    w = Window.partitionBy(*ks).orderBy("chunk")
    straddles = (F.lag("last_s").over(w) == F.col("first_s")).cast("long")
    merged = states.withColumn("d", F.col("d") - F.coalesce(straddles, F.lit(0)))
    totals = merged.groupBy(*ks).agg(F.sum("n").alias("n_rows"), F.sum("d").alias("n_sub_keys"), F.max("q").alias("last_seq"), F.count(F.lit(1)).alias("n_chunks"))
    return totals.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "n_rows", "n_sub_keys", "last_seq", "n_chunks")


def heavy_keys(totals: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of all rows."""
    whole = totals.agg(F.sum("n_rows")).first()[0]  # one number
    return totals.where(F.col("n_rows") >= F.lit((whole or 0) * share))
