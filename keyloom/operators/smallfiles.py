"""Problem 3: consolidate many tiny segments into few well-sized ones.

Steps
    1. *Freeze*: the segments that count (those with a summary) are listed once and written;
       everything below works on that list, whatever arrives meanwhile.
    2. *Stage*: records of the listed segments, identified by (meta_id, idx), each once.
       Catalog sizes and row counts are not trusted; bytes are measured from the records.
    3. *Pack*: the items are (meta_id, piece) with their measured bytes; a segment of more than
       ``target_bytes`` is cut into pieces of about that size by row number. First-fit
       decreasing fills bins of ``target_bytes`` per table, in groups of at most
       ``group_items`` items, so no task sees an unbounded list.
    4. *Rewrite*: bins are numbered densely; a bin belongs to one of at most ``max_tasks``
       tasks, which writes its bins one after the other, one file each.
    5. *Verify*: row count and an order-free checksum of the files as read back must equal
       those of the staged records.
    6. *Commit*: one manifest rename publishes the new segments. Before it, readers see
       nothing of them.

Defined results: segments with a null ``has_summary`` count as not valid; records whose
segment is not listed are left out; of repeated records the one with the highest
(tx_id, created, not_null_cols, text) is kept; a null idx is a row number of its own; all
versions and tombstones are kept; empty tables give an empty result; other columns are not
carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.runtime import materialize, new_path, release
from keyloom.sources.manifest import commit_manifest, read_manifest


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item. Items are taken in decreasing size (ties by position); each
    goes to the first bin with room, found in O(log n) in a tree of free space per bin. An item
    larger than ``capacity`` gets a bin of its own."""
    n = len(sizes)
    out = np.zeros(n, dtype=np.int64)
    if n == 0:
        return out
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [capacity] * (2 * leaves)  # every bin is still empty
    for i in np.lexsort((np.arange(n), -sizes)).tolist():
        need = min(int(sizes[i]), capacity)
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        out[i] = node - leaves
        room[node] -= need
        node //= 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return out


@dataclass
class CompactionReport:
    segments: int
    records: int
    bins: int
    checksum: int


class SegmentCompactor:
    """Rewrites segments into ``out`` and publishes them there."""

    COLUMNS = ["table_id", "meta_id", "idx", "pk", "tx_id", "created", "not_null_cols", "uud", "vec"]
    WIDTH = "40 + coalesce(octet_length(uud), 0) + 4 * coalesce(size(vec), 0)"  # bytes before compression, an upper bound of a file's share

    def __init__(self, spark: SparkSession, out: str | None = None, *, target_bytes: int = 128 << 20, group_items: int = 50_000, max_tasks: int = 10_000) -> None:
        self.spark = spark
        self.out = out or new_path(spark, "segments")
        self.target_bytes, self.group_items, self.max_tasks = target_bytes, group_items, max_tasks

    # -- steps ---------------------------------------------------------------------------
    def freeze(self, metas: DataFrame) -> DataFrame:
        return materialize(metas.where("has_summary").select("segment_id", "meta_id", "table_id").distinct(), "frozen")

    def stage(self, frozen: DataFrame, rows: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
        parts = []
        if rows is not None:
            parts.append(rows.select("segment_id", "idx", "pk", "tx_id", "created", "not_null_cols", "uud", F.lit(None).cast("array<float>").alias("vec")))
        if vectors is not None:
            parts.append(vectors.select("segment_id", "idx", F.col("vec_id").alias("pk"), F.lit(None).cast("bigint").alias("tx_id"), F.lit(None).cast("bigint").alias("created"), F.lit(None).cast("int").alias("not_null_cols"), F.lit(None).cast("string").alias("uud"), "vec"))
        records = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        valid = records.join(frozen, "segment_id").select(*self.COLUMNS)
        best = Window.partitionBy("meta_id", "idx").orderBy(*[F.col(c).desc_nulls_last() for c in ("tx_id", "created", "not_null_cols", "uud", "pk", "table_id")])
        once = valid.withColumn("__rn", F.row_number().over(best)).where("__rn <= 1").drop("__rn")
        return materialize(once, "staged")

    def pieces(self, staged: DataFrame) -> DataFrame:
        """``staged`` with ``__piece``: segments of more than a file are cut by their bytes."""
        sizes = staged.groupBy("meta_id").agg(F.sum(F.expr(self.WIDTH)).alias("bytes"), (F.max("idx") + 1).alias("rows"))
        # at most all bytes / target_bytes rows
        large = F.broadcast(sizes.where(F.col("bytes") > self.target_bytes).select(F.col("meta_id").alias("__m"), F.greatest(F.lit(1), F.floor(F.col("rows") * self.target_bytes / F.col("bytes"))).alias("__each")))
        return staged.join(large, F.col("meta_id").eqNullSafe(F.col("__m")), "left").withColumn("__piece", F.coalesce(F.floor(F.col("idx") / F.col("__each")), F.when(F.col("idx").isNull(), F.lit(-1)), F.lit(0)).cast("bigint")).drop("__m", "__each")

    def pack(self, pieced: DataFrame) -> DataFrame:
        """(meta_id, __piece) -> dense bin number."""
        items = pieced.groupBy("meta_id", "__piece").agg(F.min("table_id").alias("table_id"), F.sum(F.expr(self.WIDTH)).alias("bytes"))
        # groups of a bounded number of items: a table with many items is cut by hash
        groups = items.groupBy("table_id").agg(F.ceil(F.count(F.lit(1)) / self.group_items).alias("groups"))
        items = items.join(groups.withColumnRenamed("table_id", "__t"), F.col("table_id").eqNullSafe(F.col("__t"))).drop("__t")
        items = items.withColumn("grp", F.pmod(F.xxhash64("meta_id", "__piece"), F.col("groups"))).drop("groups")
        capacity = self.target_bytes

        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["meta_id", "__piece"], kind="stable")
            pdf["bin"] = first_fit_decreasing(pdf["bytes"].to_numpy(), capacity)
            return pdf[["meta_id", "__piece", "table_id", "grp", "bin", "bytes"]]

        packed = materialize(items.groupBy("table_id", "grp").applyInPandas(fill, "meta_id bigint, __piece bigint, table_id bigint, grp bigint, bin bigint, bytes bigint"), "packed")
        # bins per group -> offsets: one row per group, a few per table
        per = packed.groupBy("table_id", "grp").agg((F.max("bin") + 1).alias("n"))
        offset = F.coalesce(F.sum("n").over(Window.orderBy("table_id", "grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.select(F.col("table_id").alias("__t"), F.col("grp").alias("__g"), offset.alias("first"))
        return packed.join(per, F.col("table_id").eqNullSafe(F.col("__t")) & (F.col("grp") == F.col("__g"))).select("meta_id", "__piece", (F.col("first") + F.col("bin")).alias("bin"), "bytes")

    def _checksum(self, df: DataFrame) -> tuple[int, int]:
        # decimal sum of the row hashes: order does not matter, repeated rows do
        h = F.xxhash64(*self.COLUMNS).cast("decimal(38,0)")
        n, s = df.agg(F.count(F.lit(1)), F.sum(h)).first()
        return n, int(s or 0)

    def run(self, metas: DataFrame, rows: DataFrame | None, vectors: DataFrame | None = None) -> CompactionReport:
        """Compact row segments, vector segments or both."""
        frozen = self.freeze(metas)
        staged = self.stage(frozen, rows, vectors)
        pieced = self.pieces(staged)
        bins = materialize(self.pack(pieced), "bins")
        n_bins = (bins.agg(F.max("bin")).first()[0] or 0) + 1
        data = f"{self.out}/data"
        placed = pieced.join(bins.select(F.col("meta_id").alias("__m"), F.col("__piece").alias("__p"), "bin"), F.col("meta_id").eqNullSafe(F.col("__m")) & (F.col("__piece") == F.col("__p")))
        placed = placed.select(*self.COLUMNS, F.col("bin").cast("int").alias("bin"))
        n_tasks = min(n_bins, self.max_tasks)
        spread = placed.withColumn("__task", F.pmod("bin", F.lit(n_tasks))).repartitionById(n_tasks, "__task").drop("__task")
        spread.sortWithinPartitions("bin", "meta_id", "idx").write.mode("overwrite").partitionBy("bin").parquet(data)
        before, after = self._checksum(staged), self._checksum(self._files(data))
        if before != after:
            raise RuntimeError(f"rewritten segments differ from the records: {before} against {after}")
        report = CompactionReport(frozen.count(), before[0], n_bins, before[1])
        found = read_manifest(self.spark, f"{self.out}/_manifest")
        commit_manifest(self.spark, f"{self.out}/_manifest", (found[0] if found else 0) + 1, {"data": data, **report.__dict__})
        for df in (frozen, staged, bins):
            release(df)
        return report

    def read(self) -> DataFrame:
        """The records of the published segments with their ``bin``."""
        found = read_manifest(self.spark, f"{self.out}/_manifest")
        if not found:
            raise RuntimeError("nothing is committed here")
        return self._files(found[1]["data"])

    def _files(self, data: str) -> DataFrame:
        kinds = {"idx": "bigint", "not_null_cols": "int", "uud": "string", "vec": "array<float>"}
        schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in self.COLUMNS)
        return self.spark.read.schema(f"{schema}, bin int").parquet(data)


def bin_layout(records: DataFrame) -> DataFrame:
    """Rows, source segments and tables of each new segment."""
    return records.groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("meta_id").alias("n_segments"), F.countDistinct("table_id").alias("n_tables"))


__all__ = ["CompactionReport", "SegmentCompactor", "bin_layout", "first_fit_decreasing"]
