"""Queries of the general table-maintenance problems (1, 3, 5) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators.changefeed import apply_change_feed
from keyloom.operators.skewkeys import heavy_keys, key_totals
from keyloom.operators.smallfiles import SegmentCompactor, bin_layout
from keyloom.runtime import read_table

CHANGE_KEY = ["table_id", "pk_1", "pk_2"]


def _current(spark: SparkSession, d: str) -> DataFrame:
    return apply_change_feed(read_table(spark, d, "row_changes"), CHANGE_KEY, "tx_id", "deleted", tie=["change_id"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _current(spark, d).select(*CHANGE_KEY, "tx_id")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """Current rows and primary keys per table, with the newest write."""
    return _current(spark, d).groupBy("table_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("tx_id").alias("last_tx"), F.countDistinct("pk_1").alias("n_primary"))


def _compacted(spark: SparkSession, d: str) -> DataFrame:
    job = SegmentCompactor(spark)
    job.run(read_table(spark, d, "segment_metas"), read_table(spark, d, "segment_rows"))
    return job.read()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _compacted(spark, d).select("meta_id", "idx")


def p3_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The records of the new vector segments."""
    job = SegmentCompactor(spark)
    job.run(read_table(spark, d, "segment_metas"), None, read_table(spark, d, "vectors"))
    return job.read().select("meta_id", "idx", F.col("pk").alias("vec_id"))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the new segments: records, repeated records, tables that share a file,
    and no more files than one a table and two for each full file's worth of bytes."""
    job = SegmentCompactor(spark)
    job.run(read_table(spark, d, "segment_metas"), read_table(spark, d, "segment_rows"))
    records = job.read()
    per_bin = bin_layout(records).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("n_records"), F.max("n_tables").alias("tables_a_file"))
    repeated = records.groupBy("meta_id", "idx").count().where("count > 1").agg(F.count(F.lit(1)).alias("n_repeated"))
    whole = records.agg((F.countDistinct("table_id") + 2 * F.sum(F.expr(job.WIDTH)) / job.target_bytes).alias("allowed"))
    return per_bin.crossJoin(repeated).crossJoin(whole).select("n_records", "n_repeated", "tables_a_file", (F.col("n_files") <= F.col("allowed")).alias("few_files"))  # three single rows


def p3_layout(spark: SparkSession, d: str) -> DataFrame:
    return bin_layout(_compacted(spark, d))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return key_totals(read_table(spark, d, "row_changes"), ["table_id", "pk_1"], "pk_2", "tx_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_totals(spark, d)).select("table_id", "pk_1")


def p5_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(spark, d).drop("n_chunks")


QUERIES = {"p1_found": p1_found, "p1_tables": p1_tables, "p3_found": p3_found, "p3_vectors": p3_vectors, "p3_checks": p3_checks, "p3_layout": p3_layout, "p5_found": p5_found, "p5_totals": p5_totals}

_NEWEST = "SELECT table_id, pk_1, pk_2, max(tx_id) AS tx_id FROM row_changes GROUP BY table_id, pk_1, pk_2 HAVING NOT arg_max(deleted, tx_id)"
ORACLES = {
    "p1_found": _NEWEST,
    "p1_tables": f"SELECT table_id, count(*) AS n_rows, max(tx_id) AS last_tx, count(DISTINCT pk_1) AS n_primary FROM ({_NEWEST}) GROUP BY table_id",
    "p3_found": """SELECT DISTINCT m.meta_id, r.idx FROM segment_metas m JOIN segment_rows r
        ON r.segment_id = m.segment_id WHERE m.has_summary""",
    "p3_vectors": """SELECT m.meta_id, v.idx, max(v.vec_id) AS vec_id FROM segment_metas m JOIN vectors v
        ON v.segment_id = m.segment_id WHERE m.has_summary GROUP BY m.meta_id, v.idx""",
    "p3_checks": """SELECT count(*) AS n_records, 0 AS n_repeated, 1 AS tables_a_file, true AS few_files FROM
        (SELECT DISTINCT m.meta_id, r.idx FROM segment_metas m JOIN segment_rows r ON r.segment_id = m.segment_id WHERE m.has_summary)""",
    "p5_found": """SELECT table_id, pk_1 FROM row_changes GROUP BY table_id, pk_1
        HAVING count(*) >= 0.01 * (SELECT count(*) FROM row_changes)""",
    "p5_totals": """SELECT table_id, pk_1, count(*) AS n_rows, count(DISTINCT pk_2) AS n_sub_keys, max(tx_id) AS last_seq
        FROM row_changes GROUP BY table_id, pk_1""",
}
