"""Queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm import leakage, markov, neighbours, packing, residue, seen
from keyloom.runtime import read_table

_KEYS = ("arrival_id", "table_id", "primary_key", "key_vector")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return seen.seen_before(read_table(spark, d, "key_arrivals"), *_KEYS)


def p2_error_rate(spark: SparkSession, d: str) -> DataFrame:
    arrivals = read_table(spark, d, "key_arrivals")
    return seen.error_rate(arrivals, seen.seen_before(arrivals, *_KEYS), *_KEYS)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return markov.VectorClusters(read_table(spark, d, "vectors")).mutual_members()


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    return markov.VectorClusters(read_table(spark, d, "vectors")).summary()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.nearest_neighbours(read_table(spark, d, "vectors")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), read_table(spark, d, "pack_limits"))


def p7_fill_rate(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and unused space of each capacity."""
    return packing.fill_rate(p7_containers(spark, d))


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers of each capacity: every document is placed, none above
    the capacity, token ranges of a document without gap or overlap, and at most 5 % unused beside one last
    container."""
    placed = p7_containers(spark, d)
    w = Window.partitionBy("limit_id", "doc_id").orderBy("start_token", "n_tokens")
    gap = F.col("start_token") != F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = placed.withColumn("gap", gap).groupBy("limit_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.count_if("gap").alias("n_gaps"))
    over = placed.where("container IS NOT NULL").groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("used")).join(F.broadcast(read_table(spark, d, "pack_limits")), "limit_id")
    full = over.groupBy("limit_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_over"), (F.sum("used") >= 0.95 * (F.sum("capacity_tokens") - F.max("capacity_tokens"))).alias("well_filled"))
    return per.join(full, "limit_id").select("limit_id", "n_docs", "n_gaps", "n_over", "well_filled")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The leaked passages with their place in the original text."""
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), with_spans=True)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(read_table(spark, d, "documents"))


def p9_signs(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each detector gives away."""
    return residue.residue_signs(read_table(spark, d, "documents")).groupBy("sign").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_error_rate, p4_found, p4_clusters, p6_found, p7_containers, p7_fill_rate, p7_checks, p8_found, p8_passages, p9_found, p9_signs)}

_SEEN = """SELECT arrival_id FROM (SELECT arrival_id, row_number() OVER
    (PARTITION BY table_id, coalesce(key_vector, [primary_key]) ORDER BY arrival_id) AS rn FROM key_arrivals) WHERE rn > 1"""
_USABLE = """usable AS (SELECT table_id, col_id, vec_id, CAST(vec AS DOUBLE[]) AS v FROM vectors
    WHERE vec IS NOT NULL AND len(vec) = dimension AND list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[])) > 0),
    sims AS (SELECT a.table_id, a.col_id, a.vec_id AS q, b.vec_id AS c, list_cosine_similarity(a.v, b.v) AS s
    FROM usable a JOIN usable b ON a.table_id = b.table_id AND a.col_id = b.col_id AND a.vec_id <> b.vec_id)"""
ORACLES = {
    "p2_found": _SEEN,
    # brute force over all pairs of a column: for the small scale factors
    "p4_found": f"""WITH {_USABLE}, near AS (SELECT q, c FROM sims WHERE s >= 0.9),
        around AS (SELECT q, count(*) + 1 AS n, least(q, min(c)) AS first_id FROM near GROUP BY q),
        same AS (SELECT q, first_id FROM around WHERE n >= 3 AND NOT EXISTS
            (SELECT 1 FROM near JOIN around o ON o.q = near.c WHERE near.q = around.q AND (o.n <> around.n OR o.first_id <> around.first_id))),
        whole AS (SELECT first_id FROM same JOIN around USING (q, first_id) GROUP BY first_id HAVING count(*) = max(n))
        SELECT first_id, q AS vec_id FROM same JOIN whole USING (first_id) WHERE q <> first_id""",
    "p6_found": f"""WITH {_USABLE}, ranked AS (SELECT q, c, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, c) AS rn FROM sims)
        SELECT DISTINCT least(q, c) AS vec_a, greatest(q, c) AS vec_b FROM ranked WHERE rn <= 5""",
    "p7_checks": "SELECT limit_id, (SELECT count(*) FROM documents) AS n_docs, 0 AS n_gaps, 0 AS n_over, true AS well_filled FROM pack_limits",
    "p2_error_rate": f"SELECT (SELECT count(*) FROM key_arrivals) AS n_records, count(*) AS n_seen, 0 AS n_wrong, 0.0 AS wrong_rate FROM ({_SEEN})",
}
