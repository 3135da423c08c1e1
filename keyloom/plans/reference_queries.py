"""Queries of the keyed-table engine over the test tables, through the strict dialect where it
can express them. Every function takes (spark, data folder) and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import vector
from keyloom.functions.types import ColumnType, KINDS, rendered
from keyloom.operators.changefeed import newest_per_key
from keyloom.plans.engine import Engine
from keyloom.runtime import new_path, read_table
from keyloom.sources.catalog import declared_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# table -> key, range index, version columns
_TABLES: dict[str, tuple[list[str], bool, list[str]]] = {
    "orders": (["o_orderkey"], False, []),
    "customer": (["c_nationkey", "c_custkey"], True, []),
    "events": (["user_id", "ts"], True, []),
    "nation": (["n_nationkey"], False, []),
    "supplier": (["s_suppkey"], False, []),
    "part": (["p_partkey"], True, []),
    "embeddings": (["vec_id"], False, []),
    "documents": (["doc_id"], False, []),
    "lineitem": (["l_orderkey", "l_linenumber"], True, ["l_shipdate", "l_partkey", "l_suppkey"]),
    "row_changes": (["table_id", "pk_1", "pk_2"], True, ["tx_id"]),
    "segment_rows": (["segment_id", "idx"], True, ["tx_id", "created"]),
}


def engine_for(spark: SparkSession, d: str, *names: str) -> Engine:
    engine = Engine(spark)
    for n in names:
        key, range_idx, version = _TABLES[n]
        engine.register_parquet(f"ks1.{n}", f"{d}/{n}.parquet", key, range_idx=range_idx, version=version, deleted="deleted" if n == "row_changes" else None)
    return engine


def _statement(name: str, table: str, text: str, oracle: str) -> None:
    QUERIES[name] = lambda spark, d: engine_for(spark, d, table).sql(text)
    ORACLES[name] = oracle


_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_statement("point_lookup", "orders", f"select {_O} from ks1.orders where o_orderkey = 77", f"SELECT {_O} FROM orders WHERE o_orderkey = 77")
_statement("point_lookup_zero_key", "orders", f"select {_O} from ks1.orders where o_orderkey = 0", f"SELECT {_O} FROM orders WHERE o_orderkey = 0")
_statement("point_lookup_absent", "orders", f"select {_O} from ks1.orders where o_orderkey = 9999999999", f"SELECT {_O} FROM orders WHERE o_orderkey = 9999999999")
_statement("multi_get_in", "orders", f"select {_O} from ks1.orders where o_orderkey in (3, 1, 40, 1, 1200, 0)", f"SELECT {_O} FROM orders WHERE o_orderkey IN (3, 1, 40, 1200, 0)")
_statement("composite_point", "customer", "select * from ks1.customer where c_nationkey = 16 and c_custkey = 2", "SELECT * FROM customer WHERE c_nationkey = 16 AND c_custkey = 2")
_IN = "c_nationkey IN (1, 2, 3, 4, 5, 6, 7, 8) AND c_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)"
_statement("composite_in_cross_product", "customer", f"select * from ks1.customer where {_IN}", f"SELECT * FROM customer WHERE {_IN}")
_statement("range_single_level", "part", "select p_partkey, p_name, p_size from ks1.part where p_partkey >= 150", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey >= 150")
_statement("range_first_level", "customer", "select * from ks1.customer where c_nationkey > 20 and c_custkey <= 900", "SELECT * FROM customer WHERE c_nationkey > 20 AND c_custkey <= 900")
for _n, _op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    _c = f"c_nationkey = 7 AND c_custkey {_op} 700"
    _statement(f"range_{_n}", "customer", f"select c_custkey, c_name, c_acctbal from ks1.customer where {_c}", f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE {_c}")
_statement("range_in_prefix", "customer", "select * from ks1.customer where c_nationkey in (3, 5) and c_custkey >= 500", "SELECT * FROM customer WHERE c_nationkey IN (3, 5) AND c_custkey >= 500")
_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY table_id, pk_1, pk_2 ORDER BY tx_id DESC) AS rn FROM row_changes) WHERE rn = 1 AND NOT deleted)"
_three = "table_id = 101 AND pk_1 > 100 AND pk_2 <= 500"
_statement("range_three_level", "row_changes", f"select table_id, pk_1, pk_2, tx_id from ks1.row_changes where {_three}", f"SELECT table_id, pk_1, pk_2, tx_id FROM {_NEWEST} WHERE {_three}")
_statement("range_two_level_versions", "segment_rows", "select segment_id, idx, pk, tx_id from ks1.segment_rows where segment_id >= 1000 and idx < 3", "SELECT segment_id, idx, max(pk) AS pk, max(tx_id) AS tx_id FROM segment_rows WHERE segment_id >= 1000 AND idx < 3 GROUP BY segment_id, idx")
_statement("projection_order", "customer", "select c_name, c_custkey, c_nationkey from ks1.customer where c_nationkey = 3 and c_custkey > 0", "SELECT c_nationkey, c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_custkey > 0")
_statement("projection_star", "nation", "select * from ks1.nation where n_nationkey in (0, 5, 24)", "SELECT * FROM nation WHERE n_nationkey IN (0, 5, 24)")
_statement("order_limit", "customer", "select c_custkey, c_acctbal from ks1.customer where c_nationkey >= 0 and c_custkey >= 0 order by c_acctbal desc, c_custkey limit 10 offset 5", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT event_id, ts, user_id, value FROM events WHERE user_id = 3 AND ts > TIMESTAMP '2024-01-02'")
def range_time_series(spark: SparkSession, d: str) -> DataFrame:
    """A prefix range over (user_id, ts) where ts is a native timestamp, in epoch milliseconds."""
    return engine_for(spark, d, "events").sql("select event_id, ts, user_id, value from ks1.events where user_id = 3 and ts > 1704153600000")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (11, 500)")
def prepared_point(spark: SparkSession, d: str) -> DataFrame:
    session = engine_for(spark, d, "orders").session()
    number, _ = session.prepare("select o_orderkey, o_totalprice from ks1.orders where o_orderkey = ?")
    return session.execute(number, [11]).unionAll(session.execute(number, [500]))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 4 AND c_custkey > 100")
def prepared_range(spark: SparkSession, d: str) -> DataFrame:
    session = engine_for(spark, d, "customer").session()
    number, _ = session.prepare("select c_custkey, c_mktsegment from ks1.customer where c_nationkey = ? and c_custkey > ?")
    return session.execute(number, [4, 100])


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest version of every key: last write wins."""
    return engine_for(spark, d, "lineitem").view("ks1.lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def _stored_orders(spark: SparkSession, d: str) -> Engine:
    """Orders as three commits: all rows, an overlay of finished ones, tombstones."""
    engine = Engine(spark, new_path(spark, "orders"))
    engine.sql("create keyspace ks1")
    engine.sql("create table ks1.orders (o_orderkey long, o_custkey long, o_orderstatus varchar, o_totalprice double, primary key (o_orderkey))")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    engine.insert_df("ks1.orders", orders)
    engine.insert_df("ks1.orders", orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    meta = engine.meta("ks1.orders")
    engine.store(meta).append(orders.where("o_orderstatus = 'P'").select("o_orderkey"), deleted=True)
    return engine


_OVERLAID = "SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'P'"


@query(_OVERLAID)
def delete_tombstone(spark: SparkSession, d: str) -> DataFrame:
    return _stored_orders(spark, d).view("ks1.orders")


@query(_OVERLAID)
def compacted_view(spark: SparkSession, d: str) -> DataFrame:
    engine = _stored_orders(spark, d)
    engine.compact("ks1.orders")
    return engine.view("ks1.orders")


@query("SELECT o_orderkey, o_totalprice FROM (VALUES (1, 10.5), (3, 30.25)) t(o_orderkey, o_totalprice)")
def statement_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Create, insert, overwrite, delete and read through statements alone."""
    engine = Engine(spark, new_path(spark, "lifecycle"))
    engine.sql("create keyspace ks1")
    engine.sql("create table ks1.t (o_orderkey long, o_totalprice double, primary key (o_orderkey)) with (range_idx=true)")
    engine.sql("insert into ks1.t (o_orderkey, o_totalprice) values (1, 1.5), (2, 20.0), (3, 30.25)")
    engine.sql("insert into ks1.t (o_orderkey, o_totalprice) values (?, ?)", [1, 10.5])
    engine.sql("delete from ks1.t where o_orderkey in (2, 9)")
    return engine.sql("select * from ks1.t where o_orderkey >= 0")


# fixed values: the query vector of the similarity examples, any 64 numbers would do
_Q64 = [round(((i * 37) % 64 - 31.5) / 64, 4) for i in range(64)]
_V = "[" + ", ".join(f"{x}::DOUBLE" for x in _Q64) + "]"
_E = "list_transform(embedding, lambda x: x::DOUBLE)"


def _topk(metric: str) -> Query:
    return lambda spark, d: vector.knn(engine_for(spark, d, "embeddings").view("ks1.embeddings"), "embedding", _Q64, 10, key=["vec_id"], metric=metric).select("vec_id", "label", "score")


for _name, _metric, _score, _dir in (
    ("vector_ip_topk", "inner_product", f"list_dot_product({_E}, {_V})", "DESC"),
    ("vector_l2_topk", "l2", f"list_sum(list_transform(list_zip({_E}, {_V}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "ASC"),
    ("vector_cosine_topk", "cosine", f"list_cosine_similarity({_E}, {_V})", "DESC"),
):
    QUERIES[_name] = _topk(_metric)
    ORACLES[_name] = f"SELECT vec_id, label, round({_score}, 6) AS score FROM embeddings ORDER BY score {_dir}, vec_id LIMIT 10"


@query(f"SELECT vec_id, round(list_cosine_similarity({_E}, {_V}), 6) AS sim FROM embeddings WHERE vec_id IN (1, 2, 3, 5, 8, 13)")
def sim_cosine_projection(spark: SparkSession, d: str) -> DataFrame:
    text = ",".join(str(x) for x in _Q64)
    return engine_for(spark, d, "embeddings").sql(f"select vec_id, sim_cosine(embedding, '{text}') as sim from ks1.embeddings where vec_id in (1, 2, 3, 5, 8, 13)")


@query("SELECT segment_id, count(*) AS n_rows, min(pk) AS pk_min, max(pk) AS pk_max, min(tx_id) AS tx_min, max(tx_id) AS tx_max, sum((not_null_cols = 0)::INT) AS n_tombstones FROM segment_rows GROUP BY segment_id")
def segment_zone_map(spark: SparkSession, d: str) -> DataFrame:
    """Key and transaction range of every segment, from its rows."""
    rows = read_table(spark, d, "segment_rows")
    return rows.groupBy("segment_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("pk").alias("pk_min"), F.max("pk").alias("pk_max"), F.min("tx_id").alias("tx_min"), F.max("tx_id").alias("tx_max"), F.sum((F.col("not_null_cols") == 0).cast("int")).alias("n_tombstones"))


@query("SELECT pk, tx_id, uud FROM (SELECT r.pk, r.tx_id, r.uud, r.not_null_cols, row_number() OVER (PARTITION BY m.table_id, r.pk ORDER BY r.tx_id DESC) AS rn FROM segment_rows r JOIN segment_metas m USING (segment_id) WHERE m.has_summary AND m.table_id = 302) WHERE rn = 1 AND not_null_cols <> 0")
def segment_rows_current(spark: SparkSession, d: str) -> DataFrame:
    """Current rows of one table from its segments: newest version, tombstones hidden."""
    metas = read_table(spark, d, "segment_metas").where("has_summary AND table_id = 302").select("segment_id", "table_id")
    rows = read_table(spark, d, "segment_rows").join(metas, "segment_id")
    return newest_per_key(rows, ["table_id", "pk"], "tx_id").where("not_null_cols <> 0").select("pk", "tx_id", "uud")


@query("""SELECT table_id, table_name, count(*) AS n_columns, max(pk_size) AS pk_size, bool_or(range_idx) AS range_idx,
    string_agg(col_name || ' ' || lower(data_type) || CASE WHEN dimension > 0 THEN '[' || dimension || ']' ELSE '' END, ', ' ORDER BY col_id) AS columns,
    string_agg(col_name, ', ' ORDER BY col_id) FILTER (WHERE is_pk) AS key FROM table_columns GROUP BY table_id, table_name""")
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    return declared_tables(read_table(spark, d, "table_columns"))


@query("SELECT event_id, props FROM events WHERE user_id = 5 AND event_type = 'click'")
def json_text_select(spark: SparkSession, d: str) -> DataFrame:
    """JSON stays text."""
    return engine_for(spark, d, "events").spark_sql("select event_id, props from ks1.events where user_id = 5 and event_type = 'click'")


@query("SELECT o_orderstatus, count(*) AS n, sum(o_orderkey) AS s FROM orders GROUP BY o_orderstatus")
def permissive_sql(spark: SparkSession, d: str) -> DataFrame:
    """Spark SQL over a registered table, beyond the dialect."""
    return engine_for(spark, d, "orders").spark_sql("select o_orderstatus, count(*) as n, sum(o_orderkey) as s from ks1.orders group by o_orderstatus")


@query("SELECT vec_id, array_to_string(list_transform(vec, lambda x: round(x * 1000)::BIGINT), ',') AS shown FROM vectors WHERE vec IS NOT NULL AND len(vec) = dimension")
def vector_render(spark: SparkSession, d: str) -> DataFrame:
    whole = F.transform("vec", lambda x: F.round(x * F.lit(1000).cast("float")).cast("bigint"))
    rows = read_table(spark, d, "vectors").where("vec IS NOT NULL AND size(vec) = dimension")
    return rows.select("vec_id", rendered(whole, ColumnType(KINDS["LONG_VECTOR"])).alias("shown"))


@query("SELECT p_partkey, lower(hex(encode(p_name))) AS shown FROM part")
def blob_hex(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select("p_partkey", rendered(F.col("p_name").cast("binary"), ColumnType(KINDS["BLOB"])).alias("shown"))
