import pytest
from conftest import rows

from keyloom.errors import EngineError, ErrorCode
from keyloom.plans.engine import Engine
from keyloom.server import answer, repl


def make(db, text="create table ks1.t (k long, note varchar, n int, primary key (k))"):
    db.sql(text)
    return db


def keys(df):
    return sorted(r[0] for r in df.collect())


def test_upsert_delete_reopen_compact(db, spark):
    make(db, "create table ks1.t (k long, note varchar, n int, primary key (k)) with (range_idx=true)")
    db.sql("insert into ks1.t (k, note, n) values (0, 'zero', 1), (1, 'one', 2), (1, 'uno', 3), (2, 'two', 4)")
    assert rows(db.sql("select k, note from ks1.t where k in (0, 1, 1, 7)")) == [(0, "zero"), (1, "uno")]
    db.sql("insert into ks1.t (k, n) values (2, 9)")  # an upsert replaces the whole row
    assert rows(db.sql("select * from ks1.t where k = 2")) == [(2, None, 9)]
    db.sql("delete from ks1.t where k in (0, 5)")
    assert keys(db.sql("select * from ks1.t where k >= 0")) == [1, 2]
    again = Engine(spark, db.root)
    assert keys(again.sql("select * from ks1.t where k >= 0")) == [1, 2]
    assert len(again.zone_map("ks1.t")) == 3
    assert again.compact("ks1.t") and len(again.zone_map("ks1.t")) == 1
    assert keys(again.sql("select * from ks1.t where k >= 0")) == [1, 2]
    again.sql("insert into ks1.t (k, note) values (0, 'back')")
    assert keys(again.sql("select * from ks1.t where k < 2")) == [0, 1]


def test_compaction_starts_by_itself(db):
    make(db)
    for i in range(5):
        db.sql("insert into ks1.t (k, n) values (?, ?)", [i % 2, i])
    assert len(db.zone_map("ks1.t")) == 1
    assert rows(db.sql("select k, n from ks1.t where k in (0, 1)")) == [(0, 4), (1, 3)]


def test_same_table_name_in_two_keyspaces(db):
    db.sql("create keyspace KS2")
    for ks in ("ks1", "ks2"):
        db.sql(f"create table {ks}.t (k long, primary key (k))")
    db.sql("insert into ks1.t (k) values (1)")
    assert db.view("ks2.t").count() == 0 and db.view("ks1.t").count() == 1


def test_lookups_skip_commits(db):
    make(db)
    db.sql("insert into ks1.t (k) values (1), (2)")
    db.sql("insert into ks1.t (k) values (100), (200)")
    from keyloom.sources.storage import KeyBound

    assert len(db.store(db.meta("ks1.t")).versions(KeyBound(100, 100)).inputFiles()) == 1
    assert keys(db.sql("select k from ks1.t where k = 100")) == [100]


def test_prepared_statements(db):
    make(db)
    session = db.session()
    put, n = session.prepare("insert into ks1.t (k, note, n) values (?, 'fixed', ?)")
    assert n == 2
    session.execute(put, [1, 10])
    session.execute(put, [2, 20])
    get, _ = session.prepare("select * from ks1.t where k = ?")
    assert rows(session.execute(get, [2])) == [(2, "fixed", 20)]
    gone, _ = session.prepare("delete from ks1.t where k = ?")
    session.execute(gone, [2])
    assert session.execute(get, [2]).count() == 0
    assert session.status() == {"open": True, "prepared": 3}
    with pytest.raises(EngineError) as e:
        session.execute(get, [])
    assert e.value.code is ErrorCode.PROTOCOL_BAD_PREPARED_VALUE
    with pytest.raises(EngineError) as e:
        session.execute(get, ["x"])
    assert e.value.code is ErrorCode.SQL_WRONG_VALUE_FORMAT
    session.deallocate(get)
    for number in (get, 999_999):
        with pytest.raises(EngineError) as e:
            session.execute(number, [1])
        assert e.value.code is ErrorCode.PROTOCOL_BAD_PREPARED_ID
    with pytest.raises(EngineError):
        db.session().execute(put, [1, 1])  # another session
    session.close()
    with pytest.raises(EngineError) as e:
        session.execute(put, [1, 1])
    assert e.value.code is ErrorCode.CONNECTION_CLOSED
    with pytest.raises(EngineError):
        db.session().prepare("create keyspace x")


CASES = [
    ("k = 7", [7]), ("k < 5", [0, 1, 2, 3, 4]), ("k <= 2", [0, 1, 2]), ("k > 7", [8, 9]), ("k >= 7", [7, 8, 9]), ("k = 12", []), ("k < 0", []), ("k in (9, 3, 3, 11)", [3, 9]),
]


@pytest.fixture(scope="module")
def ranges(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("ranges")
    spark.range(10).withColumnRenamed("id", "k").write.parquet(str(base / "a"))
    spark.sql("select a.id as pk1, 1000 + b.id as pk2 from range(10) a, range(5) b").write.parquet(str(base / "b"))
    spark.sql("select a.id as pk1, 20 + b.id as pk2, 30 + c.id as pk3 from range(10) a, range(5) b, range(5) c").write.parquet(str(base / "c"))
    e = Engine(spark)
    e.register_parquet("ks.a", str(base / "a"), ["k"], range_idx=True)
    e.register_parquet("ks.b", str(base / "b"), ["pk1", "pk2"], range_idx=True)
    e.register_parquet("ks.c", str(base / "c"), ["pk1", "pk2", "pk3"], range_idx=True)
    return e


@pytest.mark.parametrize(("where", "expected"), CASES)
def test_one_level_ranges(ranges, where, expected):
    assert keys(ranges.sql(f"select k from ks.a where {where}")) == expected


@pytest.mark.parametrize(("where", "expected"), [("pk1 = 2 and pk2 = 1003", [1003]), ("pk1 = 2 and pk2 < 1002", [1000, 1001]), ("pk1 = 2 and pk2 <= 1002", [1000, 1001, 1002]), ("pk1 = 2 and pk2 > 1002", [1003, 1004]), ("pk1 = 2 and pk2 >= 1002", [1002, 1003, 1004]), ("pk1 = 11 and pk2 = 1004", []), ("pk1 in (1, 2) and pk2 > 1003", [1004, 1004]), ("pk1 < 1 and pk2 > 1003", [1004])])
def test_two_level_ranges(ranges, where, expected):
    assert keys(ranges.sql(f"select pk2 from ks.b where {where}")) == expected


@pytest.mark.parametrize(("where", "n"), [("pk1 = 2 and pk2 = 20 and pk3 < 33", 3), ("pk1 = 1 and pk2 > 20 and pk3 > 31", 12), ("pk1 = 1 and pk2 = 20 and pk3 <= 31", 2), ("pk1 = 1 and pk2 = 20 and pk3 < 31", 1), ("pk1 = 1 and pk2 = 20 and pk3 > 31", 3), ("pk1 = 1 and pk2 = 20 and pk3 >= 31", 4), ("pk1 = 1 and pk2 = 20 and pk3 = 31", 1)])
def test_three_level_ranges(ranges, where, n):
    assert ranges.sql(f"select * from ks.c where {where}").count() == n


def test_filters_and_columns_reach_the_scan(ranges):
    plan = ranges.sql("select pk2 from ks.b where pk1 = 2 and pk2 > 1001")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(pk1,2)" in plan and "GreaterThan(pk2,1001)" in plan


def test_order_limit_offset(ranges):
    out = ranges.sql("select k from ks.a where k >= 0 order by k desc limit 3 offset 1").collect()
    assert [r.k for r in out] == [8, 7, 6]


def test_registered_files_are_read_only(ranges):
    with pytest.raises(EngineError):
        ranges.sql("insert into ks.a (k) values (1)")


def test_bulk_load_checks_values(db, spark):
    db.sql("create table ks1.v (k short, vec float_vector[2], name varchar[3], primary key (k))")
    good = spark.createDataFrame([(1, [1.0, 2.0], "abc"), (2, None, None)], "K int, vec array<double>, name string")
    db.insert_df("ks1.v", good, unique=True)
    assert db.view("ks1.v").count() == 2
    for bad in ([(70000, [1.0, 2.0], "a")], [(1, [1.0], "a")], [(1, [1.0, 2.0], "abcd")], [(None, [1.0, 2.0], "a")]):
        with pytest.raises(Exception, match="bad value|null in primary key"):
            db.insert_df("ks1.v", spark.createDataFrame(bad, good.schema))
    assert db.view("ks1.v").count() == 2  # nothing of the failed commits is visible
    with pytest.raises(EngineError):
        db.insert_df("ks1.v", good.drop("K"))


def test_bulk_load_order_decides(db, spark):
    make(db)
    db.insert_df("ks1.t", spark.createDataFrame([(1, 5, 10), (1, 6, 30), (1, 7, 20)], "k long, n int, seq long"), order="seq")
    assert rows(db.sql("select k, n from ks1.t where k = 1")) == [(1, 6)]
    db.insert_many("ks1.t", [{"k": 1, "n": 1}, {"k": 1, "N": 2}, {"k": 4}])
    assert rows(db.sql("select k, n from ks1.t where k in (1, 4)")) == [(1, 2), (4, None)]


def test_ddl_and_errors(db):
    make(db)
    for text, code in (
        ("create keyspace ks1", ErrorCode.SQL_DDL_ERROR), ("create table ks1.t (k long, primary key (k))", ErrorCode.SQL_DDL_ERROR), ("create table t (k long, primary key (k))", ErrorCode.SQL_DDL_ERROR),
        ("create table nope.t (k long, primary key (k))", ErrorCode.SQL_UNKNOWN_ENTITY), ("select * from ks1.nope where k = 1", ErrorCode.SQL_UNKNOWN_ENTITY), ("create table ks1.x (k uuid, primary key (k))", ErrorCode.SQL_UNKNOWN_DATA_TYPE),
        ("create index i on ks1.t (note)", ErrorCode.SQL_DDL_ERROR), ("drop index nope", ErrorCode.SQL_UNKNOWN_ENTITY), ("drop keyspace ks1", ErrorCode.SQL_DDL_ERROR),
    ):
        with pytest.raises(EngineError) as e:
            db.sql(text)
        assert e.value.code is code, text
    db.sql("create index by_n on ks1.t (n)")
    db.sql("insert into ks1.t (k, n) values (1, 5), (2, 6)")
    assert keys(db.sql("select k from ks1.t where n > 5")) == [2]
    db.sql("drop index by_n")
    with pytest.raises(EngineError):
        db.sql("select k from ks1.t where n > 5")
    assert [r.name for r in db.sql("describe ks1.t").orderBy("col_id").collect()] == ["k", "note", "n"]
    db.sql("truncate table ks1.t")
    assert db.view("ks1.t").count() == 0
    db.sql("drop table ks1.t")
    db.sql("drop keyspace ks1")


def test_vector_index_and_similarity(db):
    db.sql("create table ks1.v (k long, vec float_vector[3], primary key (k))")
    db.sql("create index iv on ks1.v (vec)")
    db.sql("insert into ks1.v (k, vec) values (1, '1,0,0'), (2, '0.5,0.5,0'), (3, '0,0,1'), (4, '0,0,0')")
    out = db.sql("select k, sim_cosine(vec, '1,0,0') as s from ks1.v order by s desc, k limit 2").collect()
    assert [(r.k, r.s) for r in out] == [(1, 1.0), (2, 0.707107)]
    assert [r.k for r in db.knn("ks1.v", "vec", [1, 0, 0], 3, "l2").collect()] == [1, 2, 4]
    assert [(r.k, r.score) for r in db.knn("ks1.v", "vec", [2, 2, 0], 2, "inner_product").collect()] == [(1, 2.0), (2, 2.0)]
    session = db.session()
    number, _ = session.prepare("select k, sim_ip(vec, ?) from ks1.v where k = 2")
    assert session.execute(number, [[2, 2, 2]]).first()[1] == 2.0
    with pytest.raises(EngineError):
        db.sql("select sim_cosine(vec, '1,0') from ks1.v where k = 1")


def test_spark_sql_over_tables(db):
    make(db)
    db.sql("insert into ks1.t (k, n) values (1, 5), (2, 6), (3, 6)")
    assert rows(db.spark_sql("select n, count(*) c from ks1.t group by n")) == [(5, 1), (6, 2)]
    assert db.spark_sql("select * from ks1.t where k = :k", k=2).count() == 1


def test_text_form_http_and_repl(db):
    make(db)
    db.sql("insert into ks1.t (k, note) values (500, 'a b')")
    assert db.text("select * from ks1.t where k = 500") == 'Rows count: 1\nrow: {"k":"500","note":"a b"}\n'
    assert db.text("select * from ks1.t where k = 1") == "Rows count: 0\n"
    assert answer(db, "/query?select%20k%20from%20ks1.t%20where%20k%20=%20500") == (200, 'Rows count: 1\nrow: {"k":"500"}\n')
    assert answer(db, "/query?drop%20view%20x")[1].startswith("SQL_UNSUPPORTED")
    assert answer(db, "/other")[0] == 404
    said, lines = [], iter(["select k from ks1.t where k = 500", "nonsense", ""])
    repl(db, lambda _: next(lines), lambda *a, **k: said.append(a[0]))
    assert said[0].startswith("Rows count: 1") and said[1].startswith("SQL_UNSUPPORTED")


def test_wide_long_keys(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/wide", wide_long=True)
    e.sql("create keyspace k")
    e.sql("create table k.t (a long, n int, primary key (a))")
    e.sql(f"insert into k.t (a, n) values ({2**64 - 1}, 1), (0, 2)")
    assert e.sql(f"select n from k.t where a = {2**64 - 1}").first().n == 1


def test_streaming_ingest(db, spark, tmp_path):
    from keyloom.streaming.ingest import apply_batch, start_ingest

    make(db)
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, 5, 1, False), (1, 6, 2, False), (2, 7, 1, False), (3, 1, 1, False), (3, 1, 2, True)], "k long, n int, seq long, gone boolean").write.parquet(src)
    stream = spark.readStream.schema("k long, n int, seq long, gone boolean").parquet(src)
    q = start_ingest(db, "ks1.t", stream, str(tmp_path / "cp"), order="seq", deleted="gone", once=True)
    q.awaitTermination(120)
    assert rows(db.view("ks1.t").select("k", "n")) == [(1, 6), (2, 7)]
    before = len(db.zone_map("ks1.t"))
    apply_batch(db, "ks1.t", spark.createDataFrame([(9, 9)], "k long, n int"), 0)  # already applied
    assert len(db.zone_map("ks1.t")) == before


def test_two_engines_write_in_turn(db, spark, tmp_path):
    from keyloom.plans.engine import Engine

    db.sql("create table ks1.shared (k long, v varchar, primary key (k))")
    db.sql("insert into ks1.shared (k, v) values (1, 'a')")
    other = Engine(spark, f"file://{tmp_path}/db")
    other.sql("insert into ks1.shared (k, v) values (2, 'b')")
    db.sql("insert into ks1.shared (k, v) values (3, 'c')")
    other.sql("insert into ks1.shared (k, v) values (1, 'd')")
    expected = [(1, "d"), (2, "b"), (3, "c")]
    assert rows(db.view("ks1.shared")) == rows(other.view("ks1.shared")) == expected


def test_results_survive_compaction_until_vacuum(db):
    db.sql("create table ks1.kept (k long, primary key (k))")
    for i in range(4):
        db.sql(f"insert into ks1.kept (k) values ({i})")
    planned = db.view("ks1.kept")
    assert db.compact("ks1.kept")
    assert rows(planned) == [(i,) for i in range(4)]
    store = db.store(db.meta("ks1.kept"))
    assert store.vacuum() == 0 and store.vacuum(0) == 4
    assert rows(db.view("ks1.kept")) == [(i,) for i in range(4)]


def test_late_changes_lose_and_batches_count_once(db, spark):
    from keyloom.streaming.ingest import apply_batch

    db.sql("create table ks1.late (k long, v varchar, primary key (k))")
    schema = "k long, v string, seq long, gone boolean"

    def batch(i, *data):
        apply_batch(db, "ks1.late", spark.createDataFrame(data, schema), i, order="seq", deleted="gone")

    batch(0, (1, "new", 10, False), (2, "x", 3, False), (3, "y", 1, None))
    batch(1, (1, "old", 5, False), (2, None, 7, True))
    batch(2, (2, "late", 6, False), (3, "z", None, False))
    batch(2, (3, "twice", 99, False))
    assert rows(db.view("ks1.late").select("k", "v")) == [(1, "new"), (3, "y")]
    db.compact("ks1.late")
    batch(3, (2, "later", 5, False))  # older than the delete, which compaction kept
    assert rows(db.view("ks1.late").select("k", "v")) == [(1, "new"), (3, "y")]


def test_point_lookups_open_one_file(db, spark):
    db.sql("create table ks1.wide (k long, v varchar, primary key (k)) ")
    db.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db.insert_df("ks1.wide", spark.range(20_000).selectExpr("id as k", "cast(id as string) as v"), unique=True)
    finally:
        db.spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    entry = db.store(db.meta("ks1.wide")).zone_map()[0]
    assert len(entry["files"]) >= 2
    got = db.sql("select * from ks1.wide where k = 777")
    assert len(got.inputFiles()) == 1 and rows(got) == [(777, "777")]


def test_registered_files_with_native_times_and_negative_keys(db, spark, tmp_path):
    path = str(tmp_path / "times")
    spark.sql("select -5L as k, timestamp_ntz'2024-01-02 00:00:00.001' as t union all select 7L, timestamp_ntz'2023-05-01 00:00:00'").write.parquet(path)
    db.register_parquet("ks1.times", path, ["k", "t"], range_idx=True)
    got = db.sql("select k from ks1.times where k = -5 and t > 1704153600000")
    assert rows(got) == [(-5,)]
    assert "PushedFilters: [" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "GreaterThan(t" in plan
    assert rows(db.sql("select k from ks1.times where k >= -9 and t in (1682899200000)")) == [(7,)]


def test_permissive_scans_and_swallowed_words(spark, tmp_path):
    from keyloom.errors import EngineError
    from keyloom.plans.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/permissive", strict=False)
    e.sql("create keyspace k")
    e.sql("create table k.t (a long, b long, v varchar, primary key (a))")
    e.sql("create table k.u (a long, b long, primary key (a))")
    e.sql("insert into k.t (a, b, v) values (1, 3, 'x'), (2, 1, 'y')")
    assert rows(e.sql("select a from k.t where v = 'x'")) == [(1,)]
    for bad in ("create index i on k.t (b desc)", "create table k.w (a long, v varchar not null, primary key (a))"):
        with pytest.raises(EngineError):
            e.sql(bad)
    e.sql("create index i on k.t (b)")
    e.sql("create index i on k.u (b)")
    with pytest.raises(EngineError):
        e.sql("drop index i")
    e.sql("drop index i on k.t")
    assert not e.meta("k.t").indexes and e.meta("k.u").indexes
    assert e.spark_sql("select 'k.t' as s, count(*) as n from k.t").first().asDict() == {"s": "k.t", "n": 2}
