import random

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.operators.changefeed import ChangeLog, apply_change_feed
from keyloom.operators.skewkeys import heavy_keys, key_totals, number_rows
from keyloom.operators.smallfiles import SegmentCompactor, bin_layout, first_fit_decreasing

FEED = "change_id long, k1 long, k2 long, tx long, gone boolean, payload string, RN int"


def feed(spark, data):
    return spark.createDataFrame(data, FEED).repartition(3)


def current(data):
    best = {}
    for c in sorted(data, key=lambda r: (r[0] is not None, r[0])):
        tx = -1 if c[3] is None else c[3]
        if (c[1], c[2]) not in best or tx > best[c[1], c[2]][0]:
            best[c[1], c[2]] = (tx, c)
    return sorted((c[1] if c[1] is not None else -1, c[2] if c[2] is not None else -1, c[3]) for _, c in best.values() if not c[4])


def random_feed(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = 7 if r.random() < 0.4 else r.randrange(40)
        out.append((i, key, r.randrange(3), r.randrange(n), r.random() < 0.2, f"p{i}", i))
    by_tx = {}
    for c in out:  # deliveries of one tx are one write
        by_tx.setdefault((c[1], c[2], c[3]), c[4])
    return [(c[0], c[1], c[2], c[3], by_tx[c[1], c[2], c[3]], c[5], c[6]) for c in out]


def found(df):
    return sorted((r.k1 if r.k1 is not None else -1, r.k2 if r.k2 is not None else -1, r.tx) for r in df.collect())


def test_feed_out_of_order_and_repeated(spark):
    data = random_feed(400, 1)
    data += [(1000 + i, *c[1:]) for i, c in enumerate(data[::5])]
    got = apply_change_feed(feed(spark, data), ["k1", "k2"], "tx", "gone", tie=["change_id"], batches=5, fan_in=2)
    assert found(got) == current(data)
    assert got.columns == [c.split()[0] for c in FEED.split(", ")]


def test_feed_nulls_and_ties(spark):
    data = [(0, None, 1, 5, False, None, None), (1, None, 1, 4, True, "x", 1), (2, 1, None, None, False, "n", 2), (3, 1, None, 0, None, "m", 3), (4, 2, 2, 9, False, "first", 4), (None, 2, 2, 9, False, "first", 4), (5, 3, 3, None, None, None, None)]
    got = apply_change_feed(feed(spark, data), ["k1", "k2"], "tx", "gone", tie=["change_id"], batches=2)
    assert found(got.where("tx is not null")) == [(-1, 1, 5), (1, -1, 0), (2, 2, 9)]
    assert got.where("tx is null").count() == 1


def test_feed_empty_and_reserved_name(spark):
    assert apply_change_feed(feed(spark, []), ["k1", "k2"], "tx", "gone", tie=["change_id"]).count() == 0
    log = ChangeLog(spark, ["k1"], "tx", "gone")
    with pytest.raises(ValueError):
        log.current()
    with pytest.raises(ValueError):
        log.append(feed(spark, []).withColumnRenamed("RN", "__run"))


def test_log_reopens_compacts_and_reads_without_exchange(spark):
    log = ChangeLog(spark, ["k1", "k2"], "tx", "gone", tie=["change_id"], fan_in=10)
    data = random_feed(300, 2)
    for i in range(3):
        log.append(feed(spark, data[i * 100 : (i + 1) * 100]))
    plan = log.current()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    again = ChangeLog(spark, ["k1", "k2"], "tx", "gone", tie=["change_id"], path=log.path)
    assert found(again.current()) == current(data)
    again.compact()
    assert len(again.state["runs"]) == 1 and found(again.current()) == current(data)
    again.append(feed(spark, [(999, 7, 0, 10_000, True, None, None)]))  # a late delete
    assert all((k1, k2) != (7, 0) for k1, k2, _ in found(again.current()))


def test_feed_leaves_no_table_and_reads_once(spark):
    before = {t.name for t in spark.catalog.listTables()}
    data = random_feed(200, 5)
    got = apply_change_feed(feed(spark, data).repartition(6), ["k1", "k2"], "tx", "gone", tie=["change_id"])
    assert {t.name for t in spark.catalog.listTables()} == before
    assert found(got) == current(data)


def test_compaction_purges_and_keeps_readers(spark):
    log = ChangeLog(spark, ["k1"], "tx", "gone", fan_in=10)
    rows_ = [(1, 1, 0, 1, False, "a", 1), (2, 2, 0, 2, True, None, 1), (3, 3, 0, 9, True, None, 1)]
    log.append(feed(spark, rows_[:2]))
    log.append(feed(spark, rows_[2:]))
    planned = log.current()
    log.compact(purge_below=5)
    assert [r.k1 for r in planned.collect()] == [1]  # planned before the compaction
    assert sorted(r.k1 for r in log.merged().collect()) == [1, 3]


KEYED = "t long, k long, s long, q long, n_rows string"


def keyed(spark, data):
    return spark.createDataFrame(data, KEYED).repartition(4)


def totals(data):
    out = {}
    for t, k, s, q, _ in data:
        e = out.setdefault((t, k), [0, set(), None])
        e[0] += 1
        if s is not None:
            e[1].add(s)
        if q is not None:
            e[2] = q if e[2] is None else max(e[2], q)
    return {kk: (n, len(ss), q) for kk, (n, ss, q) in out.items()}


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_key_totals(spark, chunk):
    r = random.Random(3)
    data = [(r.randrange(2), 5 if r.random() < 0.5 else r.randrange(20), r.randrange(9), r.randrange(1000), "x") for _ in range(500)]
    data += [(None, 1, None, None, None), (0, None, 2, 5, None), (0, None, None, 7, None), (0, 5, None, None, "y")]
    got = key_totals(keyed(spark, data), ["t", "k"], "s", "q", chunk_rows=chunk)
    assert {(r_.t, r_.k): (r_.n_rows, r_.n_sub_keys, r_.last_seq) for r_ in got.collect()} == totals(data)
    if chunk == 1:
        assert got.agg({"n_chunks": "max"}).first()[0] > 5
    heavy = {(r_.t, r_.k) for r_ in heavy_keys(got, 0.2).collect()}
    assert heavy == {kk for kk, v in totals(data).items() if v[0] >= 0.2 * len(data)}


def test_key_totals_empty(spark):
    got = key_totals(keyed(spark, []), ["t", "k"], "s", "q")
    assert got.count() == 0 and heavy_keys(got).count() == 0


def test_numbers_have_no_gaps(spark):
    out = number_rows(spark.range(1000).selectExpr("id % 17 as a", "id as b"), ["a", "b"]).orderBy("__rn").collect()
    assert [r["__rn"] for r in out] == list(range(1000))
    assert [(r.a, r.b) for r in out] == sorted((i % 17, i) for i in range(1000))


@given(st.lists(st.integers(1, 120), max_size=60), st.integers(50, 100))
@settings(max_examples=60, deadline=None)
def test_first_fit_decreasing(sizes, capacity):
    got = first_fit_decreasing(np.array(sizes, dtype=np.int64), capacity)
    bins, expected = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        need = min(sizes[i], capacity)
        at = next((b for b, room in enumerate(bins) if room >= need), None)
        if at is None:
            bins.append(capacity)
            at = len(bins) - 1
        bins[at] -= need
        expected[i] = at
    assert list(got) == [expected[i] for i in range(len(sizes))]


META = "segment_id long, meta_id long, table_id long, has_summary boolean, rows_count long"
ROWS = "segment_id long, idx long, pk long, tx_id long, created long, not_null_cols int, uud string, bin string"
VECS = "vec_id long, segment_id long, idx long, vec array<float>"


def test_compaction(spark):
    metas = spark.createDataFrame([(1, 10, 1, True, 3), (2, 10, 1, False, 0), (3, 30, 1, True, None), (4, 40, 2, True, 9), (5, 50, 2, None, 1), (6, 60, None, True, 1), (7, 70, 3, True, 0), (4, 40, 2, True, 9)], META)
    data = [(1, 0, 1, 1, 1, 3, "a", "b"), (1, 0, 1, 1, 1, 3, "a", "b"), (1, 1, 2, 2, 1, 0, None, None), (2, 5, 9, 9, 9, 1, "not valid", None), (3, 0, 3, 3, 1, 1, "c" * 500, None), (4, 0, 4, 4, 1, 1, "d", None), (4, None, 4, 4, 1, 1, None, None), (5, 0, 1, 1, 1, 1, "x", None), (6, 0, 6, None, None, None, None, None), (99, 0, 1, 1, 1, 1, "unlisted", None)]
    vecs = spark.createDataFrame([(1, 4, 100, [1.0, 2.0]), (2, 4, 101, None)], VECS)
    job = SegmentCompactor(spark, target_bytes=400)
    report = job.run(metas, spark.createDataFrame(data, ROWS), vecs)
    got = job.read()
    expected = [(10, 0), (10, 1), (30, 0), (40, -1), (40, 0), (40, 100), (40, 101), (60, 0)]
    assert sorted((r.meta_id, -1 if r.idx is None else r.idx) for r in got.collect()) == expected
    assert report.records == len(expected)
    assert got.select("bin").distinct().count() == report.bins
    assert all(r.n_tables <= 1 for r in bin_layout(got).collect())


def test_compaction_of_nothing(spark):
    job = SegmentCompactor(spark)
    with pytest.raises(RuntimeError):
        job.read()
    job.run(spark.createDataFrame([], META), spark.createDataFrame([], ROWS))
    assert job.read().count() == 0


def test_many_copies_of_one_segment(spark):
    metas = spark.createDataFrame([(i, 1, 1, i % 2 == 0, 1) for i in range(20)], META)
    data = [(i, j, j, 1, 1, 1, f"t{j}", None) for i in range(20) for j in range(10)]
    job = SegmentCompactor(spark)
    job.run(metas, spark.createDataFrame(data, ROWS))
    assert rows(job.read().select("meta_id", "idx")) == [(1, j) for j in range(10)]
