import random
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm.seen import EliasFano, KeyMemory, SeenSet, error_rate, seen_before

NAMES = ("arrival_id", "table_id", "primary_key", "key_vector")
SCHEMA = "arrival_id long, table_id long, primary_key long, key_vector array<long>, h string, a int"


@given(st.lists(st.integers(0, 2**20 - 1), unique=True, max_size=300), st.lists(st.integers(0, 2**20 - 1), max_size=50), st.sampled_from([20, 33, 63]))
@settings(max_examples=80, deadline=None)
def test_elias_fano(values, probes, bits):
    v = np.array(sorted(values), dtype=np.uint64)
    ef = EliasFano(v, bits)
    assert (ef.values() == v).all()
    p = np.array(sorted({*probes, *values[:20]}), dtype=np.uint64)
    assert list(ef.contains(p)) == [int(x) in set(values) for x in p]
    if len(v):
        assert list(ef.successor(p)) == list(np.searchsorted(v, p))


def test_elias_fano_is_small():
    v = np.unique(np.random.default_rng(0).integers(0, 2**56, 50_000, dtype=np.uint64))
    assert EliasFano(v, 56).nbytes() * 8 / len(v) < 2 + 1 + 56 - np.log2(len(v)) + 1


def test_seen_set_merges():
    s, known = SeenSet(62), set()
    rng = np.random.default_rng(1)
    for _ in range(12):
        batch = np.unique(rng.integers(0, 60_000, 9_000, dtype=np.uint64))
        hit = s.contains(batch)
        assert list(hit) == [int(x) in known for x in batch]
        s.add(batch[~hit])
        known |= {int(x) for x in batch}
    assert s.main.n > 0


def brute(data):
    seen, out = {}, []
    for r in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0)):
        key = tuple(r[3]) if r[3] is not None else (r[2],) if r[2] is not None else None
        if key is None:
            continue
        first = seen.setdefault((r[1], key), r[0])
        if first != r[0]:
            out.append(r[0])
    return sorted(out)


def answers(df):
    return sorted(r[0] for r in seen_before(df, *NAMES).collect())


def test_against_brute_force(spark):
    r = random.Random(5)
    data = []
    for i in range(3000):
        pk = 3 if r.random() < 0.35 else r.randrange(800)
        vec = None if r.random() < 0.2 else [pk] + [r.randrange(3) for _ in range(r.randrange(3))]
        data.append((i * 3, r.randrange(2), None if vec and r.random() < 0.1 else pk, vec, "x", 1))
    r.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert answers(df) == brute(data)
    rate = error_rate(df, seen_before(df, *NAMES), *NAMES).first()
    assert (rate.n_records, rate.n_seen, rate.n_wrong, rate.wrong_rate) == (3000, len(brute(data)), 0, 0.0)


def test_nulls_ties_and_order(spark):
    data = [
        (1, 1, 5, None, None, None), (2, 1, None, [5], None, None), (3, 2, 5, None, None, None), (4, None, 5, None, None, None), (5, None, 5, [5], None, None), (6, 1, None, None, None, None), (7, 1, None, None, None, None),
        (8, 1, 5, [5, None], None, None), (9, 1, 5, [5, None], None, None), (10, 1, 5, [None, 5], None, None), (11, 1, -1, [], None, None), (12, 1, -2, [], None, None), (20, 3, 1, None, None, None), (20, 3, 1, None, None, None),
    ]
    assert answers(spark.createDataFrame(data, SCHEMA).coalesce(1)) == [2, 5, 9, 12]
    assert answers(spark.createDataFrame(data, SCHEMA).repartition(7)) == [2, 5, 9, 12]
    late = spark.createDataFrame([(None, 1, 5, None, None, None), (1, 1, 5, None, None, None)], SCHEMA)
    assert answers(late) == [1]
    assert answers(spark.createDataFrame([], SCHEMA)) == []


def test_probes_decode_only_what_they_touch():
    rng = np.random.default_rng(2)
    v = np.unique(rng.integers(0, 2**60, 1_000_000, dtype=np.uint64))
    ef = EliasFano(v, 60)
    again = EliasFano.stored(ef.n, ef.bits, ef.unary.tobytes(), ef.words.tobytes())
    p = np.sort(np.concatenate([v[::200], rng.integers(0, 2**60, 5_000, dtype=np.uint64)]))
    tracemalloc.start()
    hit = again.contains(p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (hit == np.isin(p, v)).all()
    assert peak + again.nbytes() < 8 * len(v)


def test_memory_answers_the_next_batch_without_the_first(spark):
    r = random.Random(6)
    data = [(i, r.randrange(2), r.randrange(300), None if r.random() < 0.5 else [r.randrange(300), r.randrange(2)], "x", 1) for i in range(1500)]
    memory = KeyMemory(spark, part_bits=4)
    got = []
    for s in (0, 600, 600, 1200):  # the second batch is empty
        e = {0: 600, 1200: 1500}.get(s, 600 if len(got) == 1 else 1200)
        batch = spark.createDataFrame(data[s:e], SCHEMA).repartition(3)
        got.append(sorted(x[0] for x in memory.observe(batch, *NAMES).collect()))
        memory = KeyMemory(spark, memory.path)  # reopened
    assert got[1] == [] and sorted(sum(got, [])) == brute(data)
    assert memory.n_keys() == 1500 - len(brute(data))
