import numpy as np
import pytest

from pyspark.sql import functions as F

from keyloom.llm import markov
from keyloom.llm.graph import build_graph
from keyloom.llm.markov import ClusterParams, VectorClusters, markov_clusters, markov_flow, mutual, similarity_graph, thin_links
from keyloom.llm.neighbours import GraphParams, nearest_neighbours, neighbour_pairs, shard_by_pivots

SCHEMA = "vec_id long, table_id long, col_id int, dimension int, vec array<float>, g string, id int"


def frame(spark, groups):
    """groups: (table, column, array of vectors)"""
    data, n = [], 0
    for t, c, x in groups:
        for v in x:
            data.append((n, t, c, len(v), [float(e) for e in v], "x", 1))
            n += 1
    return data, spark.createDataFrame(data, SCHEMA)


def cosines(data):
    x = np.array([r[4] for r in data], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def brute_pairs(data, k):
    out = set()
    for g in {(r[1], r[2]) for r in data}:
        rows = [r for r in data if (r[1], r[2]) == g]
        s = np.round(cosines(rows), 6)
        for i, r in enumerate(rows):
            order = sorted((-s[i, j], rows[j][0]) for j in range(len(rows)) if j != i)[:k]
            out |= {(min(r[0], j), max(r[0], j)) for _, j in order}
    return out


def clustered(rng, n, d, groups=6, spread=0.05):
    centres = rng.standard_normal((groups, d))
    grouped = centres[rng.integers(0, groups, n // 2)] + spread * rng.standard_normal((n // 2, d))
    return np.vstack([grouped, rng.standard_normal((n - n // 2, d))])


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = clustered(rng, 3000, 24).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = build_graph(x, degree=24)
    assert ((g.graph < g.n).sum(axis=1) <= 36).all() and (g.graph != np.arange(g.n)[:, None]).all()
    ids, _ = g.search(x[:300], 48)
    truth = np.argsort(-(x[:300] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(ids, truth, strict=True)]) > 0.95


@pytest.mark.parametrize("rows", [100_000, 400])
def test_neighbours_against_brute_force(spark, rows):
    rng = np.random.default_rng(1)
    data, df = frame(spark, [(1, 1, clustered(rng, 900, 16)), (1, 2, clustered(rng, 60, 8)), (2, 1, rng.standard_normal((4, 4))), (3, 1, rng.standard_normal((1, 4)))])
    p = GraphParams(min_shard_rows=rows, max_shard_rows=rows, pivots_per_shard=8)
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(df.repartition(3), p)).collect()}
    truth = brute_pairs(data, 5)
    assert len(got & truth) / len(truth) > 0.97 and len(got & truth) / len(got) > 0.97


def test_repeated_unusable_and_scaled_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 6))
    data, _ = frame(spark, [(1, 1, np.vstack([x, np.repeat(x[:1], 8, axis=0), x[1:2], x[2:3] * 1000]))])
    bad = [(900, 1, 1, 6, None, "x", 1), (901, 1, 1, 6, [0.0] * 6, "x", 1), (902, 1, 1, 6, [1.0] * 5, "x", 1), (903, 1, 1, 6, [float("nan")] * 6, "x", 1), (904, 1, 1, 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", 1), (905, 1, 1, None, [1.0] * 6, "x", 1)]
    got = nearest_neighbours(spark.createDataFrame(data + bad, SCHEMA))
    assert {tuple(r) for r in neighbour_pairs(got).collect()} == brute_pairs(data, 5)
    assert got.where("q >= 900 or c >= 900").count() == 0
    assert got.where("q = 30").orderBy("rnk").first().c == 0  # a copy of the first
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_cliques(data, threshold=0.9):
    out = set()
    for g in {(r[1], r[2]) for r in data}:
        rows = [r for r in data if (r[1], r[2]) == g]
        close = cosines(rows) >= threshold
        left = set(range(len(rows)))
        while left:
            todo, comp = [left.pop()], set()
            while todo:
                i = todo.pop()
                comp.add(i)
                for j in np.flatnonzero(close[i]):
                    if j in left:
                        left.remove(j)
                        todo.append(j)
            m = sorted(comp)
            if len(m) >= 3 and close[np.ix_(m, m)].all():
                ids = sorted(rows[i][0] for i in m)
                out |= {(ids[0], i) for i in ids[1:]}
    return out


def chain(d, degrees):
    """Unit vectors in one plane at the given angles."""
    out = np.zeros((len(degrees), d))
    out[:, 0], out[:, 1] = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    return out


def test_clusters_against_brute_force(spark):
    rng = np.random.default_rng(3)
    d = 24
    wide = np.zeros((40, d))  # a clique whose members are near the threshold
    wide[:, 2] = 1
    wide[np.arange(40) , 3 + np.arange(40) % 20] = 0.3
    groups = [rng.standard_normal(d) * 3 + 0.02 * rng.standard_normal((n, d)) for n in (3, 4, 50, 200, 2)]
    x = np.vstack([*groups, rng.standard_normal((150, d)), chain(d, [0, 20, 40]), wide])
    data, df = frame(spark, [(1, 1, x * rng.uniform(0.1, 10, (len(x), 1))), (2, 1, np.vstack([x[:7], x[:3]]))])
    c = VectorClusters(df.repartition(3), ClusterParams(bucket_rows=64))
    got = {tuple(r) for r in c.mutual_members().collect()}
    assert got == brute_cliques(data)
    sizes = {(r.g, r.first_id): r for r in c.summary().collect()}
    big = next(r for r in sizes.values() if r["size"] == 200)
    assert len(big.typical) == 3 and set(big.typical) <= set(range(57, 257))


def test_repeated_vectors_are_members(spark):
    data, df = frame(spark, [(1, 1, [[1, 2, 3, 4]] * 5 + [[4, -3, 2, -1]] * 2 + [[9, 9, -9, 1]])])
    c = VectorClusters(df)
    assert {tuple(r) for r in c.mutual_members().collect()} == {(0, i) for i in range(1, 5)} == brute_cliques(data)
    assert {(r.first_id, r["size"]) for r in c.summary().collect()} == {(0, 5), (5, 2)}


def test_clusters_of_nothing(spark):
    c = VectorClusters(spark.createDataFrame([], SCHEMA))
    assert c.mutual_members().count() == 0 and c.summary().count() == 0


def test_mutual_checks_blocks(spark):
    rng = np.random.default_rng(4)
    good = np.array([1, 0, 0, 0]) + 0.05 * rng.standard_normal((50, 4))
    arc = chain(4, list(range(0, 24)))  # all within 23 degrees, far from the centre
    bad = chain(4, list(range(0, 30)))
    data = [(label, i, [float(v) for v in x]) for label, xs in ((1, good), (2, arc), (3, bad)) for i, x in enumerate(xs)]
    df = spark.createDataFrame(data, "label long, id long, vec array<float>")
    assert sorted(r.label for r in mutual(df, ClusterParams(block_rows=7)).collect()) == [1, 2]


def test_summary_reports_markov_clusters(spark):
    """A chain is one component but no cluster of similar vectors."""
    data, df = frame(spark, [(1, 1, chain(4, list(range(0, 340, 20)))), (2, 1, chain(4, [0, 1, 2]))])
    found = VectorClusters(df).summary().collect()
    assert sum(r["size"] for r in found) == len(data)
    in_chain = [r for r in found if r.g.startswith("1/")]
    assert len(in_chain) > 1 and max(r["size"] for r in in_chain) < 9
    assert [(r["size"], r.mutual) for r in found if r.g.startswith("2/")] == [(3, True)]
    assert all(not r.mutual for r in in_chain if r["size"] > 2)


def test_markov_decides_the_members(spark, monkeypatch):
    """Two cliques under one link: the flow splits the component, and neither is closed; with
    labels that the flow did not give, nothing is found."""
    rng = np.random.default_rng(10)
    d = 16
    apart = [np.eye(d)[k] * 3 + 0.02 * rng.standard_normal((6, d)) for k in (0, 1, 2)]
    bridge = np.zeros((2, d))  # at 20 and 40 degrees from clique 0
    bridge[:, 0], bridge[:, 5] = np.cos(np.radians([20, 40])), np.sin(np.radians([20, 40]))
    x = np.vstack([*apart, bridge])
    data, df = frame(spark, [(1, 1, x)])
    c = VectorClusters(df)
    got = {tuple(r) for r in c.mutual_members().collect()}
    assert got == brute_cliques(data) == {(6, i) for i in range(7, 12)} | {(12, i) for i in range(13, 18)}
    assert c.rounds[-1]["chaos"] < c.p.chaos and all(0 <= r["most_cut"] < 1 for r in c.rounds)
    monkeypatch.setattr(markov, "markov_clusters", lambda flow: markov.attractors(flow).withColumn("label", F.col("id")))
    assert VectorClusters(df).mutual_members().count() == 0


def test_hub_rows_are_split(spark):
    links = [(0, 1 + i, 0.95) for i in range(300)]
    graph = spark.createDataFrame(links, "a long, b long, sim double")
    whole = {tuple(r) for r in markov_clusters(markov_flow(graph, ClusterParams())).collect()}
    split = {tuple(r) for r in markov_clusters(markov_flow(graph, ClusterParams(hot_row=20))).collect()}
    assert whole == split == {(i, 0) for i in range(301)}


def test_flow_runs_until_it_converges(spark):
    """Two cliques of six with one link between them, and a star."""
    links = [(a + i, a + j, 0.95) for a in (0, 6) for i in range(6) for j in range(i + 1, 6)] + [(5, 6, 0.91)] + [(20, 21 + i, 0.95) for i in range(10)]
    graph = spark.createDataFrame(links, "a long, b long, sim double")
    clusters = {}
    for r in markov_clusters(markov_flow(graph, ClusterParams())).collect():
        clusters.setdefault(r.label, set()).add(r.id)
    assert sorted(map(sorted, clusters.values())) == [list(range(6)), list(range(6, 12)), list(range(20, 31))]
    with pytest.raises(RuntimeError):
        markov_flow(graph, ClusterParams(max_rounds=1))


@pytest.mark.parametrize("n", [100, 36_000, 250_000, 600_000, 50_000_000])
def test_miss_rate_holds_at_every_size(n):
    p = ClusterParams()
    bits, tables = p.signature(n)
    assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 1e-3 + 1e-12


@pytest.mark.parametrize("block_rows", [50, 2000])
def test_every_pair_of_a_bucket_is_compared(spark, block_rows):
    """Vectors about one mean direction share most buckets; scaled copies are far apart in
    the order of ids, so one table splits them over blocks and tasks."""
    rng = np.random.default_rng(5)
    d, n = 64, 1500
    noise = rng.standard_normal((n, d))
    base = np.eye(d)[0] + 0.6 * noise / np.linalg.norm(noise, axis=1)[:, None]
    data, _ = frame(spark, [(1, 1, np.vstack([base, 2 * base]))])
    df = spark.createDataFrame([("a", r[0], r[4]) for r in data], "g string, id long, vec array<float>")
    p = ClusterParams(block_rows=block_rows, bucket_rows=10_000)
    got = {(r.a, r.b) for r in similarity_graph(df.repartition(3), p).collect()}
    assert got == {(i, n + i) for i in range(n)}


def full_markov(data, p):
    """The clusters of a flow over all similar pairs, from which nothing is pruned."""
    s = cosines(data)
    m = np.where(s >= p.threshold - 1e-12, s, 0)
    for n in range(30):
        m = m / m.sum(axis=0)
        m = (m @ m) ** (p.inflation if n < p.mixing else p.sharpening)
    out = {}
    for j, i in enumerate((m / m.sum(axis=0)).round(6).argmax(axis=0)):
        out.setdefault(i, set()).add(data[j][0])
    return {frozenset(c) for c in out.values()}


def hubs(rng, d=12):
    """Three dense groups about 30 degrees apart, some of whose members are similar."""
    centres = np.zeros((3, d))
    centres[:, 0], centres[[0, 1, 2], [1, 2, 3]] = np.cos(0.36), np.sin(0.36)
    return np.vstack([c + 0.045 * rng.standard_normal((n, d)) for c, n in zip(centres, (60, 45, 30), strict=True)])


def test_no_similar_pair_is_left_out(spark):
    """Tight groups, where links that only connect are far fewer than the pairs, and pairs at 0.9
    exactly, which single precision puts below."""
    rng = np.random.default_rng(12)
    d = 40
    tight = [rng.standard_normal(d) + 0.02 * rng.standard_normal((n, d)) for n in (150, 40, 9)]
    at = np.zeros((6, d))
    at[::2, 0], at[1::2, 0] = 10, 9
    at[1, 1:20] = at[3, 3:22] = at[5, 5:24] = 1
    x = np.vstack([*tight, rng.standard_normal((100, d)), at * [[1], [3], [1.7], [7], [0.3], [1]]])
    data, _ = frame(spark, [(1, 1, x)])
    df = spark.createDataFrame([("a", r[0], r[4]) for r in data], "g string, id long, vec array<float>")
    close = np.triu(cosines(data) >= 0.9 - 1e-12, 1)
    truth = {(int(i), int(j)) for i, j in zip(*np.nonzero(close), strict=True)}
    for rows in (37, 2000):
        p = ClusterParams(block_rows=rows, bucket_rows=50)
        got = similarity_graph(df.repartition(3), p)
        assert {(r.a, r.b) for r in got.collect()} == truth and got.count() == len(truth)


def test_attractors_that_lead_on(spark):
    """1 leads to 2, 2 to 3, which stays: an end although the smaller id comes first."""
    flow = spark.createDataFrame([(2, 1, 1.0), (3, 2, 1.0), (3, 3, 1.0), (9, 8, 1.0), (8, 9, 1.0)], "i long, j long, v double")
    assert {tuple(r) for r in markov_clusters(flow).collect()} == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}


@pytest.mark.parametrize("rows", [3000, 50])
def test_every_pair_takes_part_in_the_flow(spark, rows):
    """As one matrix, and in sets of columns."""
    rng = np.random.default_rng(13)
    data, df = frame(spark, [(1, 1, np.vstack([hubs(rng), rng.standard_normal((20, 12))]))])
    sets = {}
    for r in VectorClusters(df, ClusterParams(dense_rows=rows)).labels.collect():
        sets.setdefault(r.label, set()).add(r.id)
    assert {frozenset(c) for c in sets.values()} == {c for c in full_markov(data, ClusterParams()) if len(c) > 1}


def test_thin_links_connect_what_the_pairs_connect():
    rng = np.random.default_rng(6)

    def parts(n, links):
        c = list(range(n))
        for i, j in links:
            x, y = c[i], c[j]
            c = [y if v == x else v for v in c]
        return {frozenset(k for k in range(n) if c[k] == v) for v in c}

    for same in (True, False):
        for share in (0.01, 0.03, 0.3):
            close = rng.random((60, 60)) < share
            if same:
                close |= close.T | np.eye(60, dtype=bool)
            i, j = thin_links(close, same, 2)
            shift = 0 if same else 60
            assert close[i, j].all() and parts(120, zip(i, j + shift)) == parts(120, zip(*(np.nonzero(close)[0], np.nonzero(close)[1] + shift)))
    assert len(thin_links(np.ones((500, 500), dtype=bool), True, 16)[0]) <= 1000
    assert len(thin_links(np.ones((500, 400), dtype=bool), False, 16)[0]) <= 1000


@pytest.mark.parametrize("rows", [100_000, 300])
def test_ties_go_to_the_smaller_ids(spark, rows):
    """Scaled copies and a tight group, larger than what was ranked, and larger than a beam."""
    rng = np.random.default_rng(7)
    one, two, three = rng.standard_normal((3, 12))
    scaled = one * rng.uniform(0.1, 10, (40, 1))
    many = two * rng.uniform(0.1, 10, (250, 1))
    tight = three + 1e-5 * rng.standard_normal((60, 12))
    x = np.vstack([scaled, many, tight, rng.standard_normal((250, 12))])
    data, df = frame(spark, [(1, 1, x[rng.permutation(len(x))])])
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(df, GraphParams(min_shard_rows=rows, max_shard_rows=rows))).collect()}
    truth = brute_pairs(data, 5)
    tied = {r[0] for r, c in zip(data, (np.round(cosines(data), 6) == 1).sum(axis=1), strict=True) if c > 6}
    assert len(tied) > 300
    assert {p for p in truth if tied & set(p)} == {p for p in got if tied & set(p)}


def test_vectors_of_a_cut_cell_search_widely(spark):
    """A tight group larger than a shard, beside smaller ones: its vectors search every shard
    of the cut, however few probes there are."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.standard_normal(8) + 0.01 * rng.standard_normal((m, 8)) for m in (900, 100, 100)])
    df = spark.createDataFrame([("a", i, [float(v) for v in r]) for i, r in enumerate(x)], "g string, id long, vec array<float>")
    p = GraphParams(min_shard_rows=200, max_shard_rows=200, pivots_per_shard=1, min_probes=1)
    placed, loads = shard_by_pivots(df, p)
    cells = {r.id: r for r in placed.collect()}
    assert len(loads) == 6 and len(cells) == len(x)
    cut = {cells[i].shard for i in range(900)}
    assert len(cut) >= 5
    for i in range(900):
        assert cells[i].shard not in cells[i].far and len(set(cells[i].far)) == len(cells[i].far)
    assert max(len(cells[i].far) for i in range(900)) >= 3 and all(set(cells[i].far) <= set(range(6)) for i in range(len(x)))


def test_probes_grow_slower_than_the_shards():
    p = GraphParams()
    assert [p.probes(s) for s in (1, 8, 16, 64, 10_000)] == [1, 8, 8, 16, 200]


def test_routed_neighbours_of_grouped_vectors(spark):
    """With fewer probes than shards, near neighbours are found all the same."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 2000)] + 0.1 * rng.standard_normal((2000, 16))
    data, df = frame(spark, [(1, 1, x)])
    p = GraphParams(min_shard_rows=125, max_shard_rows=125, pivots_per_shard=8, min_probes=4, part_queries=1)
    got = {tuple(r) for r in neighbour_pairs(nearest_neighbours(df, p)).collect()}
    truth = brute_pairs(data, 5)
    assert len(got & truth) / len(truth) > 0.95
