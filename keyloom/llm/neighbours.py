"""Problem 6: the k most similar vectors of every vector.

The usable vectors of a column are cut into shards of 16,000 to 96,000 rows; each shard gets
a robust-pruned directed graph (:mod:`keyloom.llm.graph`). Every vector searches the graph of
its own shard, starting from itself, and by beam search the graphs of the shards that hold the
pivots nearest to it, except those that by the triangle inequality cannot hold anything nearer
than the k found at home. The beams are re-ranked by the exact cosine in double precision.

Shards follow similarity: vectors go to the nearest of a bounded sample of pivots
(``pivots_per_shard`` per shard, ``max_pivots`` at most), and the pivots' cells are packed into
shards of equal size; a cell larger than a shard is cut by hash, and its vectors search all
shards of the cut. Every vector is indexed; the sample only decides where.

Cost: a column of S shards is searched in ``probes(S)`` shards per vector: all up to
``min_probes``, beyond that in proportion to the square root of S. So up to ``min_probes``
shards (768,000 vectors at 96,000 a shard) nothing is left out but by the beams; in larger
columns a vector without near ones (in a random direction) may have neighbours in shards it
does not search. ``min_probes`` raises that at a proportional cost.

Defined results: a vector is usable if it is not null, has ``dimension`` elements, none of
them null, and a positive finite norm; others neither get nor are neighbours. Repeated vectors are
indexed once and expanded afterwards by their smallest ids. Similarity is rounded to 6
decimals; equal ones rank by smaller id. Columns with fewer than k + 1 vectors give fewer
neighbours, a single vector none. Where more candidates tie than a beam holds (scaled copies, very
tight groups), the vector is compared with its whole shard. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.graph import VectorGraph, build_graph
from keyloom.runtime import materialize


_MARGIN = 1e-5  # above what rounding to 6 decimals and single precision can change


@dataclass(frozen=True)
class GraphParams:
    k: int = 5
    degree: int = 20
    beam: int = 32
    alpha: float = 1.2
    min_shard_rows: int = 16_000
    max_shard_rows: int = 96_000
    min_probes: int = 8
    pivots_per_shard: int = 64
    max_pivots: int = 16_384
    part_queries: int = 4  # a task searches so many shards' worth of vectors, then a second one starts
    max_tasks: int = 10_000

    def shard_rows(self, n: int) -> int:
        """Rows of a shard of a column with n vectors. It grows with the square root of n, so
        building (one task a shard) and searching stay in balance."""
        return int(min(self.max_shard_rows, max(self.min_shard_rows, 120 * n**0.5)))

    def probes(self, shards: int) -> int:
        """Shards that a vector searches, its own included."""
        return min(shards, max(self.min_probes, 2 * math.isqrt(shards)))


def usable_vectors(df: DataFrame, vec_id: str = "vec_id", table: str = "table_id", column: str = "col_id", dimension: str = "dimension", vec: str = "vec") -> DataFrame:
    """(g, id, vec) of the usable vectors; g names the vector column and its dimension."""
    norm2 = F.aggregate(F.col("vec"), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    picked = df.select(F.concat_ws("/", F.coalesce(F.col(table).cast("string"), F.lit("-")), F.coalesce(F.col(column).cast("string"), F.lit("-")), F.col(dimension).cast("string")).alias("g"), F.col(vec_id).alias("id"), F.col(vec).alias("vec"), F.col(dimension).alias("d"))
    picked = picked.where((F.size("vec") == F.col("d")) & F.col("id").isNotNull())
    n2 = F.col("n2")
    return picked.withColumn("n2", norm2).where((n2 > 0) & (n2 < F.lit(float("inf"))) & ~F.isnan(n2)).select("g", "id", "vec")


def unique_vectors(usable: DataFrame) -> DataFrame:
    """(g, id, vec, copies): one representative per distinct vector, its smallest id."""
    return usable.groupBy("g", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select("g", "id", "vec", "copies")


def copy_members(usable: DataFrame, reps: DataFrame, hot: float = 1e-4) -> DataFrame:
    """(g, rep, id) of the vectors that occur more than once. A vector that makes up more than
    the share ``hot`` of all rows is found by broadcast (at most 1 / ``hot`` of them), so no
    join key is heavy."""
    repeated = reps.where("copies > 1").select("g", "vec", F.col("id").alias("rep"), "copies")
    most = max(1000, int((reps.agg(F.sum("copies")).first()[0] or 0) * hot))
    heavy, light = repeated.where(F.col("copies") > most).drop("copies"), repeated.where(F.col("copies") <= most).drop("copies")
    by_heavy = usable.join(F.broadcast(heavy), ["g", "vec"], "left")
    found = by_heavy.where("rep IS NOT NULL").select("g", "rep", "id")
    rest = by_heavy.where("rep IS NULL").select("g", "vec", "id").join(light, ["g", "vec"]).select("g", "rep", "id")
    return found.unionByName(rest)


def _unit(rows: np.ndarray) -> np.ndarray:
    wide = rows.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1)[:, None]).astype(np.float32)


def vector_rows(column: pa.Array) -> np.ndarray:
    """The vectors of an Arrow list column, all of one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_column(b: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, pa.RecordBatch]]:
    """(g, places, rows) of each vector column in a batch."""
    codes = b.column("g").dictionary_encode()
    index = codes.indices.to_numpy()
    for i, g in enumerate(codes.dictionary.to_pylist()):
        at = np.flatnonzero(index == i)
        yield g, at, b if len(at) == len(index) else b.take(pa.array(at))


# -- shards --------------------------------------------------------------------------------
@dataclass
class Column:
    """How one vector column is cut: pivots, and the shards that hold a part of a pivot's cell."""

    pivots: np.ndarray
    cells: np.ndarray  # per entry: the pivot; entries are sorted by shard
    shards: np.ndarray  # per entry: the shard
    first: np.ndarray  # pivot -> its entries, in order of the parts
    parts: np.ndarray  # pivot -> number of parts
    by_part: np.ndarray  # entries ordered by (pivot, part)
    lowest: np.ndarray  # pivot -> least similarity of a member of its cell
    probes: int


def _nearest_cell(unit: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each vector and the similarity to it."""
    out = []
    for s in range(0, len(unit), 2048):
        sims = unit[s : s + 2048] @ pivots.T
        cell = sims.argmax(axis=1)
        out.append((cell, sims[np.arange(len(cell)), cell]))
    return np.concatenate([c for c, _ in out]), np.concatenate([v for _, v in out])


def _count_cells(pivots):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, _, rows in _by_column(b):
                if g in pivots.value:
                    of, sim = _nearest_cell(_unit(vector_rows(rows.column("vec"))), pivots.value[g])
                    cell, n = np.unique(of, return_counts=True)
                    low = np.full(len(pivots.value[g]), 2.0)
                    np.minimum.at(low, of, sim)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(low[cell])], names=["g", "cell", "n", "low"])

    return count


def _mix(ids: np.ndarray) -> np.ndarray:
    """A hash of ids for cutting a cell (the finaliser of a 64-bit mixer)."""
    h = ids.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _place(plan):
    """(g, id, vec, shard, far, bound): the home shard, the others to search, and the largest
    similarity that a vector of each of those can have."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, _, rows in _by_column(b):
                known = plan.value[g]
                n = rows.num_rows
                if isinstance(known, int):
                    none = np.zeros(n + 1, np.int32)
                    shard, far, bound = np.full(n, known, np.int32), pa.ListArray.from_arrays(none, pa.array([], pa.int32())), pa.ListArray.from_arrays(none, pa.array([], pa.float32()))
                else:
                    shard, far, bound = _routes(_unit(vector_rows(rows.column("vec"))), rows.column("id").to_numpy(), known)
                yield pa.RecordBatch.from_arrays([rows.column("g"), rows.column("id"), rows.column("vec"), pa.array(shard), far, bound], names=["g", "id", "vec", "shard", "far", "bound"])

    return place


def _routes(unit: np.ndarray, ids: np.ndarray, c: Column) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Home shard, other shards and bounds. A member of a cell of angular radius r is within
    r of the pivot, so it is at least angle(vector, pivot) - r from the vector."""
    numbers, starts = np.unique(c.shards, return_index=True)
    cos_r = np.clip(c.lowest, -1.0, 1.0).astype(np.float32)
    sin_r = np.sqrt(1 - cos_r**2)
    home, lists, tops, lengths = np.empty(len(unit), np.int32), [], [], np.empty(len(unit), np.int32)
    for s in range(0, len(unit), 1024):
        sims = np.clip(unit[s : s + 1024] @ c.pivots.T, -1.0, 1.0)
        cell = sims.argmax(axis=1)
        part = (_mix(ids[s : s + 1024]) % c.parts[cell].astype(np.uint64)).astype(np.int64)
        own = c.shards[c.by_part[c.first[cell] + part]]
        home[s : s + 1024] = own
        best = np.maximum.reduceat(sims[:, c.cells], starts, axis=1)  # nearest pivot of each shard
        reach = np.where(sims >= cos_r, np.float32(1), sims * cos_r + np.sqrt(1 - sims**2) * sin_r)
        top = np.maximum.reduceat(reach[:, c.cells], starts, axis=1)
        order = np.argsort(-best, axis=1, kind="stable")
        wanted = np.maximum(c.probes, c.parts[cell])[:, None] > np.arange(len(numbers))[None, :]
        chosen = numbers[order]
        wanted &= chosen != own[:, None]
        lists.append(chosen[wanted])
        tops.append(np.take_along_axis(top, order, 1)[wanted])
        lengths[s : s + 1024] = wanted.sum(axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return home, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists).astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(tops).astype(np.float32)))


def shard_by_pivots(vectors: DataFrame, p: GraphParams) -> tuple[DataFrame, list[int]]:
    """(g, id, vec, shard, far, bound) with shards of about ``shard_rows`` rows, the other shards
    each vector may search and their bounds; and the number of vectors of each shard."""
    spark = vectors.sparkSession
    sizes = {r.g: r["count"] for r in vectors.groupBy("g").count().collect()}  # one row per vector column
    pivots: dict[str, np.ndarray] = {}
    for g, n in sizes.items():
        rows_each = p.shard_rows(n)
        if n <= rows_each:
            continue
        wanted = min(p.max_pivots, p.pivots_per_shard * -(-n // rows_each))
        every = max(1, n // wanted)
        rows = vectors.where((F.col("g") == g) & (F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).orderBy(F.xxhash64("id")).limit(wanted).select("vec").collect()  # at most max_pivots
        pivots[g] = _unit(np.array([r.vec for r in rows], dtype=np.float32))
    cells: dict[str, dict[int, tuple[int, float]]] = {g: {} for g in sizes}
    if pivots:
        counted = vectors.select("g", "vec").mapInArrow(_count_cells(spark.sparkContext.broadcast(pivots)), "g string, cell int, n bigint, low double")
        for r in counted.groupBy("g", "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low")).collect():  # at most max_pivots a column
            cells[r.g][r.cell] = (r.n, r.low)
    plan: dict[str, int | Column] = {}
    loads: list[int] = []
    for g in sorted(sizes):
        first_shard = len(loads)
        if g not in pivots:
            plan[g] = first_shard
            loads.append(sizes[g])
            continue
        rows_each = p.shard_rows(sizes[g])
        n_shards = -(-sizes[g] // rows_each)
        load = [0] * n_shards
        entries = []  # (pivot, part, shard)
        for n, cell in sorted(((n, cell) for cell, (n, _) in cells[g].items()), reverse=True):
            parts = -(-n // rows_each)
            for part in range(parts):
                lightest = min(range(n_shards), key=load.__getitem__)
                load[lightest] += n // parts
                entries.append((cell, part, first_shard + lightest))
        entries.sort(key=lambda e: e[2])
        cell, part, shard = (np.array(x) for x in zip(*entries, strict=True))
        by_part = np.lexsort((part, cell))
        parts = np.zeros(len(pivots[g]), dtype=np.int64)
        np.add.at(parts, cell, 1)
        first = np.concatenate([[0], np.cumsum(parts)[:-1]])
        lowest = np.ones(len(pivots[g]))
        for member, (_, low) in cells[g].items():
            lowest[member] = low - _MARGIN
        plan[g] = Column(pivots[g], cell, shard, first, np.maximum(parts, 1), by_part, lowest, p.probes(n_shards))
        loads.extend(load)
    placed = vectors.select("g", "id", "vec").mapInArrow(_place(spark.sparkContext.broadcast(plan)), "g string, id bigint, vec array<float>, shard int, far array<int>, bound array<float>")
    return placed, loads


# -- ranking -------------------------------------------------------------------------------
def _rounded_top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates by rounded double-precision cosine, then by id; missing: -1."""
    n = len(ids)
    wide = np.vstack([rows, np.zeros((1, rows.shape[1]), rows.dtype)]).astype(np.float64)
    norm = np.linalg.norm(wide, axis=1)
    norm[n] = 1.0
    q = queries.astype(np.float64)
    q_norm = np.linalg.norm(q, axis=1)
    out_ids = np.full((len(q), k), -1, dtype=np.int64)
    out_sims = np.full((len(q), k), -2.0)
    all_ids = np.append(ids, -1)
    for s in range(0, len(q), 256):
        c = cand[s : s + 256]
        dots = np.einsum("bkd,bd->bk", wide[c], q[s : s + 256])
        sims = np.round(dots / (norm[c] * q_norm[s : s + 256, None]), 6)
        cid = all_ids[c]
        sims[(c == n) | (cid == q_ids[s : s + 256, None])] = -2.0
        order = np.lexsort((cid, -sims), axis=1)[:, :k]
        m = order.shape[1]
        out_ids[s : s + 256, :m] = np.where(np.take_along_axis(sims, order, 1) > -2, np.take_along_axis(cid, order, 1), -1)
        out_sims[s : s + 256, :m] = np.take_along_axis(sims, order, 1)
    return out_ids, out_sims


def _scan_top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_rounded_top` with all rows, whose ids ascend, as candidates."""
    wide = rows.astype(np.float64)
    wide /= np.linalg.norm(wide, axis=1)[:, None]
    q = queries.astype(np.float64)
    q /= np.linalg.norm(q, axis=1)[:, None]
    out_ids = np.full((len(q), k), -1, dtype=np.int64)
    out_sims = np.full((len(q), k), -2.0)
    m = min(k, len(ids))
    for s in range(0, len(q), 64):
        sims = np.round(q[s : s + 64] @ wide.T, 6)
        sims[ids[None, :] == q_ids[s : s + 64, None]] = -2.0
        kth = -np.partition(-sims, m - 1, axis=1)[:, m - 1]
        for i, row in enumerate(sims):
            above = np.flatnonzero(row > kth[i])
            best = np.concatenate([above[np.argsort(-row[above], kind="stable")], np.flatnonzero(row == kth[i])[: m - len(above)]])
            out_ids[s + i, :m] = np.where(row[best] > -2, ids[best], -1)
            out_sims[s + i, :m] = row[best]
    return out_ids, out_sims


def _exact_top(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, cand: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by rounded double-precision cosine, then by id, of the beam ``cand`` with
    similarities ``near``, best first. All of the beam that may tie with the k-th is ranked; a
    query whose beam ends within such a tie is compared with all rows."""
    last = min(k, near.shape[1] - 1)  # the k-th if the query itself is in the beam
    ties = (near >= near[:, [last]] - _MARGIN) & (cand < len(ids))
    cut = ties[:, -1] & (near.shape[1] < len(ids))
    width = np.maximum(ties.sum(axis=1), min(k + 6, near.shape[1]))
    out_ids = np.full((len(queries), k), -1, dtype=np.int64)
    out_sims = np.full((len(queries), k), -2.0)
    few = k + 6
    for at, w in ((np.flatnonzero(~cut & (width <= few)), few), (np.flatnonzero(~cut & (width > few)), near.shape[1])):
        if len(at):
            out_ids[at], out_sims[at] = _rounded_top(queries[at], q_ids[at], rows, ids, cand[at, :w], k)
    at = np.flatnonzero(cut)
    if len(at):
        out_ids[at], out_sims[at] = _scan_top(queries[at], q_ids[at], rows, ids, k)
    return out_ids, out_sims


# -- building and searching ------------------------------------------------------------------
_INDEX = "g string, shard int, id bigint, vec array<float>, far array<int>, bound array<float>, edges array<int>, best array<bigint>, sims array<double>"


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(np.ascontiguousarray(matrix).ravel()))


def _entries(n: int, most: int = 512) -> np.ndarray:
    """Entry points of a stored graph: every n-th of its rows."""
    return np.arange(0, n, max(1, n // most), dtype=np.int32)


def _builder(p: GraphParams):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]  # one shard: at most about shard_rows rows
        if not parts:
            return
        t = pa.Table.from_batches(parts).combine_chunks().sort_by("id")
        ids = t["id"].to_numpy()
        rows = vector_rows(t["vec"].combine_chunks())
        unit = _unit(rows)
        g = build_graph(unit, degree=p.degree, beam=p.beam, alpha=p.alpha)
        cand, near = g.search(unit, p.beam, own=np.arange(len(ids), dtype=np.int32))
        best, sims = _exact_top(rows, ids, rows, ids, cand, near, p.k)
        out = pa.Table.from_arrays([t["g"], t["shard"], t["id"], t["vec"], t["far"], t["bound"], _lists(g.graph), _lists(best), _lists(sims)], names=["g", "shard", "id", "vec", "far", "bound", "edges", "best", "sims"])
        yield from out.to_batches(max_chunksize=10_000)

    return build


def build_index(reps: DataFrame, p: GraphParams) -> tuple[DataFrame, list[int]]:
    """One row per vector: its shard, edges, neighbours found at home and other shards to
    search; and the number of vectors of each shard."""
    placed, loads = shard_by_pivots(reps, p)
    # one task a shard, whatever the hash of its number
    built = placed.repartitionById(max(1, len(loads)), "shard").mapInArrow(_builder(p), _INDEX)
    return materialize(built, "graphs"), loads


def _searcher(p: GraphParams):
    """Rows come sorted by (task, points before queries): points of a shard, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, points, graph = None, [], None

        def answer(rows: pa.RecordBatch) -> pa.RecordBatch:
            q_ids, q_rows = rows.column("id").to_numpy(), vector_rows(rows.column("vec"))
            cand, near = graph[0].search(_unit(q_rows), p.beam)
            best, sims = _exact_top(q_rows, q_ids, graph[2], graph[1], cand, near, p.k)
            ok = best >= 0
            g = pa.DictionaryArray.from_arrays(pa.array(np.zeros(int(ok.sum()), np.int32)), pa.array([rows.column("g")[0].as_py()])).cast(pa.string())
            return pa.RecordBatch.from_arrays([g, pa.array(np.repeat(q_ids, ok.sum(axis=1))), pa.array(best[ok]), pa.array(sims[ok])], names=["g", "q", "c", "sim"])

        for b in batches:
            tasks, query = b.column("task").to_numpy(), b.column("query").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((tasks[1:] != tasks[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), len(tasks)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if tasks[s] != task:
                    task, points, graph = tasks[s], [], None
                if not query[s]:
                    points.append(b.slice(s, e - s))
                    continue
                if graph is None:
                    t = pa.Table.from_batches(points).combine_chunks().sort_by("id")  # the order of the build
                    vecs = vector_rows(t["vec"].combine_chunks())
                    unit = _unit(vecs)
                    graph = VectorGraph(unit, vector_rows(t["edges"].combine_chunks()), _entries(len(unit))), t["id"].to_numpy(), vecs
                    points = []
                yield answer(b.slice(s, e - s))

    return run


def search_index(index: DataFrame, loads: list[int], p: GraphParams) -> DataFrame:
    """(g, q, c, sim): the neighbours of every vector found at home and in the other shards it
    is sent to."""
    found = F.arrays_zip(F.col("best").alias("c"), F.col("sims").alias("sim"))
    home = index.select("g", F.col("id").alias("q"), F.inline(found)).where("c >= 0")
    spark = index.sparkSession
    # a shard whose nearest possible vector is farther than the k-th at home is not searched
    worst = F.element_at("sims", -1) - F.lit(_MARGIN)
    open_ = F.transform(F.filter(F.arrays_zip("far", "bound"), lambda x: x["bound"] >= worst), lambda x: x["far"])
    sent = index.select("g", "id", "vec", F.explode(open_).alias("shard"))
    arriving = {r.shard: r["count"] for r in sent.groupBy("shard").count().collect()}  # one row per shard
    if not arriving:
        return home
    rows, first = [], 0
    for shard, n in sorted(arriving.items()):
        parts = max(1, round(n / (p.part_queries * max(1, loads[shard]))))
        rows.append((shard, first, parts))
        first += parts
    tasks = F.broadcast(spark.createDataFrame(rows, "shard int, first int, parts int"))  # one row per shard
    queries = sent.join(tasks, "shard").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("task"), F.lit(True).alias("query"), "g", "id", "vec", F.lit(None).cast("array<int>").alias("edges"))
    # a shard's points go to each of its tasks, one task for part_queries times as many queries
    points = index.join(tasks, "shard").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("task"), F.lit(False).alias("query"), "g", "id", "vec", "edges")
    n_tasks = min(first, p.max_tasks)
    met = points.unionByName(queries).withColumn("at", F.pmod("task", F.lit(n_tasks)))
    far = met.repartitionById(n_tasks, "at").drop("at").sortWithinPartitions("task", "query").mapInArrow(_searcher(p), "g string, q bigint, c bigint, sim double")
    return home.unionByName(far)


def rank(candidates: DataFrame, k: int) -> DataFrame:
    """The k best of every query; equal candidates count once."""
    w = Window.partitionBy("g", "q").orderBy(F.col("sim").desc(), "c")
    return candidates.withColumn("rnk", F.dense_rank().over(w)).where(F.col("rnk") <= k).select("g", "q", "c", "sim", "rnk").distinct()


def nearest_neighbours(df: DataFrame, params: GraphParams | None = None, **columns: str) -> DataFrame:
    """(g, q, c, sim, rnk): the k most similar vectors of every usable vector."""
    p = params or GraphParams()
    usable = usable_vectors(df, **columns)
    reps = materialize(unique_vectors(usable), "reps")
    ranked = rank(search_index(*build_index(reps, p), p), p.k)
    if reps.where("copies > 1").isEmpty():
        return ranked
    # repeated vectors: candidates of a representative are the first copies of itself and of
    # its neighbours; every copy ranks them for itself
    ranked = materialize(ranked, "ranked")
    members = materialize(copy_members(usable, reps), "members")
    first = Window.partitionBy("g", "rep").orderBy("id")
    small = members.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= p.k + 1).drop("rn")  # at most k + 1 ids of each repeated vector
    wider = ranked.join(small.withColumnRenamed("rep", "c"), ["g", "c"], "left").select("g", "q", F.coalesce("id", "c").alias("c"), "sim")
    # a representative has few candidates and may have very many copies
    around = wider.join(small.select("g", F.col("rep").alias("q")).distinct(), ["g", "q"], "left_semi").unionByName(small.select("g", F.col("rep").alias("q"), F.col("id").alias("c"), F.lit(1.0).alias("sim")))
    w = Window.partitionBy("g", "q").orderBy(F.col("sim").desc(), "c")
    packed = around.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2 * p.k + 2).groupBy("g", "q").agg(F.collect_list(F.struct("c", "sim")).alias("near"))
    return rank(wider.unionByName(_of_copies(members, packed)), p.k)


def _of_copies(members: DataFrame, packed: DataFrame) -> DataFrame:
    """(g, q, c, sim) for every copy from the candidates of its representative. Copies of one
    vector are spread by a salt; the packed side has one row per repeated vector and salt."""
    salts = 64
    spread = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
    every = packed.withColumnRenamed("q", "rep").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    out = spread.join(every, ["g", "rep", "salt"]).select("g", F.col("id").alias("q"), F.inline("near"))
    return out.where("q <> c")


def neighbour_pairs(neighbours: DataFrame) -> DataFrame:
    return neighbours.select(F.least("q", "c").alias("vec_a"), F.greatest("q", "c").alias("vec_b")).distinct()
