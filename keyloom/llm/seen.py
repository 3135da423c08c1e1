"""Problem 2: has this key been seen before?

Every key becomes a 64-bit fingerprint; the high bits choose a hash partition. A partition
remembers its distinct fingerprints as an Elias-Fano sequence (high bits in unary, low bits
packed: about 2 + log2(U / n) bits a key, and 4 bytes per 512 bits of the unary part for its
directory), reads its records in arrival order, answers each by a successor search and
merges the new fingerprints of every batch into the sequence. A search counts the unary part by
its directory and decodes only the blocks it touches.

A :class:`KeyMemory` keeps the sequences of its partitions in the shared folder, so that the
next batch of records is answered without the earlier ones; a batch and its memory become
visible by one manifest rename. :func:`seen_before` answers one whole table.

A key that holds a third of all rows does not load one task: within each batch of the input
scan the earliest record of a key goes to the key's partition, as the memory's entry for
the batch; the others of the batch follow from it (an earlier record is beside them).

Defined results: the key is ``key_vector`` or, where that is null, the single number
``primary_key``; null elements are values of their own; a record with neither has no key: it is
never seen and never remembered; a null order counts as before every number; of equal orders
none is earlier; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.runtime import delete_path, materialize, new_path, shuffle_partitions
from keyloom.sources.manifest import commit_manifest, read_manifest

_WORD = np.uint64(64)
_BLOCK = 512  # bits of the unary part per directory entry


class EliasFano:
    """A strictly increasing sequence of unsigned numbers below ``2 ** bits``."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        v = np.asarray(values, dtype=np.uint64)
        self.n, self.bits = len(v), bits
        self.low_bits = max(0, bits - max(1, self.n).bit_length())
        low = np.uint64(self.low_bits)
        self.n_unary = self.n + (1 << (bits - self.low_bits)) + 1
        self.unary = np.zeros(-(-self.n_unary // _BLOCK) * (_BLOCK // 8), dtype=np.uint8)
        for s in range(0, self.n, 1 << 16):  # in pieces: a sequence is never held decoded
            at = (v[s : s + (1 << 16)] >> low).astype(np.int64) + np.arange(s, min(self.n, s + (1 << 16)))
            np.bitwise_or.at(self.unary, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        self.words = self._pack(v & ((np.uint64(1) << low) - np.uint64(1)))
        self._count()

    def _count(self) -> None:
        """The directory: zeros before each block."""
        ones = np.bitwise_count(self.unary.reshape(-1, _BLOCK // 8)).sum(axis=1, dtype=np.int64)
        zeros = _BLOCK - ones
        self.before = np.concatenate([[0], np.cumsum(zeros)[:-1]]).astype(np.uint32 if self.n_unary < 1 << 32 else np.int64)

    @classmethod
    def stored(cls, n: int, bits: int, unary: bytes, words: bytes) -> EliasFano:
        out = cls.__new__(cls)
        out.n, out.bits = n, bits
        out.low_bits = max(0, bits - max(1, n).bit_length())
        out.n_unary = n + (1 << (bits - out.low_bits)) + 1
        out.unary, out.words = np.frombuffer(unary, np.uint8), np.frombuffer(words, np.uint64)
        out._count()
        return out

    def _pack(self, low: np.ndarray) -> np.ndarray:
        width = self.low_bits
        words = np.zeros(self.n * width // 64 + 2, dtype=np.uint64)
        if not self.n or not width:
            return words
        at = np.arange(self.n, dtype=np.uint64) * np.uint64(width)
        word, shift = (at // _WORD).astype(np.int64), at % _WORD
        np.bitwise_or.at(words, word, low << shift)
        over = shift + np.uint64(width) > _WORD
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (_WORD - shift[over]))
        return words

    def _low(self, i: np.ndarray) -> np.ndarray:
        width = np.uint64(self.low_bits)
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * width
        word, shift = (at // _WORD).astype(np.int64), at % _WORD
        out = self.words[word] >> shift
        over = shift + width > _WORD
        out[over] |= self.words[word[over] + 1] << (_WORD - shift[over])
        return out & ((np.uint64(1) << width) - np.uint64(1))

    def values(self) -> np.ndarray:
        """All numbers, decoded block by block."""
        out, done = np.empty(self.n, dtype=np.uint64), 0
        step = _BLOCK // 8 * 128
        for s in range(0, len(self.unary), step):
            ones = np.flatnonzero(np.unpackbits(self.unary[s : s + step])) + s * 8
            at = np.arange(done, done + len(ones))
            out[at] = ((ones - at).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(at)
            done += len(ones)
        return out

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the unary part."""
        out = np.empty(len(k), dtype=np.int64)
        for s in range(0, len(k), 1024):
            want = k[s : s + 1024]
            block = np.searchsorted(self.before, want, side="right") - 1
            inside = (want - self.before[block]).astype(np.int64)
            # first the byte of the block, then the bit of the byte
            rows = self.unary.reshape(-1, _BLOCK // 8)[block]
            upto = np.cumsum(8 - np.bitwise_count(rows).astype(np.int16), axis=1)
            byte = (upto <= inside[:, None]).sum(axis=1)
            i = np.arange(len(want))
            left = inside - np.where(byte > 0, upto[i, np.maximum(byte - 1, 0)], 0)
            bits = np.unpackbits(rows[i, byte][:, None], axis=1) == 0
            bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
            out[s : s + 1024] = block * _BLOCK + byte * 8 + bit
        return out

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last element whose high bits are ``high``: the elements
        between the zeros high - 1 and high."""
        lo = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        return lo, self._zero(high) - high

    def _search(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.asarray(probes, dtype=np.uint64)
        lo, end = self._bucket((p >> np.uint64(self.low_bits)).astype(np.int64))
        want = p & ((np.uint64(1) << np.uint64(self.low_bits)) - np.uint64(1))
        hi = end.copy()
        open_ = lo < hi
        while open_.any():
            k = np.flatnonzero(open_)
            mid = (lo[k] + hi[k]) // 2
            below = self._low(mid) < want[k]
            lo[k] = np.where(below, mid + 1, lo[k])
            hi[k] = np.where(below, hi[k], mid)
            open_[k] = lo[k] < hi[k]
        return lo, end, want

    def successor(self, probes: np.ndarray) -> np.ndarray:
        """Index of the first element not below each probe (``n`` if there is none)."""
        return self._search(probes)[0]

    def contains(self, probes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(probes), dtype=bool)
        if self.n and len(probes):
            at, end, want = self._search(probes)
            inside = np.flatnonzero(at < end)
            out[inside] = self._low(at[inside]) == want[inside]
        return out

    def nbytes(self) -> int:
        return self.unary.nbytes + self.words.nbytes + self.before.nbytes


class SeenSet:
    """Growing set: one Elias-Fano sequence and a sorted buffer that is merged into it."""

    def __init__(self, bits: int, main: EliasFano | None = None) -> None:
        self.bits = bits
        self.main = main or EliasFano(np.zeros(0, np.uint64), bits)
        self.buffer = np.zeros(0, np.uint64)

    def contains(self, sorted_unique: np.ndarray) -> np.ndarray:
        hit = self.main.contains(sorted_unique)
        if len(self.buffer):
            at = np.minimum(np.searchsorted(self.buffer, sorted_unique), len(self.buffer) - 1)
            hit |= self.buffer[at] == sorted_unique
        return hit

    def add(self, new_sorted: np.ndarray) -> None:
        self.buffer = np.union1d(self.buffer, new_sorted)
        if len(self.buffer) > max(1 << 15, self.main.n // 8):
            self.settle()

    def settle(self) -> None:
        """Merge the buffer into the sequence."""
        if len(self.buffer):
            merged = np.concatenate([self.main.values(), self.buffer])
            merged.sort(kind="stable")  # two sorted runs: one merge pass
            self.main, self.buffer = EliasFano(merged, self.bits), np.zeros(0, np.uint64)


def key_fingerprint(table: Column, vector: Column, primary: Column) -> Column:
    key = F.coalesce(vector, F.when(primary.isNotNull(), F.array(primary)))
    nulls = F.size(F.filter(key, lambda x: x.isNull()))
    marked = F.when(nulls > 0, F.transform(key, lambda x: x.isNull()))
    return F.when(key.isNotNull(), F.xxhash64(table.isNull(), table, F.size(key), key, marked))


def _mark_beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark the records that have an earlier record of the same key in their own batch."""
    for b in batches:
        h, a = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
        order = np.lexsort((a, h))
        hs, as_ = h[order], a[order]
        head = np.ones(len(h), dtype=bool)
        head[1:] = hs[1:] != hs[:-1]
        first = as_[head][np.cumsum(head) - 1]
        beside = np.empty(len(h), dtype=bool)
        beside[order] = as_ > first
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(beside)], names=["h", "a", "beside"])


_STATE = "a bigint, p int, n bigint, unary binary, words binary"


def _probe(part_bits: int, remember: bool):
    """Rows come sorted by (partition, stored sequence first, order). Answers have ``a`` set,
    sequences for the next batch ``p``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = 64 - part_bits
        mask = np.uint64((1 << bits) - 1)
        part, seen = None, None
        names = [c.split()[0] for c in _STATE.split(", ")]

        def rows(a: np.ndarray) -> pa.RecordBatch:
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names=names)

        def answer(h: np.ndarray, a: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((a, h))
            hs, as_ = h[order], a[order]
            head = np.ones(len(h), dtype=bool)
            head[1:] = hs[1:] != hs[:-1]
            group = np.cumsum(head) - 1
            known = seen.contains(hs[head])
            hit = known[group] | (as_ > as_[head][group])
            seen.add(hs[head][~known])
            return rows(as_[hit])

        def closing() -> Iterator[pa.RecordBatch]:
            if len(held_a):
                yield answer(held_h, held_a)
            if remember and part is not None:
                seen.settle()
                m = seen.main
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([part], pa.int32()), pa.array([m.n], pa.int64()), pa.array([m.unary.tobytes()], pa.binary()), pa.array([m.words.tobytes()], pa.binary())], names=names)

        held_h, held_a = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            p = b.column(0).to_numpy()
            h = b.column(1).fill_null(0).to_numpy().view(np.uint64) & mask
            a = b.column(2).fill_null(0).to_numpy()
            stored = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((p[1:] != p[:-1]) | stored[:-1]) + 1).tolist(), len(p)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if part is None or part != p[s]:
                    yield from closing()
                    part, seen = int(p[s]), SeenSet(bits)
                    held_h, held_a = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if stored[s]:
                    seen = SeenSet(bits, EliasFano.stored(b.column(3)[s].as_py(), bits, b.column(4)[s].as_py(), b.column(5)[s].as_py()))
                    continue
                hh, aa = np.concatenate([held_h, h[s:e]]), np.concatenate([held_a, a[s:e]])
                # records of the last order wait: more of the same order may follow
                done = int(np.searchsorted(aa, aa[-1]))
                if done:
                    yield answer(hh[:done], aa[:done])
                held_h, held_a = hh[done:], aa[done:]
        yield from closing()

    return run


def _arrivals(df: DataFrame, order: str, table: str, primary: str, vector: str) -> DataFrame:
    """(h, a, beside): fingerprints in arrival order; beside: an earlier record of the same key
    is in the same batch of the scan."""
    lowest = F.lit(-(1 << 63)).cast("bigint")
    keyed = df.select(key_fingerprint(F.col(table), F.col(vector), F.col(primary)).alias("h"), F.coalesce(F.col(order).cast("bigint"), lowest).alias("a")).where("h IS NOT NULL")
    return materialize(keyed.mapInArrow(_mark_beside, "h bigint, a bigint, beside boolean"), "arrivals")


def _records(probes: DataFrame, part_bits: int) -> DataFrame:
    return probes.select(F.shiftrightunsigned("h", 64 - part_bits).cast("int").alias("p"), F.col("h"), F.col("a"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("unary"), F.lit(None).cast("binary").alias("words"))


def _part_bits(spark: SparkSession, keys: int, keys_per_partition: int) -> int:
    bits = max(1, (max(1, keys // keys_per_partition)).bit_length())
    # few keys: still use every task
    return bits if bits >= 6 else max(bits, min(12, shuffle_partitions(spark).bit_length() + 1))


def seen_before(df: DataFrame, order: str, table: str, primary: str, vector: str, *, keys_per_partition: int = 1 << 20) -> DataFrame:
    """The ``order`` of every record whose key occurred in an earlier record."""
    spark = df.sparkSession
    marked = _arrivals(df, order, table, primary, vector)
    probes = marked.where("NOT beside")
    part_bits = _part_bits(spark, probes.count(), keys_per_partition)
    probed = _records(probes, part_bits).repartition(shuffle_partitions(spark), "p").sortWithinPartitions("p", "a").mapInArrow(_probe(part_bits, False), _STATE)
    return marked.where("beside").select("a").union(probed.select("a")).select(F.col("a").alias(order))


class KeyMemory:
    """The keys of all batches so far, as one stored sequence per hash partition.

    ``observe`` answers a batch and takes its keys up; records of a batch count as later than
    those of the batches before, whatever their order. ``parts`` (fixed when the memory is
    made) partitions hold the keys; at 2 ** 20 keys each they need about 5 MB."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, part_bits: int = 10) -> None:
        self.spark, self.path = spark, path or new_path(spark, "keymemory")
        found = read_manifest(spark, f"{self.path}/_manifest")
        self.version, self.state = found if found else (0, {"part_bits": part_bits, "data": None})

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_STATE).parquet(f"{self.path}/{name}")

    def observe(self, df: DataFrame, order: str, table: str, primary: str, vector: str) -> DataFrame:
        """The ``order`` of every record of the batch whose key occurred in an earlier record,
        of this batch or another. The result can be read until the next batch is observed."""
        bits, old = self.state["part_bits"], self.state["data"]
        marked = _arrivals(df, order, table, primary, vector)
        rows = _records(marked.where("NOT beside"), bits)
        if old:
            stored = self._read(old).where("p IS NOT NULL")
            rows = rows.unionByName(stored.select("p", F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("bigint").alias("a"), "n", "unary", "words"))
        name = f"v{self.version + 1:09d}"
        spread = rows.repartition(shuffle_partitions(self.spark), "p").sortWithinPartitions("p", F.col("n").asc_nulls_last(), "a")
        spread.mapInArrow(_probe(bits, True), _STATE).write.mode("overwrite").parquet(f"{self.path}/{name}")
        commit_manifest(self.spark, f"{self.path}/_manifest", self.version + 1, self.state | {"data": name})
        self.version, self.state = self.version + 1, self.state | {"data": name}
        if old:
            delete_path(self.spark, f"{self.path}/{old}")
        answers = self._read(name).where("p IS NULL").select("a")
        return marked.where("beside").select("a").union(answers).select(F.col("a").alias(order))

    def n_keys(self) -> int:
        """Distinct keys remembered."""
        if not self.state["data"]:
            return 0
        return self._read(self.state["data"]).where("p IS NOT NULL").agg(F.sum("n")).first()[0] or 0


def error_rate(df: DataFrame, answers: DataFrame, order: str, table: str, primary: str, vector: str) -> DataFrame:
    """Compare answers with the exact ones: records, seen records, wrong answers, their rate."""
    key = F.coalesce(F.col(vector), F.when(F.col(primary).isNotNull(), F.array(primary)))
    exact = df.select(F.col(order).alias("a"), F.col(table).alias("t"), key.alias("k"))
    first = exact.where("k IS NOT NULL").groupBy("t", "k").agg(F.min("a").alias("first"), F.count(F.lit(1)).alias("n"))
    truly = first.agg(F.sum("n").alias("with_key"), F.count(F.lit(1)).alias("n_keys"))
    firsts = first.select(F.col("first").alias("a"))
    # an answer is wrong if it names a first record; a missed one shows in the counts
    false_seen = answers.select(F.col(order).alias("a")).join(firsts, "a", "left_semi").agg(F.count(F.lit(1)).alias("false_seen"))
    n_seen = answers.agg(F.count(F.lit(1)).alias("n_seen"))
    total = df.agg(F.count(F.lit(1)).alias("n_records"))
    row = {**total.first().asDict(), **truly.first().asDict(), **n_seen.first().asDict(), **false_seen.first().asDict()}  # five numbers
    expected = (row["with_key"] or 0) - row["n_keys"]
    missed = expected - (row["n_seen"] - row["false_seen"])
    wrong = row["false_seen"] + missed
    spark = df.sparkSession
    return spark.createDataFrame([(row["n_records"], row["n_seen"], wrong, wrong / max(1, row["n_records"]))], "n_records bigint, n_seen bigint, n_wrong bigint, wrong_rate double")
