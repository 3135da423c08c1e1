"""Append-only Parquet commits with last-write-wins reads.

A table folder holds one sub-folder per commit and a versioned manifest that names the commits
with their transaction range, row count and key range. Files that the manifest does not name
are invisible, so a failed write leaves nothing behind. A read unions the commits, keeps the
newest write of each key and hides tombstones; a table whose only commit has unique keys is
read as it is. Bulk commits are range-partitioned by key, so the files of a commit split its key
range; the manifest has the range of every file, and files that cannot match a lookup are not
opened.

The manifest is read again before every use, so several engines may read and write one table: a
commit that another writer overtook is written again on top of it. Files of merged or truncated
commits stay for ``retention_ms``, so a result that was planned before can still be read.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import EngineError, ErrorCode
from keyloom.operators.changefeed import newest_per_key
from keyloom.runtime import delete_path
from keyloom.sources.catalog import TableMeta
from keyloom.sources.manifest import CommitConflict, commit_manifest, read_manifest

TX, TS, DELETED = "__tx_id", "__ts", "__deleted"
HIDDEN = [TX, TS, DELETED]


def now_ms() -> int:
    return time.time_ns() // 10**6


@dataclass(frozen=True)
class KeyBound:
    """A bound on the first key column, for skipping commits."""

    low: int | None = None
    high: int | None = None


class TableStore:
    """The commits of one table."""

    COMPACT_AT = 5  # fixed value: commits at which a table is merged
    RETENTION_MS = 24 * 3600 * 1000
    MAX_FILES = 10_000  # files of one commit whose ranges are kept

    def __init__(self, spark: SparkSession, meta: TableMeta, folder: str, wide_long: bool = False) -> None:
        self.spark, self.meta, self.folder, self.wide_long = spark, meta, folder, wide_long
        self.version, self.state = 0, {"next_tx": 1, "commits": []}
        self.refresh()

    def refresh(self) -> None:
        """Take up what other engines have committed."""
        found = read_manifest(self.spark, f"{self.folder}/_manifest")
        if found:
            self.version, self.state = found

    @property
    def schema(self) -> T.StructType:
        return T.StructType([*self.meta.schema(self.wide_long).fields, T.StructField(TX, T.LongType()), T.StructField(TS, T.LongType()), T.StructField(DELETED, T.BooleanType())])

    def _publish(self, state: dict) -> None:
        commit_manifest(self.spark, f"{self.folder}/_manifest", self.version + 1, state)
        self.version, self.state = self.version + 1, state

    def _write(self, rows: DataFrame, unique: bool, bulk: bool) -> dict | None:
        """Write one commit, sorted for row-group statistics, and describe it."""
        name = f"c{self.version + 1:09d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        order, first = self.meta.sort_by or self.meta.key, self.meta.key[0]
        rows = rows.select(*[f.name for f in self.schema.fields])
        if bulk:
            rows = rows.repartitionByRange(*order)
        rows.sortWithinPartitions(*order).write.option(f"parquet.bloom.filter.enabled#{first}", "true").parquet(path)
        stored = self.spark.read.schema(self.schema).parquet(path)
        per_file = stored.groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min(TX).alias("tx0"), F.max(TX).alias("tx1"), F.min(first).alias("k0"), F.max(first).alias("k1"))
        r = per_file.agg(F.sum("n").alias("n"), F.min("tx0").alias("tx0"), F.max("tx1").alias("tx1"), F.min("k0").alias("k0"), F.max("k1").alias("k1"), F.count(F.lit(1)).alias("files")).first()
        if not r.n:
            delete_path(self.spark, path)
            return None
        entry = {"path": name, "rows": r.n, "tx_min": r.tx0, "tx_max": r.tx1, "key_min": int(r.k0), "key_max": int(r.k1), "unique": unique}
        if 1 < r.files <= self.MAX_FILES:
            entry["files"] = [[x.f, int(x.k0), int(x.k1)] for x in per_file.orderBy("f").collect()]  # at most MAX_FILES
        return entry

    # -- writes ------------------------------------------------------------------------------
    def _commit_rows(self, make, unique: bool, bulk: bool, extra: dict) -> int:
        """Write ``make(tx)`` and publish it; if another writer was faster, once more with the
        next transaction id. Returns that id."""
        while True:
            self.refresh()
            tx = self.state["next_tx"]
            entry = self._write(make(tx), unique, bulk)
            if entry is None and not extra:
                return tx
            added = [entry] if entry else []
            try:
                self._publish(self.state | extra | {"next_tx": max(self.state["next_tx"], entry["tx_max"] + 1 if entry else 0), "commits": [*self.state["commits"], *added]})
                return tx
            except CommitConflict:
                if entry:
                    delete_path(self.spark, f"{self.folder}/{entry['path']}")

    def _complete(self, full: DataFrame) -> DataFrame:
        for f in self.schema.fields:
            if f.name not in full.columns:
                full = full.withColumn(f.name, F.lit(None).cast(f.dataType))
        return full

    def append(self, rows: DataFrame, deleted: bool = False, ordinal: str | None = None, unique: bool = False, bulk: bool = False) -> int:
        """Add ``rows`` as one commit. ``ordinal`` numbers the rows of one statement, so that
        of equal keys the later one wins. Returns the first transaction id."""
        step = F.col(ordinal) if ordinal else F.lit(0)

        def make(tx: int) -> DataFrame:
            return self._complete(rows.withColumn(TX, (F.lit(tx) + step).cast("bigint")).withColumn(TS, F.lit(now_ms()).cast("bigint")).withColumn(DELETED, F.lit(deleted)))

        return self._commit_rows(make, unique, bulk, {})

    def append_changes(self, rows: DataFrame, batch: int, order: str | None, deleted: str | None) -> bool:
        """Add upserts and tombstones of one micro-batch as one commit that also records the
        batch, so it is applied once. ``order`` becomes the version of the rows: a change that
        arrives late loses against a newer one of an earlier batch."""
        self.refresh()
        if self.state.get("last_batch", -1) >= batch:
            return False
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)

        def make(tx: int) -> DataFrame:
            version = F.coalesce(F.col(order).cast("bigint"), F.lit(-(1 << 63))) if order else F.lit(tx)
            full = rows.withColumn(TX, version.cast("bigint")).withColumn(TS, F.lit(now_ms()).cast("bigint")).withColumn(DELETED, gone)
            return self._complete(newest_per_key(full, self.meta.key, TX))

        self._commit_rows(make, False, True, {"last_batch": batch, "ordered": bool(order) or self.state.get("ordered", False)})
        return True

    # -- reads ---------------------------------------------------------------------------------
    def versions(self, bound: KeyBound | None = None) -> DataFrame:
        """All stored versions, hidden columns included."""
        self.refresh()
        return self._stored(self.state["commits"], bound)

    def _stored(self, commits: list[dict], bound: KeyBound | None = None) -> DataFrame:
        def meets(low: int, high: int) -> bool:
            return bound is None or ((bound.low is None or high >= bound.low) and (bound.high is None or low <= bound.high))

        paths = []
        for c in commits:
            if not meets(c["key_min"], c["key_max"]):
                continue
            if bound and "files" in c:
                paths += [f"{self.folder}/{c['path']}/{f}" for f, low, high in c["files"] if meets(low, high)]
            else:
                paths.append(f"{self.folder}/{c['path']}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def view(self, bound: KeyBound | None = None) -> DataFrame:
        """The current rows."""
        stored, commits = self.versions(bound), self.state["commits"]
        if not (len(commits) == 1 and commits[0]["unique"]):
            stored = newest_per_key(stored, self.meta.key, TX)
        return stored.where(~F.col(DELETED)).drop(*HIDDEN)

    def zone_map(self) -> list[dict]:
        self.refresh()
        return list(self.state["commits"])

    # -- compaction ------------------------------------------------------------------------------
    def compact(self, force: bool = False) -> bool:
        """Merge the commits into one without older versions and, unless changes may arrive
        late (``append_changes`` with an order), without tombstones.

        All commits present are merged, so no older write of a dropped key can come back.
        """
        self.refresh()
        merged = self.state["commits"]
        if len(merged) < (2 if force else self.COMPACT_AT):
            return False
        newest = newest_per_key(self._stored(merged), self.meta.key, TX)
        if not self.state.get("ordered"):
            newest = newest.where(~F.col(DELETED))
        entry = self._write(newest, unique=True, bulk=True)
        names = {c["path"] for c in merged}
        while True:
            later = [c for c in self.state["commits"] if c["path"] not in names]
            if len(later) + len(merged) != len(self.state["commits"]):  # merged or truncated by another engine
                if entry:
                    delete_path(self.spark, f"{self.folder}/{entry['path']}")
                return False
            try:
                self._publish(self._retired(names) | {"commits": [*([entry] if entry else []), *later]})
                break
            except CommitConflict:
                self.refresh()
        self.vacuum()
        return True

    def _retired(self, names: set[str]) -> dict:
        return self.state | {"garbage": [*self.state.get("garbage", []), *([n, now_ms()] for n in sorted(names))]}

    def truncate(self) -> None:
        while True:
            self.refresh()
            try:
                self._publish(self._retired({c["path"] for c in self.state["commits"]}) | {"commits": []})
                return
            except CommitConflict:
                continue

    def vacuum(self, retention_ms: int | None = None) -> int:
        """Delete the files of commits that were replaced more than ``retention_ms`` ago."""
        self.refresh()
        keep = self.RETENTION_MS if retention_ms is None else retention_ms
        old = [n for n, at in self.state.get("garbage", []) if at <= now_ms() - keep]
        if not old:
            return 0
        try:
            self._publish(self.state | {"garbage": [g for g in self.state["garbage"] if g[0] not in old]})
        except CommitConflict:
            return 0
        for n in old:
            delete_path(self.spark, f"{self.folder}/{n}")
        return len(old)


class ExternalStore:
    """A registered Parquet file, read-only. ``version`` columns decide between rows of the
    same key; ``deleted`` names a tombstone column; without versions keys must be unique."""

    def __init__(self, spark: SparkSession, meta: TableMeta) -> None:
        self.spark, self.meta = spark, meta

    def _stored(self) -> DataFrame:
        df = self.spark.read.parquet(self.meta.external["path"])
        return df.select(*[F.col(self.meta.external["names"][c]).alias(c) for c in self.meta.column_names], *self._extra(df))

    def _extra(self, df: DataFrame) -> list[Column]:
        deleted = self.meta.external.get("deleted")
        return [F.coalesce(F.col(deleted), F.lit(False)).alias(DELETED)] if deleted else []

    def view(self, bound: KeyBound | None = None) -> DataFrame:
        version = self.meta.external["version"]
        df = self._stored()
        if version:
            df = newest_per_key_by(df, self.meta.key, version)
        if DELETED in df.columns:
            df = df.where(~F.col(DELETED)).drop(DELETED)
        return df

    def append(self, *_: object, **__: object) -> int:
        raise EngineError(ErrorCode.SQL_UNSUPPORTED, f"table {self.meta.qualified} is a registered file and read-only")

    def compact(self, force: bool = False) -> bool:
        return False

    def zone_map(self) -> list[dict]:
        return []


def newest_per_key_by(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*key).orderBy(*[F.col(v).desc_nulls_last() for v in version])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn <= 1").drop("__rn")
