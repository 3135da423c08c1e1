"""Problem 1: apply a feed of inserts, updates and deletes.

A :class:`ChangeLog` is a log-structured table. Every batch of changes becomes one *run*, or
several runs that are written in one pass: the newest write of each key in the run,
hash-bucketed by key and sorted by key and sequence. A read merges the runs: the files of one bucket are read by one task, so the merge
needs no exchange, only the per-bucket merge by (key, sequence descending), of which the first
row per key survives unless it is a tombstone. When more than ``fan_in`` runs exist they are
compacted into one base run; the swap is one manifest rename, and the files of the generation
before stay until the next compaction, for readers that planned with them.

Defined results
    * the write with the highest sequence number decides; arrival order does not matter;
    * repeated deliveries (same key and sequence) count once, the first by ``tie`` is kept;
    * a null sequence number loses against every number;
    * a null ``deleted`` flag means "not deleted";
    * null key parts are key values of their own (null equals null);
    * an empty feed gives an empty table; all columns of the input are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.runtime import delete_path, fresh, hadoop_path, new_path, shuffle_partitions
from keyloom.sources.manifest import commit_manifest, read_manifest


def newest_per_key(df: DataFrame, keys: list[str], seq: str, tie: list[str] | None = None) -> DataFrame:
    """The row with the highest ``seq`` of each key.

    ``row_number() <= 1`` is planned with a group limit on both sides of the exchange, so a
    key that holds a third of all rows sends one row per input partition, not all of them.
    """
    rn = fresh(df, "__rn")
    order = [F.col(seq).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in tie or [])]
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= 1).drop(rn)


class ChangeLog:
    RUN = "__run"

    def __init__(self, spark: SparkSession, keys: list[str], seq: str, deleted: str, *, tie: list[str] | None = None, path: str | None = None, fan_in: int = 4, buckets: int | None = None) -> None:
        self.spark, self.keys, self.seq, self.deleted, self.tie = spark, keys, seq, deleted, tie or []
        self.path = path or new_path(spark, "changelog")
        self.fan_in = fan_in
        state = read_manifest(spark, f"{self.path}/_manifest")
        self.version, self.state = state if state else (0, {"generation": None, "runs": [], "next_run": 0, "columns": None, "buckets": buckets or shuffle_partitions(spark)})

    # -- writing -----------------------------------------------------------------------
    def _write(self, df: DataFrame, generation: str) -> None:
        """Sorted, bucketed files. The exchange of :func:`newest_per_key` has the table's
        number of buckets where the session agrees with it, so a task writes whole buckets and
        no second exchange is needed."""
        if shuffle_partitions(self.spark) != self.state["buckets"]:
            df = df.repartition(self.state["buckets"], *self.keys)
        self._register(generation)
        (
            df.write.format("parquet").mode("append")
            .bucketBy(self.state["buckets"], *self.keys).sortBy(*self.keys, self.seq)
            .option("path", f"{self.path}/{generation}").saveAsTable(generation)
        )

    def append(self, changes: DataFrame, parts: Column | None = None, n_parts: int = 1) -> int:
        """Add one batch as a new run and return its number; with ``parts`` (0 to
        ``n_parts`` - 1 per row) as ``n_parts`` runs, written together."""
        if self.RUN in changes.columns:
            raise ValueError(f"the column name {self.RUN} is reserved")
        missing = [c for c in [*self.keys, self.seq, self.deleted, *self.tie] if c not in changes.columns]
        if missing:
            raise ValueError(f"changes have no column {missing}")
        state = dict(self.state)
        run = state["next_run"]
        if state["generation"] is None:
            state["generation"] = f"keyloom_{uuid.uuid4().hex}"
            state["columns"] = changes.columns
            self.state = state
        numbered = changes.select(*state["columns"], ((F.lit(0) if parts is None else parts) + run).cast("int").alias(self.RUN))
        # the runs of a key share its bucket, so one exchange serves them all
        w = Window.partitionBy(*self.keys, self.RUN)
        order = [F.col(self.seq).desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in self.tie)]
        rn = fresh(numbered, "__rn")
        newest = numbered.withColumn(rn, F.row_number().over(w.orderBy(*order))).where(F.col(rn) <= 1).drop(rn)
        self._write(newest if n_parts == 1 else newest.repartition(self.state["buckets"], *self.keys), state["generation"])
        self._commit(state | {"runs": [*state["runs"], *range(run, run + n_parts)], "next_run": run + n_parts})
        if len(self.state["runs"]) > self.fan_in:
            self.compact()
        return run

    def _commit(self, state: dict) -> None:
        commit_manifest(self.spark, f"{self.path}/_manifest", self.version + 1, state)
        self.version, self.state = self.version + 1, state

    # -- reading -----------------------------------------------------------------------
    def _register(self, name: str) -> None:
        """Name a generation's files in the session, which bucketed reads and writes need."""
        if self.spark.catalog.tableExists(name):
            return
        fs, p = hadoop_path(self.spark, f"{self.path}/{name}")
        if fs.exists(p):
            stored = self.spark.read.parquet(f"{self.path}/{name}")
            fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stored.schema.fields)
            cols = ", ".join(f"`{k}`" for k in self.keys)
            self.spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({cols}) SORTED BY ({cols}, `{self.seq}`) INTO {self.state['buckets']} BUCKETS LOCATION '{self.path}/{name}'")

    def forget(self) -> None:
        """Take the log's table names out of the session; files and planned results stay."""
        for name in (self.state["generation"], self.state.get("previous")):
            if name:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _table(self) -> DataFrame:
        name = self.state["generation"]
        self._register(name)
        self.spark.catalog.refreshTable(name)
        # files of an append that never committed carry a run number that is not listed
        return self.spark.table(name).where(F.col(self.RUN).isin(self.state["runs"]))

    def merged(self) -> DataFrame:
        """Newest write of each key over all runs, tombstones included."""
        return newest_per_key(self._table(), self.keys, self.seq, self.tie)

    def current(self) -> DataFrame:
        """The current rows: newest write of each key that is not a delete."""
        if self.state["generation"] is None:
            raise ValueError("nothing was appended yet")
        live: Column = ~F.coalesce(F.col(self.deleted), F.lit(False))
        return self.merged().where(live).select(*self.state["columns"])

    def compact(self, purge_below: int | None = None) -> None:
        """Merge all runs into one base run of a new generation.

        Tombstones stay, as a later run may still deliver an older write of the same key;
        those with a sequence below ``purge_below``, before which nothing more arrives, go.
        """
        old, older = self.state["generation"], self.state.get("previous")
        run = self.state["next_run"]
        generation = f"keyloom_{uuid.uuid4().hex}"
        merged = self.merged().withColumn(self.RUN, F.lit(run))
        if purge_below is not None:
            merged = merged.where(~(F.coalesce(F.col(self.deleted), F.lit(False)) & (F.col(self.seq) < purge_below)))
        self._write(merged, generation)
        self._commit(self.state | {"generation": generation, "previous": old, "runs": [run], "next_run": run + 1})
        if older:
            self.spark.sql(f"DROP TABLE IF EXISTS {older}")
            delete_path(self.spark, f"{self.path}/{older}")


def apply_change_feed(changes: DataFrame, keys: list[str], seq: str, deleted: str, *, batches: int = 6, tie: list[str] | None = None, fan_in: int = 8) -> DataFrame:
    """Write ``changes`` in one pass as ``batches`` runs of a :class:`ChangeLog` and return its
    current rows. Each run holds what some of the tasks read, as writers that flush on their
    own would; which run a change is in does not matter to the merge."""
    log = ChangeLog(changes.sparkSession, keys, seq, deleted, tie=tie, fan_in=fan_in)
    log.append(changes, F.pmod(F.spark_partition_id(), F.lit(batches)), batches)
    current = log.current()
    log.forget()
    return current
