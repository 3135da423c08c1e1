"""The engine: statements in, DataFrames out."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import EngineError, ErrorCode, ddl, unknown, unsupported
from keyloom.functions import render, vector
from keyloom.functions.types import checked, from_spark, parse_type
from keyloom.plans import dialect
from keyloom.plans.binder import BoundDelete, BoundInsert, BoundSelect, bind_delete, bind_insert, bind_select, key_bound, plan_select, with_arguments
from keyloom.runtime import delete_path
from keyloom.sources.catalog import Catalog, ColumnMeta, IndexMeta, TableMeta, make_columns
from keyloom.sources.storage import ExternalStore, KeyBound, TableStore


_STRINGS = re.compile(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", re.S)


class Engine:
    """``root`` is the database folder; without it only registered files can be queried."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, strict: bool = True, wide_long: bool = False) -> None:
        self.spark, self.root, self.strict, self.wide_long = spark, root.rstrip("/") if root else None, strict, wide_long
        self.catalog = Catalog(spark, self.root)
        self._stores: dict[tuple[str, str], TableStore | ExternalStore] = {}
        self.default_session = Session(self)

    # -- tables --------------------------------------------------------------------------------
    def store(self, meta: TableMeta) -> TableStore | ExternalStore:
        at = (meta.keyspace, meta.name)
        if at not in self._stores:
            if meta.external:
                self._stores[at] = ExternalStore(self.spark, meta)
            else:
                self._stores[at] = TableStore(self.spark, meta, f"{self.root}/{meta.keyspace}/{meta.name}", self.wide_long)
        return self._stores[at]

    def meta(self, name: str) -> TableMeta:
        return self.catalog.table(tuple(name.split(".")))

    def view(self, name: str, bound: KeyBound | None = None) -> DataFrame:
        """The current rows of a table."""
        return self.store(self.meta(name)).view(bound)

    def register_parquet(self, name: str, path: str, key: Sequence[str], *, range_idx: bool = False, version: Sequence[str] = (), deleted: str | None = None) -> TableMeta:
        """A read-only table over Parquet files. With ``version`` the row with the highest
        version of each key counts; without, keys are taken to be unique."""
        ks, tbl = (n.lower() for n in name.split("."))
        if ks not in self.catalog.keyspaces:
            self.catalog.create_keyspace(ks)
        schema = self.spark.read.parquet(path).schema
        names = {f.name.lower(): f.name for f in schema.fields}
        wanted = [k.lower() for k in key]
        if missing := [c for c in [*wanted, *(v.lower() for v in version)] if c not in names]:
            raise unknown(f"{path} has no column {missing[0]}")
        ordered = wanted + [n for n in names if n not in wanted]
        columns = [ColumnMeta(n, i, from_spark(schema[names[n]].dataType).kind.name.lower(), n in wanted) for i, n in enumerate(ordered)]
        meta = TableMeta(ks, tbl, columns, len(wanted), range_idx, external={"path": path, "names": names, "version": [v.lower() for v in version], "deleted": deleted})
        return self.catalog.add_table(meta)

    def insert_df(self, name: str, df: DataFrame, *, order: str | None = None, unique: bool = False) -> int:
        """Bulk upsert: one commit. Values are checked in the job. Of equal keys the row with
        the highest ``order`` wins (without it, any one); ``unique`` promises unique keys and
        lets a table of one commit be read without a merge. Returns the transaction id."""
        meta = self.meta(name)
        rows = self._checked(meta, df, {"__ord": F.col(order).cast("bigint")} if order else {})
        if order:
            low = rows.agg(F.min("__ord")).first()[0] or 0
            rows = rows.withColumn("__ord", F.col("__ord") - F.lit(low))
            return self._after_write(meta, self.store(meta).append(rows, ordinal="__ord", unique=unique, bulk=True))
        return self._after_write(meta, self.store(meta).append(rows, unique=unique, bulk=True))

    def apply_changes(self, name: str, df: DataFrame, batch: int, *, order: str | None = None, deleted: str | None = None) -> None:
        """One micro-batch of upserts and deletes as one commit, applied once."""
        meta = self.meta(name)
        store = self.store(meta)
        if not isinstance(store, TableStore):
            raise EngineError(ErrorCode.SQL_UNSUPPORTED, f"{name} is read-only")
        extra = {k: F.col(c) for k, c in (("__order", order), ("__gone", deleted)) if c}
        rows = self._checked(meta, df, extra)
        if store.append_changes(rows, batch, "__order" if order else None, "__gone" if deleted else None):
            store.compact()

    def _checked(self, meta: TableMeta, df: DataFrame, extra: dict) -> DataFrame:
        have = {c.lower(): c for c in df.columns}
        if missing := [k for k in meta.key if k not in have]:
            raise EngineError(ErrorCode.SQL_SYNTAX_ERROR, f"primary key column {missing[0]} is missing")
        picked = [checked(F.col(f"`{have[c.name]}`"), c.ctype, c.name, self.wide_long).alias(c.name) for c in meta.columns if c.name in have]
        rows = df.select(*picked, *(c.alias(n) for n, c in extra.items()))
        for k in meta.key:
            rows = rows.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null in primary key column {k}")).cast(rows.schema[k].dataType)).otherwise(F.col(k)))
        return rows

    def insert_many(self, name: str, rows: Sequence[dict]) -> int:
        """Many rows in one commit; later rows win over earlier ones of the same key."""
        if not rows:
            return 0
        columns = list(dict.fromkeys(k.lower() for r in rows for k in r))
        stmt = BoundInsert(self.meta(name), [], [])
        meta = stmt.table
        stmt.columns = [meta.column(c) or _raise(unknown(f"unknown column name {c}")) for c in columns]
        from keyloom.functions.types import parse_literal

        stmt.rows = [[parse_literal({k.lower(): v for k, v in r.items()}.get(c.name), c.ctype, self.wide_long) for c in stmt.columns] for r in rows]
        return self._insert(stmt)

    def compact(self, name: str, force: bool = True) -> bool:
        return self.store(self.meta(name)).compact(force)

    def _after_write(self, meta: TableMeta, tx: int) -> int:
        self.store(meta).compact()
        return tx

    def _insert(self, b: BoundInsert) -> int:
        ids = [i for i, c in enumerate(b.columns) if c.primary]
        if any(r[i] is None for r in b.rows for i in ids) or len(ids) < b.table.pk_size:
            raise EngineError(ErrorCode.SQL_WRONG_VALUE_FORMAT, "null in the primary key")
        schema = T.StructType([*(T.StructField(c.name, c.ctype.spark(self.wide_long)) for c in b.columns), T.StructField("__ord", T.LongType())])
        df = self.spark.createDataFrame([(*r, i) for i, r in enumerate(b.rows)], schema).coalesce(1)
        return self._after_write(b.table, self.store(b.table).append(df, ordinal="__ord"))

    def _delete(self, b: BoundDelete) -> int:
        """A tombstone for every listed key."""
        by = {c.column.name: list(dict.fromkeys(c.values)) for c in b.where}
        keys = list(itertools.product(*(by[k] for k in b.table.key)))
        schema = T.StructType([T.StructField(k, b.table.column(k).ctype.spark(self.wide_long)) for k in b.table.key])
        df = self.spark.createDataFrame(keys, schema).coalesce(1)
        return self._after_write(b.table, self.store(b.table).append(df, deleted=True))

    # -- statements ------------------------------------------------------------------------------
    def run(self, bound: BoundSelect | BoundInsert | BoundDelete) -> DataFrame | None:
        if isinstance(bound, BoundSelect):
            store = self.store(bound.table)
            return plan_select(bound, store.view(key_bound(bound.where, bound.table)))
        if isinstance(bound, BoundInsert):
            self._insert(bound)
        else:
            self._delete(bound)
        return None

    def bind(self, stmt: dialect.Statement, strict: bool | None = None):
        table = self.catalog.table(stmt.table)
        if isinstance(stmt, dialect.Select):
            return bind_select(stmt, table, self.wide_long, self.strict if strict is None else strict)
        if isinstance(stmt, dialect.Insert):
            return bind_insert(stmt, table, self.wide_long)
        return bind_delete(stmt, table, self.wide_long)

    def sql(self, text: str, args: Sequence[object] = (), strict: bool | None = None) -> DataFrame | None:
        """Run one statement. SELECT and DESCRIBE give a DataFrame, others None."""
        stmt, n = dialect.parse(text)
        if n != len(args):
            raise EngineError(ErrorCode.PROTOCOL_BAD_PREPARED_VALUE, f"the statement has {n} placeholders, {len(args)} values were given")
        if isinstance(stmt, (dialect.Select, dialect.Insert, dialect.Delete)):
            bound = self.bind(stmt, strict)
            return self.run(with_arguments(bound, list(args), self.wide_long) if n else bound)
        return self._ddl(stmt)

    def _ddl(self, stmt: dialect.Statement) -> DataFrame | None:
        if isinstance(stmt, dialect.CreateKeyspace):
            self.catalog.create_keyspace(stmt.name, stmt.if_not_exists)
        elif isinstance(stmt, dialect.CreateTable):
            if len(stmt.table) != 2:
                raise ddl("query should contain keyspace & table names")
            if not self.root:
                raise unsupported("this engine has no database folder")
            ks, name = (n.lower() for n in stmt.table)
            self.catalog.add_table(TableMeta(ks, name, make_columns(stmt.columns, stmt.key), len(stmt.key), stmt.range_idx), stmt.if_not_exists)
        elif isinstance(stmt, dialect.CreateIndex):
            self._create_index(stmt)
        elif isinstance(stmt, dialect.Drop):
            self._drop(stmt)
        elif isinstance(stmt, dialect.Truncate):
            store = self.store(self.catalog.table(stmt.table))
            if isinstance(store, ExternalStore):
                raise unsupported("registered files are read-only")
            store.truncate()
        elif isinstance(stmt, dialect.Describe):
            meta = self.catalog.table(stmt.table)
            rows = [(c.name, c.col_id, c.type_name.lower(), c.primary) for c in meta.columns]
            return self.spark.createDataFrame(rows, "name string, col_id int, type string, is_pk boolean")
        return None

    def _create_index(self, stmt: dialect.CreateIndex) -> None:
        meta = self.catalog.table(stmt.table)
        columns = [meta.column(c) for c in stmt.columns]
        if None in columns:
            raise ddl("unsupported index column")
        families = {c.ctype.kind.family for c in columns}
        if "vector" in families:
            if len(columns) != 1:
                raise ddl("a vector index takes one column")
            kind = "vector"
        elif families - {"int", "float"}:
            raise ddl("unsupported index column")
        else:
            kind = "range"
        self.catalog.add_index(meta, IndexMeta(stmt.name.lower(), kind, [c.name for c in columns]))
        store = self.store(meta)
        if kind == "range" and isinstance(store, TableStore):
            store.compact(force=True)  # sorts what is stored by the new index

    def _drop(self, stmt: dialect.Drop) -> None:
        if stmt.kind == "keyspace":
            self.catalog.drop_keyspace(stmt.name[-1])
        elif stmt.kind == "index":
            self.catalog.drop_index(stmt.name[-1].lower(), self.catalog.table(stmt.table) if stmt.table else None, stmt.name[0].lower() if len(stmt.name) > 1 else None)
        else:
            meta = self.catalog.table(stmt.name)
            store = self.store(meta)
            self.catalog.drop_table(meta)
            self._stores.pop((meta.keyspace, meta.name), None)
            if isinstance(store, TableStore):
                delete_path(self.spark, store.folder)

    # -- other entry points ------------------------------------------------------------------------
    def spark_sql(self, text: str, **args: object) -> DataFrame:
        """Spark SQL over the current rows: every ``keyspace.table`` of the catalog is a view."""
        parts = _STRINGS.split(text)  # every second part is a string or a quoted name
        for (ks, name), meta in self.catalog.tables.items():
            spelled = re.compile(rf"\b{re.escape(ks)}\s*\.\s*{re.escape(name)}\b", re.I)
            if any(spelled.search(p) for p in parts[::2]):
                self.store(meta).view().createOrReplaceTempView(f"{ks}__{name}")
                parts[::2] = [spelled.sub(f"{ks}__{name}", p) for p in parts[::2]]
        text = "".join(parts)
        return self.spark.sql(text, args=args or None)

    def knn(self, name: str, column: str, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
        meta = self.meta(name)
        return vector.knn(self.view(name), column, query, k, key=meta.key, metric=metric)

    def text(self, statement: str, args: Sequence[object] = ()) -> str:
        """The text form of a statement's result."""
        df = self.sql(statement, args)
        if df is None:
            return "OK\n"
        parsed, _ = dialect.parse(statement)
        types = {c.name: c.ctype for c in self.catalog.table(parsed.table).columns} if isinstance(parsed, dialect.Select) else {}
        return render.to_text(df, types)

    def zone_map(self, name: str) -> list[dict]:
        """Path, rows, transaction range and key range of every commit."""
        return self.store(self.meta(name)).zone_map()

    def session(self) -> Session:
        return Session(self)


def _raise(e: Exception):
    raise e


class Session:
    """Prepared statements, which belong to the session that made them."""

    _ids = itertools.count(1)

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self._prepared: dict[int, tuple[object, int]] = {}
        self.open = True

    def _check(self) -> None:
        if not self.open:
            raise EngineError(ErrorCode.CONNECTION_CLOSED, "the session is closed")

    def prepare(self, text: str) -> tuple[int, int]:
        """(statement id, number of placeholders)"""
        self._check()
        stmt, n = dialect.parse(text)
        if not isinstance(stmt, (dialect.Select, dialect.Insert, dialect.Delete)):
            raise unsupported("only SELECT, INSERT and DELETE can be prepared")
        number = next(self._ids)
        self._prepared[number] = (self.engine.bind(stmt), n)
        return number, n

    def execute(self, number: int, args: Sequence[object] = ()) -> DataFrame | None:
        self._check()
        if number not in self._prepared:
            raise EngineError(ErrorCode.PROTOCOL_BAD_PREPARED_ID, f"no prepared statement {number}")
        bound, n = self._prepared[number]
        if n != len(args):
            raise EngineError(ErrorCode.PROTOCOL_BAD_PREPARED_VALUE, f"the statement has {n} placeholders, {len(args)} values were given")
        return self.engine.run(with_arguments(bound, list(args), self.engine.wide_long))

    def deallocate(self, number: int) -> None:
        self._check()
        if self._prepared.pop(number, None) is None:
            raise EngineError(ErrorCode.PROTOCOL_BAD_PREPARED_ID, f"no prepared statement {number}")

    def status(self) -> dict:
        return {"open": self.open, "prepared": len(self._prepared)}

    def close(self) -> None:
        self._prepared.clear()
        self.open = False
