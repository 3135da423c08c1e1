"""Keyspaces, tables and indexes, kept as one versioned JSON document.

An engine without a root keeps its catalog in memory only, which suits sessions over
registered files. Names are case-insensitive; tables are keyed by keyspace and name.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.errors import ddl, unknown
from keyloom.functions.types import ColumnType, parse_type
from keyloom.sources.manifest import commit_manifest, read_manifest

MAX_NAME_BYTES, MAX_KEY_COLUMNS, MAX_COLUMNS = 15, 3, 64


@dataclass
class ColumnMeta:
    name: str
    col_id: int
    type_name: str
    primary: bool = False

    @property
    def ctype(self) -> ColumnType:
        # registered files may hold vectors of no declared dimension
        kind, _, dim = self.type_name.partition("[")
        if not dim and kind.upper().endswith("_VECTOR"):
            from keyloom.functions.types import KINDS

            return ColumnType(KINDS[kind.upper()])
        return parse_type(self.type_name)


@dataclass
class IndexMeta:
    name: str
    kind: str  # range or vector
    columns: list[str]


@dataclass
class TableMeta:
    keyspace: str
    name: str
    columns: list[ColumnMeta]
    pk_size: int
    range_idx: bool = False
    indexes: list[IndexMeta] = field(default_factory=list)
    external: dict | None = None  # a registered file: path, version columns, unique keys
    sort_by: list[str] = field(default_factory=list)

    @property
    def qualified(self) -> str:
        return f"{self.keyspace}.{self.name}"

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns[: self.pk_size]]

    @property
    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> ColumnMeta | None:
        return next((c for c in self.columns if c.name == name.lower()), None)

    def schema(self, wide_long: bool = False) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.ctype.spark(wide_long), not c.primary, {"col_id": c.col_id, "type": c.type_name}) for c in self.columns])


def make_columns(declared: list[tuple[str, str]], key: list[str]) -> list[ColumnMeta]:
    """Key columns first, in key order, then the others as declared; all rules are checked."""
    names = [n.lower() for n, _ in declared]
    key = [k.lower() for k in key]
    if not key:
        raise ddl("no primary key")
    if len(key) > MAX_KEY_COLUMNS:
        raise ddl("pk columns number limited to 3")
    if len(declared) > MAX_COLUMNS:
        raise ddl(f"columns number limited to {MAX_COLUMNS}")
    if len(set(names)) != len(names) or len(set(key)) != len(key):
        raise ddl("column name dup")
    for n in names:
        if len(n.encode()) > MAX_NAME_BYTES:
            raise ddl(f"column name {n} is longer than {MAX_NAME_BYTES} bytes")
        if n.startswith("__"):
            raise ddl("column names beginning with __ are reserved")
    types = {n.lower(): parse_type(t).name for n, t in declared}
    missing = [k for k in key if k not in types]
    if missing:
        raise ddl("pk contains unknown column name")
    for k in key:
        if not parse_type(types[k]).kind.key:
            raise ddl("pk should be numeric type from short, int, long, timestamp")
    ordered = key + [n for n in names if n not in key]
    return [ColumnMeta(n, i, types[n], n in key) for i, n in enumerate(ordered)]


class Catalog:
    def __init__(self, spark: SparkSession, root: str | None) -> None:
        self.spark, self.root = spark, root
        found = read_manifest(spark, f"{root}/_catalog") if root else None
        self.version, state = found if found else (0, {"keyspaces": [], "tables": []})
        self.keyspaces: list[str] = list(state["keyspaces"])
        self.tables: dict[tuple[str, str], TableMeta] = {}
        for t in state["tables"]:
            t = dict(t)
            t["columns"] = [ColumnMeta(**c) for c in t["columns"]]
            t["indexes"] = [IndexMeta(**i) for i in t["indexes"]]
            meta = TableMeta(**t)
            self.tables[meta.keyspace, meta.name] = meta

    def save(self) -> None:
        if self.root:
            state = {"keyspaces": self.keyspaces, "tables": [asdict(t) for t in self.tables.values()]}
            commit_manifest(self.spark, f"{self.root}/_catalog", self.version + 1, state)
            self.version += 1

    def create_keyspace(self, name: str, if_not_exists: bool = False) -> None:
        name = name.lower()
        if name in self.keyspaces:
            if if_not_exists:
                return
            raise ddl(f"keyspace {name} already exists")
        self.keyspaces.append(name)
        self.save()

    def drop_keyspace(self, name: str) -> None:
        name = name.lower()
        if name not in self.keyspaces:
            raise unknown(f"keyspace {name} not exist")
        if any(ks == name for ks, _ in self.tables):
            raise ddl(f"keyspace {name} is not empty")
        self.keyspaces.remove(name)
        self.save()

    def add_table(self, meta: TableMeta, if_not_exists: bool = False) -> TableMeta:
        if meta.keyspace not in self.keyspaces:
            raise unknown(f"keyspace {meta.keyspace} not exist")
        at = (meta.keyspace, meta.name)
        if at in self.tables:
            if if_not_exists:
                return self.tables[at]
            raise ddl(f"table {meta.qualified} already exists")
        self.tables[at] = meta
        self.save()
        return meta

    def drop_table(self, meta: TableMeta) -> None:
        del self.tables[meta.keyspace, meta.name]
        self.save()

    def table(self, name: tuple[str, ...]) -> TableMeta:
        if len(name) != 2:
            raise ddl("query should contain keyspace & table names")
        ks, tbl = (n.lower() for n in name)
        if ks not in self.keyspaces:
            raise unknown(f"keyspace {ks} not exist")
        if (ks, tbl) not in self.tables:
            raise unknown(f"table {ks}.{tbl} not exist")
        return self.tables[ks, tbl]

    def add_index(self, meta: TableMeta, index: IndexMeta) -> None:
        if any(i.name == index.name for i in meta.indexes):
            raise ddl(f"index {index.name} already exists")
        meta.indexes.append(index)
        if index.kind == "range":
            meta.sort_by = index.columns
        self.save()

    def drop_index(self, name: str, table: TableMeta | None = None, keyspace: str | None = None) -> None:
        """Drop an index of ``table``; without a table its name must be that of one only, in
        the keyspace or anywhere."""
        owners = [m for m in ([table] if table else self.tables.values()) if any(i.name == name for i in m.indexes) and keyspace in (None, m.keyspace)]
        if not owners:
            raise unknown(f"index {name} not exist")
        if len(owners) > 1:
            raise ddl(f"index {name} exists in several tables; name the table")
        meta = owners[0]
        meta.indexes = [i for i in meta.indexes if i.name != name]
        ranges = [i for i in meta.indexes if i.kind == "range"]
        meta.sort_by = ranges[-1].columns if ranges else []
        self.save()


def declared_tables(columns: DataFrame) -> DataFrame:
    """One row per declared table of a column catalog: its key, its number of columns and its
    CREATE statement parts, in column order."""
    per = columns.groupBy("table_id", "table_name").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.max("pk_size").alias("pk_size"),
        F.bool_or("range_idx").alias("range_idx"),
        F.sort_array(F.collect_list(F.struct("col_id", "col_name", "data_type", "dimension", "is_pk"))).alias("cols"),  # at most 64 columns a table
    )
    spelled = F.transform("cols", lambda c: F.concat(c["col_name"], F.lit(" "), F.lower(c["data_type"]), F.when(c["dimension"] > 0, F.concat(F.lit("["), c["dimension"].cast("string"), F.lit("]"))).otherwise("")))
    key = F.transform(F.filter("cols", lambda c: c["is_pk"]), lambda c: c["col_name"])
    return per.select("table_id", "table_name", "n_columns", "pk_size", "range_idx", F.concat_ws(", ", spelled).alias("columns"), F.concat_ws(", ", key).alias("key"))
