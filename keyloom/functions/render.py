"""Text form of a result: a count line and one line per row, nulls left out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from keyloom.functions.types import ColumnType, from_spark, render_value


def to_text(df: DataFrame, types: dict[str, ColumnType] | None = None) -> str:
    """Rows are streamed partition by partition; meant for results a person reads."""
    types = types or {}
    kinds = [(f.name, types.get(f.name) or from_spark(f.dataType)) for f in df.schema.fields]
    rows = []
    for r in df.toLocalIterator():
        cells = [f'"{n}":"{render_value(r[n], t)}"' for n, t in kinds if r[n] is not None]
        rows.append("row: {" + ",".join(cells) + "}\n")
    return f"Rows count: {len(rows)}\n" + "".join(rows)
