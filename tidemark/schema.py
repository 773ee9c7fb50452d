"""Schema contracts: conform frames, detect drift, summarise."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Cast to ``schema``: missing columns become typed nulls, order follows the schema."""
    have = set(df.columns)
    columns = [
        (F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    extra = [F.col(c) for c in df.columns if keep_extra and c not in schema.fieldNames()]
    return df.select(*columns, *extra)


def with_defaults(df: DataFrame, defaults: Mapping[str, object], types: Mapping[str, str] | None = None) -> DataFrame:
    """Add missing columns and fill their nulls with a default (0, "UNKNOWN", or a typed null)."""
    types = types or {}
    columns = {}
    for name, value in defaults.items():
        default: Column = F.lit(value)
        if name in types:
            default = default.cast(types[name])
        columns[name] = F.coalesce(F.col(name), default) if name in df.columns else default
    return df.withColumns(columns)


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Row union over the union of columns; numeric types widen, other conflicts become strings."""
    order: list[str] = []
    kinds: dict[str, list[T.DataType]] = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name not in kinds:
                order.append(f.name)
            kinds.setdefault(f.name, []).append(f.dataType)
    target = T.StructType([T.StructField(n, _widest(kinds[n])) for n in order])
    out = None
    for df in frames:
        part = conform(df, target)
        out = part if out is None else out.unionByName(part)
    return out


# Fixed order of widening.
_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _widest(types: Sequence[T.DataType]) -> T.DataType:
    names = {t.simpleString() for t in types} - {"void"}
    if not names:
        return T.StringType()
    if len(names) == 1:
        return next(t for t in types if t.simpleString() in names)
    if names <= set(_NUMERIC):
        if names & {"float", "double"} and names & {"int", "bigint"}:
            return T.DoubleType()
        widest = max(names, key=_NUMERIC.index)
        return next(t for t in types if t.simpleString() == widest)
    if names <= {"date", "timestamp"}:
        return T.TimestampType()
    if names <= {"date", "timestamp_ntz"}:
        return T.TimestampNTZType()
    return T.StringType()


def schema_hash(df: DataFrame) -> str:
    """md5 over the sorted ``name:type`` pairs; equal for equal schemas in any column order."""
    text = "|".join(sorted(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields))
    return hashlib.md5(text.encode()).hexdigest()


@dataclass
class Drift:
    changed: bool
    added: list[str] = field(default_factory=list)
    removed: list[str] = field(default_factory=list)
    retyped: list[str] = field(default_factory=list)


def schema_drift(df: DataFrame, expected: T.StructType) -> Drift:
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in expected.fields}
    added = sorted(set(have) - set(want))
    removed = sorted(set(want) - set(have))
    retyped = sorted(n for n in set(have) & set(want) if have[n] != want[n])
    return Drift(bool(added or removed or retyped), added, removed, retyped)


def missing_columns(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> dict[str, list[str]]:
    have = set(df.columns)
    return {
        "missing_required": [c for c in required if c not in have],
        "missing_optional": [c for c in optional if c not in have],
        "unexpected": sorted(have - set(required) - set(optional)),
    }


def schema_summary(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, nulls and null share. One pass over the data."""
    aggs = [F.count(F.lit(1)).alias("_rows")] + [
        F.count(F.when(F.col(f"`{f.name}`").isNull(), 1)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)
    ]
    wide = df.agg(*aggs)
    entries = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"n{i}").alias("nulls"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return wide.select("_rows", F.explode(entries).alias("e")).select(
        F.col("e.column").alias("column"),
        F.col("e.type").alias("type"),
        F.col("_rows").alias("rows"),
        F.col("e.nulls").alias("nulls"),
        F.when(F.col("_rows") > 0, F.col("e.nulls") / F.col("_rows")).alias("null_share"),
    )


def schema_snapshot(df: DataFrame, tags: Mapping[str, str] | None = None) -> str:
    """JSON text of the schema with a tag per column, for storage next to a dataset."""
    tags = tags or {}
    columns = [
        {"name": f.name, "type": f.dataType.simpleString(), "tag": tags.get(f.name, "feature")} for f in df.schema.fields
    ]
    return json.dumps({"hash": schema_hash(df), "columns": columns}, indent=2, sort_keys=True)
