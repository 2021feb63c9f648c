"""Shaping profiles by a configuration of paths."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import tasks

STEP = re.compile(r"([A-Za-z_]\w*)(?:\[(\*|\d+)\])?$")
ON_MISSING = ("null", "skip")
#: A JSON text of printable characters without escapes.
SIMPLE_TEXT = r'^"[^"\\\x00-\x1F]*"\z'


def validate(config: dict[str, Any]) -> list[str]:
    """What is wrong with a configuration; empty if nothing."""
    issues = []
    if config.get("on_missing", "null") not in ON_MISSING:
        issues.append(f"on_missing must be one of {', '.join(ON_MISSING)}, not {config['on_missing']!r}")
    for i, entry in enumerate(config.get("fields") or []):
        if not isinstance(entry, dict) or not entry.get("path"):
            issues.append(f"fields[{i}] has no path")
        elif any(not STEP.match(s) for s in str(entry.get("from", entry["path"])).split(".")):
            issues.append(f"fields[{i}] has a malformed source path: {entry.get('from')!r}")
    return issues


def member(name: str):
    return lambda x: x[name]


def read_path(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """The expression of a.b, a[i], a[*] or a[*].b over a profile; None if the schema has no such path."""
    at: Column | None = None
    kind: T.DataType = schema
    many = False
    for step in path.split("."):
        m = STEP.match(step)
        if not m or not isinstance(kind, T.StructType) or m[1] not in kind.names:
            return None
        name, index, kind = m[1], m[2], kind[m[1]].dataType
        at = F.col(name) if at is None else (F.transform(at, member(name)) if many else at[name])
        if index is None:
            continue
        if many or not isinstance(kind, T.ArrayType):
            return None
        kind = kind.elementType
        if index == "*":
            many = True
        else:
            at = F.get(at, F.lit(int(index)))
    return at, T.ArrayType(kind) if many else kind


def nested(fields: list[tuple[list[str], Column]]) -> list[Column]:
    """Columns for paths: those with the same first part become one struct."""
    groups: dict[str, list[tuple[list[str], Column]]] = {}
    for path, value in fields:
        groups.setdefault(path[0], []).append((path[1:], value))
    out = []
    for name, inner in groups.items():
        deeper = [x for x in inner if x[0]]
        out.append((F.struct(*nested(deeper)) if deeper else inner[-1][1]).alias(name))
    return out


def project(profiles: DataFrame, config: dict[str, Any] | None = None, provenance: DataFrame | None = None) -> DataFrame:
    """Profiles in the shape that ``config`` asks for; without fields, whole profiles.

    A path that profiles do not have is null, or left out with on_missing "skip". ``to_json`` leaves out
    null values row by row. ``_confidence.overall`` and ``_provenance`` are added on demand.
    """
    config = config or {}
    fields = []
    for entry in config.get("fields") or []:
        found = read_path(profiles.schema, str(entry.get("from", entry["path"])))
        if found or config.get("on_missing", "null") != "skip":
            fields.append((str(entry["path"]).split("."), found[0] if found else F.lit(None).cast("string")))
    columns = nested(fields) if config.get("fields") else [F.col(c) for c in profiles.columns if c != "cluster_id"]
    if config.get("include_confidence"):
        columns.append(F.struct(F.col("overall_confidence").alias("overall")).alias("_confidence"))
    if config.get("include_provenance") and provenance is not None:
        n = tasks(profiles)
        parsed = lambda v: F.coalesce(F.try_variant_get(F.try_parse_json(v), "$", "string"), v)
        # most values are texts without escapes, which need no parser; each is read once, however many profiles share an id
        plain = F.when(F.col("value").rlike(SIMPLE_TEXT), F.substr("value", F.lit(2), F.length("value") - 2)).otherwise(parsed(F.col("value")))
        row = F.struct("ord", "field", "value", "source", "source_path", "method", "confidence", plain.alias("plain"))
        shown = lambda p: F.struct(p["field"].alias("field"), p["plain"].alias("value"), p["source"].alias("source"), p["source_path"].alias("source_path"), p["method"].alias("method"), p["confidence"].alias("confidence"))
        log = provenance.repartition(n, "candidate_id").groupBy("candidate_id").agg(F.transform(F.sort_array(F.collect_list(row)), shown).alias("_p"))
        profiles = profiles.repartition(n, "candidate_id").join(log, "candidate_id", "left")
        columns.append(F.coalesce("_p", F.array()).alias("_provenance"))
    return profiles.select(*columns)


def to_json(projected: DataFrame, config: dict[str, Any] | None = None) -> DataFrame:
    """(json) of each row; nulls are kept unless on_missing is "skip"."""
    keep = "true" if (config or {}).get("on_missing") == "skip" else "false"
    return projected.select(F.to_json(F.struct("*"), {"ignoreNullFields": keep}).alias("json"))
