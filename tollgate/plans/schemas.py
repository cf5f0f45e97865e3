"""The contract as warehouse columns and as JSON Schema."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import types as T

from tollgate.contract import MONEY_DIGITS, MONEY_PLACES, PURCHASE, QUARANTINE, Contract, Field

NAMES = {T.BooleanType: "BOOL", T.LongType: "INT64", T.IntegerType: "INT64", T.DoubleType: "FLOAT64", T.StringType: "STRING", T.TimestampType: "TIMESTAMP", T.DateType: "DATE"}
TABLES = {"events": PURCHASE.schema, "quarantine": QUARANTINE}


def warehouse_columns(schema: T.StructType) -> list[dict[str, Any]]:
    """Columns with type, mode and description; a type without a counterpart is an error."""
    return [warehouse_column(f) for f in schema.fields]


def warehouse_column(f: T.StructField) -> dict[str, Any]:
    kind, mode = f.dataType, "NULLABLE" if f.nullable else "REQUIRED"
    if isinstance(kind, T.ArrayType):
        kind, mode = kind.elementType, "REPEATED"
    out: dict[str, Any] = {"name": f.name}
    if isinstance(kind, T.StructType):
        out |= {"type": "RECORD", "fields": warehouse_columns(kind)}
    elif isinstance(kind, T.DecimalType):
        out |= {"type": "NUMERIC", "precision": str(kind.precision), "scale": str(kind.scale)}
    elif type(kind) in NAMES:
        out |= {"type": NAMES[type(kind)]}
    else:
        raise TypeError(f"no warehouse type for {kind.simpleString()} of column {f.name!r}")
    if "comment" in f.metadata:
        out["description"] = f.metadata["comment"]
    return out | {"mode": mode}


def write_schemas(folder: str | Path) -> list[Path]:
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    out = []
    for name, schema in TABLES.items():
        out.append(folder / f"{name}.json")
        out[-1].write_text(json.dumps(warehouse_columns(schema), indent=2) + "\n")
    return out


def json_schema(contract: Contract = PURCHASE) -> dict[str, Any]:
    """JSON Schema of what producers send. Rules across fields and on the clock can't be said in it."""
    defs: dict[str, Any] = {}
    body = _object(contract.fields, contract.title, defs)
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", **body, "$defs": dict(sorted(defs.items()))}


def _object(fields: tuple[Field, ...], title: str, defs: dict[str, Any]) -> dict[str, Any]:
    return {"type": "object", "title": title, "properties": {f.name: _property(f, defs) for f in fields}, "required": [f.name for f in fields if f.required], "additionalProperties": False}


def _property(f: Field, defs: dict[str, Any]) -> dict[str, Any]:
    out: dict[str, Any]
    if f.kind in ("record", "records"):
        defs[f.title] = _object(f.fields, f.title, defs)
        ref = {"$ref": f"#/$defs/{f.title}"}
        out = ref if f.kind == "record" else {"type": "array", "items": ref, "minItems": f.shortest, "maxItems": f.longest}
    elif f.kind == "choice":
        defs[f.title] = {"type": "string", "title": f.title, "enum": list(f.choices)}
        out = {"$ref": f"#/$defs/{f.title}"}
    elif f.kind == "money":
        number: dict[str, Any] = {"type": "number"} | ({"exclusiveMinimum": float(f.above)} if f.above is not None else {}) | ({"minimum": float(f.at_least)} if f.at_least is not None else {})
        out = {"anyOf": [number, {"type": "string", "pattern": rf"^[+-]?\d{{0,{MONEY_DIGITS - MONEY_PLACES}}}(\.\d{{0,{MONEY_PLACES}}}0*)?$"}]}
    elif f.kind == "whole":
        out = {"type": "integer"} | ({"exclusiveMinimum": f.above} if f.above is not None else {}) | ({"maximum": f.at_most} if f.at_most is not None else {})
    else:
        out = {"type": "string"} | {"uuid": {"format": "uuid"}, "moment": {"format": "date-time"}}.get(f.kind, {})
        out |= {k: v for k, v in (("minLength", f.shortest), ("maxLength", f.longest), ("pattern", f.pattern)) if v is not None}
    if f.nullable:
        out = {"anyOf": [out, {"type": "null"}]}
    return out | ({"default": f.default} if f.has_default else {})
