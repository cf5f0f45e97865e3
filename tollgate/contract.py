"""The purchase contract, declared once: fields, bounds, defaults, reasons, and the Spark types of what is stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import types as T

VERSION = "0.1.0"
#: How far an event may be ahead of the clock.
SKEW_MINUTES = 5

# The closed sets and codes that producers, tables and reports share.
CURRENCIES = ["PLN", "EUR", "USD", "GBP", "CZK"]
CHANNELS = ["organic", "cpc", "email", "referral", "social", "direct", "affiliate"]
STAGES = ["source", "ingest", "batch"]

# Reasons from the most to the least important.
REASONS = [
    "malformed_payload",
    "unexpected_field",
    "missing_field",
    "type_mismatch",
    "unsupported_currency",
    "non_positive_amount",
    "out_of_range",
    "future_timestamp",
    "value_mismatch",
    "duplicate_transaction",
    "schema_violation",
]

# The codes of each reason that has its own codes.
CODES = {
    "missing_field": ["missing"],
    "unexpected_field": ["extra_forbidden"],
    "non_positive_amount": ["greater_than", "greater_than_equal"],
    "out_of_range": ["less_than", "less_than_equal", "too_long", "too_short", "string_too_long", "string_too_short", "string_pattern_mismatch", "decimal_max_digits", "decimal_max_places"],
    "future_timestamp": ["future_timestamp"],
    "value_mismatch": ["value_mismatch"],
}
#: Codes that end so, and these codes, are type mismatches.
TYPE_ENDINGS, TYPE_CODES = ["_type", "_parsing"], ["is_instance_of", "timezone_aware"]
DUPLICATE_CODE, MALFORMED_CODE = "DuplicateTransactionError", "json_invalid"

ACCEPTED, REPLAYED, REJECTED = "accepted", "replayed", "rejected"


@dataclass(frozen=True)
class Field:
    """One field: its kind decides how it is read, the rest bounds it."""

    name: str
    kind: str  # text, uuid, choice, money, whole, moment, record or records
    shortest: int | None = None
    longest: int | None = None
    pattern: str | None = None
    choices: tuple[str, ...] = ()
    above: int | None = None  # exclusive
    at_least: int | None = None
    at_most: int | None = None
    default: Any = None
    has_default: bool = False
    nullable: bool = False
    fields: tuple[Field, ...] = ()
    title: str = ""

    @property
    def required(self) -> bool:
        return not self.has_default


@dataclass(frozen=True)
class Kind:
    """A kind of scalar field that is added to the contract's own: its rules, in order, and what is stored.

    broken: from the field, its text and the name of its JSON type (STRING, BIGINT, ...) to conditions with code and message;
    value: from the field and its text to a Column of the type.
    """

    broken: Callable[[Field, Column, Column], list[tuple[Column, str, str]]]
    value: Callable[[Field, Column], Column]
    type: T.DataType


#: Added kinds by name.
KINDS: dict[str, Kind] = {}

MONEY_DIGITS, MONEY_PLACES = 12, 2
MONEY = T.DecimalType(MONEY_DIGITS, MONEY_PLACES)


def money(name: str, **bounds: Any) -> Field:
    return Field(name, "money", **bounds)


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    version: str = VERSION
    title: str = ""

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    @property
    def required(self) -> list[str]:
        return sorted(f.name for f in self.fields if f.required)

    @property
    def schema(self) -> T.StructType:
        return struct_of(self.fields)


def type_of(f: Field) -> T.DataType:
    if f.kind in ("record", "records"):
        inner = struct_of(f.fields)
        return T.ArrayType(inner, False) if f.kind == "records" else inner
    if f.kind in KINDS:
        return KINDS[f.kind].type
    return {"text": T.StringType(), "uuid": T.StringType(), "choice": T.StringType(), "money": MONEY, "whole": T.LongType(), "moment": T.TimestampType()}[f.kind]


def struct_of(fields: tuple[Field, ...]) -> T.StructType:
    described = lambda f: {"comment": "One of: " + ", ".join(f.choices)} if f.choices else {}
    return T.StructType([T.StructField(f.name, type_of(f), f.nullable, described(f)) for f in fields])


PURCHASE = Contract(
    title="PurchaseEvent",
    fields=(
        Field("event_id", "uuid"),
        Field("transaction_id", "text", 6, 64, pattern="^[A-Za-z0-9][A-Za-z0-9._-]*$"),
        Field("customer_id", "text", 1, 64),
        Field("currency", "choice", choices=tuple(CURRENCIES), title="Currency"),
        money("value", above=0),
        money("shipping", at_least=0, default="0.00", has_default=True),
        money("discount", at_least=0, default="0.00", has_default=True),
        Field(
            "items",
            "records",
            1,
            200,
            title="LineItem",
            fields=(Field("item_id", "text", 1, 64), Field("item_name", "text", 1, 200), money("price", above=0), Field("quantity", "whole", above=0, at_most=10_000)),
        ),
        Field("event_timestamp", "moment"),
        Field(
            "traffic_source",
            "record",
            title="TrafficSource",
            fields=(Field("source", "text", 1, 100), Field("medium", "choice", choices=tuple(CHANNELS), title="Channel"), Field("campaign", "text", None, 100, has_default=True, nullable=True)),
        ),
        Field("contract_version", "text", pattern="^[0-9]+\\.[0-9]+\\.[0-9]+$", default=VERSION, has_default=True),
    ),
)

ISSUE = T.StructType([T.StructField("field_path", T.StringType(), False), T.StructField("error_type", T.StringType(), False), T.StructField("message", T.StringType(), False), T.StructField("input_value", T.StringType())])

QUARANTINE = T.StructType(
    [
        T.StructField("rejected_at", T.TimestampType(), False),
        T.StructField("stage", T.StringType(), False, {"comment": "One of: " + ", ".join(STAGES)}),
        T.StructField("reason", T.StringType(), False, {"comment": "One of: " + ", ".join(REASONS)}),
        T.StructField("contract_version", T.StringType(), False),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("raw_payload", T.StringType(), False),
        T.StructField("issues", T.ArrayType(ISSUE, False), False),
    ]
)
#: How much of a path, message and input is kept.
PATH_CHARS, MESSAGE_CHARS, INPUT_CHARS = 200, 1000, 1000


def columns(ddl: str) -> T.StructType:
    """Nullable columns from "name type, ..." of simple types and maps from text; needs no session."""
    simple = {"string": T.StringType(), "binary": T.BinaryType(), "timestamp": T.TimestampType(), "int": T.IntegerType(), "bigint": T.LongType(), "counts": T.MapType(T.StringType(), T.LongType()), "texts": T.MapType(T.StringType(), T.StringType())}
    return T.StructType([T.StructField(name, simple[kind]) for name, kind in (c.split() for c in ddl.split(","))])


@dataclass(frozen=True)
class Settings:
    """What a consumer service is told by its environment."""

    root: str = "data"
    sink: str = "local"
    project: str | None = None
    port: int = 8080
    stage: str = "ingest"
    extra: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.sink not in ("local", "warehouse"):
            raise ValueError(f"unknown sink {self.sink!r}")
        if self.sink == "warehouse" and not self.project:
            raise ValueError("the warehouse sink needs a project")
        if not 1 <= int(self.port) <= 65535:
            raise ValueError(f"port {self.port} is not within 1 to 65535")
        if self.stage not in STAGES:
            raise ValueError(f"unknown stage {self.stage!r}")

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "TOLLGATE_") -> Settings:
        known = {k: env[prefix + k.upper()] for k in ("root", "sink", "project", "port", "stage") if prefix + k.upper() in env}
        return cls(**known | ({"port": int(known["port"])} if "port" in known else {}))
