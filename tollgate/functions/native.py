"""The contract on typed rows: the same issues from columns that are numbers, times and structs, without any JSON.

Strict as for objects in memory: text is no number and no time, a time without zone is none, a double is no amount. A null
is a missing field, as a row cannot leave one out. Columns of the wrong type give an issue for each row that has a value.
There is no column type for UUIDs, so those are text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.contract import ISSUE, KINDS, PURCHASE, SKEW_MINUTES, Contract, Field, type_of
from tollgate.functions.payload import fingerprint
from tollgate.functions.rules import AMOUNTS, RECORD_RULES, UUID, _bounded, digits, first_of, held, issue, items_total, let, typed_text

NONE = f"array<{ISSUE.simpleString()}>"
Get = Callable[[str], Column]


def none() -> Column:
    return F.array().cast(NONE)


def text_of(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else value.cast("string")


def below(path: Column | str, name: str) -> Column | str:
    return path + name if isinstance(path, str) else F.concat(path, F.lit(name))


def scalar(f: Field, kind: T.DataType, value: Column, path: Column | str, as_of: Column) -> Column:
    """The issue of a scalar that is not null, or NULL."""
    text = text_of(value, kind)
    broken = lambda code, message: lambda: issue(path, code, message, text)
    always = F.lit(True)
    string = isinstance(kind, (T.StringType, T.CharType, T.VarcharType))
    rules: list[tuple[Column, Callable[[], Column]]] = []
    if f.kind == "text":
        if not string:
            return broken("string_type", "The column should hold text")()
        if f.shortest:
            rules.append((F.length(value) < f.shortest, broken("string_too_short", f"At least {f.shortest} characters are needed")))
        if f.longest:
            rules.append((F.length(value) > f.longest, broken("string_too_long", f"At most {f.longest} characters are allowed")))
        if f.pattern:
            rules.append((~value.rlike(f.pattern[:-1] + r"\z"), broken("string_pattern_mismatch", f"Input should match {f.pattern}")))
    elif f.kind == "uuid":
        if not string:
            return broken("uuid_type", "The column should hold UUIDs as text")()
        rules.append((~value.rlike(UUID), broken("uuid_parsing", "Input is no UUID")))
    elif f.kind == "choice":
        rules.append((~value.isin(*f.choices) if string else always, broken("enum", "Input should be one of: " + ", ".join(f.choices))))
    elif f.kind == "money":
        if not isinstance(kind, (T.DecimalType, T.IntegralType)):
            return broken("decimal_type", "The column should hold decimals")()
        return let(digits(text), lambda d: _bounded(f, d, text, path))
    elif f.kind == "whole":
        if not isinstance(kind, T.IntegralType):
            return broken("int_type", "The column should hold whole numbers")()
        if f.above is not None:
            rules.append((value <= f.above, broken("greater_than", f"Input should be greater than {f.above}")))
        if f.at_most is not None:
            rules.append((value > f.at_most, broken("less_than_equal", f"Input should be {f.at_most} or less")))
    elif f.kind == "moment":
        if isinstance(kind, T.TimestampNTZType):
            return broken("timezone_aware", "The column's times should have a zone")()
        if not isinstance(kind, T.TimestampType):
            return broken("datetime_type", "The column should hold times")()
        rules.append((value > as_of + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES"), broken("future_timestamp", "The time is ahead of the clock")))
    elif f.kind in KINDS:
        name = "STRING" if string else kind.simpleString().upper()
        rules += [(condition, broken(code, message)) for condition, code, message in KINDS[f.kind].broken(f, text, F.lit(name))]
    return first_of(*rules) if rules else F.lit(None).cast(ISSUE)


def of_field(f: Field, kind: T.DataType, value: Column, path: Column | str, as_of: Column) -> Column:
    """All issues of a field that is not null."""
    one = lambda code, message: F.array(issue(path, code, message, text_of(value, kind)))
    if f.kind == "record":
        if not isinstance(kind, T.StructType):
            return one("model_type", "The column should hold structs")
        return of_record(f.fields, kind, lambda name: value.getField(name), below(path, "."), as_of, text_of(value, kind))
    if f.kind == "records":
        if not isinstance(kind, T.ArrayType):
            return one("list_type", "The column should hold arrays")
        inner = kind.elementType

        def element(x: Column, i: Column) -> Column:
            place = F.concat(F.lit(below(path, ".")) if isinstance(path, str) else below(path, "."), i.cast("string"))
            wrong = lambda p: F.array(issue(p, "model_type", "Elements should be structs", text_of(x, inner)))
            if not isinstance(inner, T.StructType):
                return let(place, wrong)
            return let(place, lambda p: F.when(x.isNull(), wrong(p)).otherwise(of_record(f.fields, inner, lambda n: x.getField(n), F.concat(p, F.lit(".")), as_of, text_of(x, inner))))

        every = F.flatten(F.transform(value, element))
        few, many = one("too_short", f"At least {f.shortest} elements are needed"), one("too_long", f"At most {f.longest} elements are allowed")
        return F.when(F.size(value) < f.shortest, few).when(F.size(value) > f.longest, many).otherwise(every)
    return F.array_compact(F.array(scalar(f, kind, value, path, as_of)))


def of_record(fields: tuple[Field, ...], kind: T.StructType, get: Get, path: Column | str, as_of: Column, whole: Column) -> Column:
    """All issues of a struct: its fields in order, then unknown ones that have a value."""
    kinds = {x.name: x.dataType for x in kind.fields}
    found: list[Column] = []
    for f in fields:
        at = below(path, f.name)
        missing = F.array(issue(at, "missing", "Field required", whole)) if f.required else none()
        value = get(f.name) if f.name in kinds else None
        found.append(missing if value is None else F.when(value.isNull(), missing).otherwise(of_field(f, kinds[f.name], value, at, as_of)))
    for name in sorted(set(kinds) - {f.name for f in fields}):
        extra = F.array(issue(below(path, name), "extra_forbidden", "The contract has no such field", text_of(get(name), kinds[name])))
        found.append(F.when(get(name).isNotNull(), extra).otherwise(none()))
    return F.concat(*found)


def stored(fields: tuple[Field, ...], kind: T.StructType, get: Get) -> Column:
    """The contract's struct of a record without issues."""
    kinds = {x.name: x.dataType for x in kind.fields}
    made = []
    for f in fields:
        if f.name not in kinds:
            out = F.lit(f.default).cast(type_of(f))
        elif f.kind == "record":
            out = stored(f.fields, kinds[f.name], lambda n, f=f: get(f.name).getField(n)) if isinstance(kinds[f.name], T.StructType) else F.lit(None).cast(type_of(f))
        elif f.kind == "records":
            inner = getattr(kinds[f.name], "elementType", None)
            out = F.transform(get(f.name), _element(f, inner)) if isinstance(inner, T.StructType) else F.lit(None).cast(type_of(f))
        elif f.kind in KINDS:
            out = KINDS[f.kind].value(f, text_of(get(f.name), kinds[f.name]))
        elif f.kind == "uuid" and isinstance(kinds[f.name], T.StringType):
            out = typed_text(f, get(f.name), get(f.name).isNull())
        else:
            out = get(f.name).try_cast(type_of(f))
            out = F.coalesce(out, F.lit(f.default).cast(type_of(f))) if f.has_default and f.default is not None else out
        made.append(out.alias(f.name))
    return F.struct(*made)


def _element(f: Field, inner: T.StructType) -> Callable[[Column], Column]:
    return lambda x: stored(f.fields, inner, lambda n: x.getField(n))


def check_typed(rows: DataFrame, contract: Contract = PURCHASE, as_of: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """What parse() gives, for typed rows: raw_payload (as JSON), transaction_id, event, fingerprint and issues.

    keep: columns that are no part of the record and stay.
    """
    now = F.current_timestamp() if as_of is None else as_of
    own = T.StructType([f for f in rows.schema.fields if f.name not in (keep or [])])
    get = lambda name: F.col(f"`{name}`")
    raw = F.to_json(F.struct(*[get(f.name).alias(f.name) for f in own.fields]))
    out = rows.select(*(keep or []), *[get(f.name) for f in own.fields], raw.alias("raw_payload"))
    out = out.withColumn("__found", held(of_record(contract.fields, own, get, "", now, F.col("raw_payload"))))
    out = out.withColumn("__event", held(F.when(F.size("__found") == 0, stored(contract.fields, own, get))))
    event = F.col("__event")
    if RECORD_RULES and set(contract.names) >= AMOUNTS:
        out = out.withColumn("__total", held(items_total(event["items"])))
        more = F.array_compact(F.array(*[rule(event, F.col("__total")) for rule in RECORD_RULES]))
        out = out.withColumn("__found", held(F.when(event.isNotNull(), more).otherwise(F.col("__found"))))
    clean = F.size("__found") == 0
    digest = fingerprint(event) if contract.names == PURCHASE.names else F.sha2(F.to_json(event), 256)
    named = any(f.name == "transaction_id" and isinstance(f.dataType, T.StringType) for f in own.fields)
    identity = get("transaction_id") if named else F.lit(None).cast("string")
    return out.select(
        *(keep or []), "raw_payload", identity.alias("transaction_id"), F.when(clean, event).alias("event"), F.when(clean, digest).alias("fingerprint"), F.col("__found").alias("issues")
    )
