"""Payloads as Columns: validity, typed access through VARIANT, canonical text and fingerprints.

Nothing here runs Python per row. Objects are read as map<string, variant>: a missing key is SQL NULL, a JSON null is a
variant of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed: of equal keys in an object the last counts, as in common JSON parsers.
LAST_KEY = ("spark.sql.variant.allowDuplicateKeys", "true")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body uses it."""
    return F.transform(F.array(value), body).getItem(0)


def last_key_wins(spark: SparkSession) -> None:
    """Let the last of equal keys count. Variants take it from the session at run time, so it must be set there; a session
    that has a value of its own keeps it."""
    if spark.conf.get(LAST_KEY[0], None) in (None, "false"):
        spark.conf.set(*LAST_KEY)


def lossy_text(raw: Column) -> Column:
    """The payload as text, with U+FFFD for bytes that are no UTF-8."""
    return F.make_valid_utf8(raw.cast("string"))


def lone_surrogate(text: Column) -> Column:
    """Whether an escape stands for half a character, which no parser can read; pairs are one character."""
    hidden = F.regexp_replace(text, r"\\\\", "x")
    hidden = F.regexp_replace(hidden, r"(?i)\\ud[89ab][0-9a-f]{2}\\ud[c-f][0-9a-f]{2}", "x")
    return F.when(text.rlike(r"\\u[dD][89a-fA-F]"), hidden.rlike(r"(?i)\\ud[89a-f][0-9a-f]{2}")).otherwise(F.lit(False))


def wrapped(text: Column, mark: str) -> Column:
    """The text within an object of two keys: parsers stop at the end of the first document, so what the text opens,
    closes or adds shows in the keys, as it can't foresee the mark."""
    return F.when(F.is_valid_utf8(text) & ~lone_surrogate(text), F.concat(F.lit('{"r":'), text, F.lit(f',"{mark}":1}}')))


def unwrapped(w: Column, text: Column, mark: str) -> Column:
    """The text that wrapped() holds as a variant, NULL unless it is one document. With two keys it is, so it is parsed by itself:
    taken out of the wrap, it would be built anew."""
    keys = F.json_object_keys(w)
    return F.when((F.size(keys) == 2) & F.array_contains(keys, mark), F.try_parse_json(text))


def document(raw: Column) -> Column:
    """The payload as a variant, NULL if it is no single JSON document."""
    mark = uuid.uuid4().hex
    return unwrapped(wrapped(raw.cast("string"), mark), raw.cast("string"), mark)


def members(value: Column) -> Column:
    """An object variant as a map of variants, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def elements(value: Column) -> Column:
    """An array variant as an array of variants, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def kind(value: Column) -> Column:
    """The type of a scalar variant: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, or that of a container."""
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    return F.variant_get(value, "$", "string")


def transaction_id(raw: Column) -> Column:
    """The id of a payload that may be invalid otherwise; NULL unless it is a string in an object."""
    value = F.try_element_at(members(document(raw)), F.lit("transaction_id"))
    return F.when(kind(value) == "STRING", as_text(value))


def utc_text(moment: Column, pattern: str) -> Column:
    """A timestamp as text in UTC, whatever the session's time zone."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), moment.cast("timestamp_ntz")), pattern)


def canonical(event: Column) -> Column:
    """An event as compact JSON: fields in the contract's order, amounts with two places as text, times in UTC."""
    amount = lambda c: c.cast("string")
    item = lambda i: F.struct(i["item_id"].alias("item_id"), i["item_name"].alias("item_name"), amount(i["price"]).alias("price"), i["quantity"].alias("quantity"))
    plain = {"value", "shipping", "discount"}
    names = ["event_id", "transaction_id", "customer_id", "currency", "value", "shipping", "discount", "items", "event_timestamp", "traffic_source", "contract_version"]
    made = []
    for n in names:
        c = event[n]
        if n in plain:
            c = amount(c)
        elif n == "items":
            c = F.transform(c, item)
        elif n == "event_timestamp":
            c = utc_text(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        made.append(c.alias(n))
    return F.to_json(F.struct(*made), {"ignoreNullFields": "false"})


def fingerprint(event: Column) -> Column:
    """A digest of an event's content, whatever its formatting."""
    return F.sha2(canonical(event), 256)
