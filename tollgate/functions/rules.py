"""Field rules as Columns: what a field's variant says against the contract, and its typed value.

A rule gives an issue struct or NULL. A field's rules are tried in order and the first that is broken counts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.contract import INPUT_CHARS, ISSUE, KINDS, MESSAGE_CHARS, MONEY_DIGITS, MONEY_PLACES, PATH_CHARS, SKEW_MINUTES, Field, type_of
from tollgate.functions.payload import as_text, canonical, elements, kind, let, members

UUID = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9a-fA-F]{32}|urn:uuid:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|\{[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\})\z"
DECIMAL = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
NOT_FINITE = r"(?i)^[+-]?(?:inf(?:inity)?|s?nan[0-9]*)\z"
MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt _][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]{1,9})?)?"
ZONE = r"(?:[Zz]|[+-][0-9]{2}:?[0-9]{2})\z"


def held(value: Column) -> Column:
    """value, kept from being copied into later conditions and projections: it would be computed once for each use."""
    return F.when(F.spark_partition_id() >= 0, value)


def issue(path: Column | str, code: str, message: Column | str, value: Column) -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(
        F.substring(text(path), 1, PATH_CHARS).alias("field_path"),
        F.lit(code).alias("error_type"),
        F.substring(F.coalesce(text(message), F.lit("")), 1, MESSAGE_CHARS).alias("message"),
        F.substring(value, 1, INPUT_CHARS).alias("input_value"),
    )


def first_of(*rules: tuple[Column, Callable[[], Column]]) -> Column:
    """The issue of the first condition that holds."""
    out = None
    for holds, make in rules:
        out = F.when(holds, make()) if out is None else out.when(holds, make())
    return out


def amount(text: Column) -> Column:
    """A decimal's text as a number; NULL if it is none or has over 20 whole digits."""
    return F.when(text.rlike(DECIMAL), text.try_cast("decimal(38,18)"))


def digits(text: Column) -> Column:
    """A decimal's text as struct (number, whole, places): zeros that don't count are left out of the digits."""
    plain = F.regexp_replace(F.when(text.rlike("[eE]"), amount(text).cast("string")).otherwise(text), "^[+-]", "")
    whole = F.length(F.regexp_extract(plain, r"^0*([0-9]*)", 1))
    places = F.length(F.regexp_replace(F.regexp_extract(plain, r"\.([0-9]*)", 1), "0+$", ""))
    return F.struct(amount(text).alias("number"), whole.alias("whole"), places.alias("places"))


def moment(text: Column) -> Column:
    zoned = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[_t ]", "T"), ",", "."), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    zoned = F.regexp_replace(F.upper(zoned), r"(T[0-9]{2}:[0-9]{2})(Z|[+-])", "$1:00$2")
    return F.try_to_timestamp(zoned)


def checked(f: Field, value: Column, path: Column | str, as_of: Column, lax: bool) -> Column:
    """The issue of one scalar field's variant, or NULL."""
    return let(F.struct(as_text(value).alias("text"), kind(value).alias("kind")), lambda v: _checked(f, v.getField("text"), v.getField("kind"), path, as_of, lax))


def _checked(f: Field, text: Column, of: Column, path: Column | str, as_of: Column, lax: bool, size: Column | None = None) -> Column:
    """The same of its text and kind; size: what digits() gives for an amount, if it is at hand."""
    broken = lambda code, message: lambda: issue(path, code, message, text)
    string = of == "STRING"
    null = F.when(F.lit(f.nullable) & (of == "VOID"), F.lit(True)).otherwise(F.lit(False))
    rules: list[tuple[Column, Callable[[], Column]]] = [(null, lambda: F.lit(None).cast(ISSUE))]
    if f.kind == "text":
        rules.append((~string, broken("string_type", "Input should be a string")))
        if f.shortest:
            rules.append((F.length(text) < f.shortest, broken("string_too_short", f"At least {f.shortest} characters are needed")))
        if f.longest:
            rules.append((F.length(text) > f.longest, broken("string_too_long", f"At most {f.longest} characters are allowed")))
        if f.pattern:
            rules.append((~text.rlike(f.pattern[:-1] + r"\z"), broken("string_pattern_mismatch", f"Input should match {f.pattern}")))
    elif f.kind == "uuid":
        rules += [(~string, broken("uuid_type", "Input should be a UUID")), (~text.rlike(UUID), broken("uuid_parsing", "Input is no UUID"))]
    elif f.kind == "choice":
        rules.append((~string | ~text.isin(*f.choices), broken("enum", "Input should be one of: " + ", ".join(f.choices))))
    elif f.kind == "money":
        trimmed = F.trim(text)
        rules += [
            (~string & ~of.startswith("BIGINT") & ~of.startswith("DECIMAL") & ~of.startswith("DOUBLE"), broken("decimal_type", "Input should be a decimal, as text or number")),
            (trimmed.rlike(NOT_FINITE), broken("finite_number", "Input should be a finite number")),
            (~trimmed.rlike(DECIMAL), broken("decimal_parsing", "Input is no decimal")),
        ]
        return first_of(*rules, (F.lit(True), lambda: _bounded(f, size, text, path) if size is not None else let(digits(trimmed), lambda d: _bounded(f, d, text, path))))
    elif f.kind == "whole":
        huge = of.rlike(r"^DECIMAL\((?:19|[23][0-9]),0\)")
        number = text.try_cast("decimal(38,0)")
        fits = (of == "BIGINT") | huge
        if lax:
            fits = fits | (string & text.rlike(r"^\s*[+-]?[0-9]+(?:\.0*)?\s*$")) | of.rlike(r"^DECIMAL\([0-9]+,0\)") | ((of == "DOUBLE") & (text.try_cast("double") % 1 == 0))
            number = F.trim(text).try_cast("decimal(38,0)")
            rules.append((string & ~fits, broken("int_parsing", "Input is no whole number")))
        rules.append((~fits, broken("int_type", "Input should be a whole number")))
        if f.above is not None:
            rules.append((number <= f.above, broken("greater_than", f"Input should be greater than {f.above}")))
        if f.at_most is not None:
            rules.append((number > f.at_most, broken("less_than_equal", f"Input should be {f.at_most} or less")))
    elif f.kind == "moment":
        known, ts = text.rlike(MOMENT + f"(?:{ZONE})?" + r"\z") | text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), moment(text)
        ahead = F.format_string(f"%s is over {SKEW_MINUTES} minutes later than %s", text, F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ssXXX"))
        rules += [
            (~string, broken("datetime_type", "Input should be a time")),
            (~known | ts.isNull(), broken("datetime_parsing", "Input is no time")),
            (~text.rlike(":[^:].*" + ZONE) | text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), broken("timezone_aware", "Input should have a time zone")),
            (ts > as_of + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES"), lambda: issue(path, "future_timestamp", ahead, text)),
        ]
    elif f.kind in KINDS:
        rules += [(condition, broken(code, message)) for condition, code, message in KINDS[f.kind].broken(f, text, of)]
    else:
        raise ValueError(f"unknown kind of field {f.kind!r}")
    return first_of(*rules)


def typed(f: Field, value: Column) -> Column:
    """The stored value of a valid scalar field's variant."""
    return typed_text(f, as_text(value), value.isNull())


def typed_text(f: Field, text: Column, missing: Column) -> Column:
    """The stored value of a valid scalar field, from its text."""
    if f.kind == "uuid":
        bare = F.regexp_replace(F.lower(text), "urn:uuid:|[^0-9a-f]", "")
        out = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    elif f.kind == "money":
        out = amount(F.trim(text)).try_cast(type_of(f))
    elif f.kind == "whole":
        out = F.trim(text).try_cast("decimal(38,0)").try_cast("bigint")
    elif f.kind == "moment":
        out = moment(text)
    elif f.kind in KINDS:
        out = KINDS[f.kind].value(f, text)
    else:
        out = text
    if f.has_default and f.default is not None:
        out = F.when(missing, F.lit(f.default).cast(type_of(f))).otherwise(out)
    return out


def _bounded(f: Field, d: Column, text: Column, path: Column | str) -> Column:
    """The issue of a decimal's size."""
    number, whole, places = (d.getField(n) for n in ("number", "whole", "places"))
    broken = lambda code, message: lambda: issue(path, code, message, text)
    total = F.when(places > 0, whole + places).otherwise(F.greatest(whole, F.lit(1)))
    rules = [
        (number.isNull() | (total > MONEY_DIGITS), broken("decimal_max_digits", f"At most {MONEY_DIGITS} digits are allowed")),
        (places > MONEY_PLACES, broken("decimal_max_places", f"At most {MONEY_PLACES} places are allowed")),
        (whole > MONEY_DIGITS - MONEY_PLACES, broken("decimal_whole_digits", f"At most {MONEY_DIGITS - MONEY_PLACES} digits before the point are allowed")),
    ]
    if f.above is not None:
        rules.append((number <= f.above, broken("greater_than", f"Input should be greater than {f.above}")))
    if f.at_least is not None:
        rules.append((number < f.at_least, broken("greater_than_equal", f"Input should be {f.at_least} or more")))
    return first_of(*rules)


def of_fields(fields: tuple[Field, ...], have: Column, path: Column | str, whole: Column, as_of: Column, lax: bool) -> Column:
    """All issues (an array) of an object's map of variants: fields in order, then unknown keys."""
    under = lambda name: (path + name if isinstance(path, str) else F.concat(path, F.lit(name)))
    found: list[Column] = []
    none = F.array().cast(f"array<{ISSUE.simpleString()}>")
    for f in fields:
        value, at = F.try_element_at(have, F.lit(f.name)), under(f.name)
        missing = F.array(issue(at, "missing", "Field required", whole))
        if f.kind == "record":
            made = _record_issues(f, value, at, under(f"{f.name}."), as_of, lax)
        elif f.kind == "records":
            made = _list_issues(f, value, at, under(f"{f.name}."), as_of, lax)
        else:
            made = F.array_compact(F.array(checked(f, value, at, as_of, lax)))
        found.append(F.when(value.isNull(), missing if f.required else none).otherwise(made))
    names = F.array(*[F.lit(f.name) for f in fields])
    extra = F.transform(F.array_except(F.map_keys(have), names), lambda k: issue(F.concat(F.lit(path) if isinstance(path, str) else path, k), "extra_forbidden", "Extra inputs are not permitted", as_text(F.try_element_at(have, k))))
    return F.concat(*found, extra)


def _record_issues(f: Field, value: Column, at: Column | str, below: Column | str, as_of: Column, lax: bool) -> Column:
    wrong = F.array(issue(at, "model_type", "Input should be an object", as_text(value)))
    return let(members(value), lambda own: F.when(own.isNull(), wrong).otherwise(of_fields(f.fields, own, below, as_text(value), as_of, lax)))


def _list_issues(f: Field, value: Column, at: Column | str, below: Column | str, as_of: Column, lax: bool) -> Column:
    wrong = F.array(issue(at, "list_type", "Input should be a list", as_text(value)))
    few = F.array(issue(at, "too_short", f"At least {f.shortest} elements are needed", as_text(value)))
    many = F.array(issue(at, "too_long", f"At most {f.longest} elements are allowed", as_text(value)))

    def of_element(x: Column, i: Column) -> Column:
        place = F.concat(F.lit(below) if isinstance(below, str) else below, i.cast("string"))
        return let(place, lambda p: _record_issues(f, x, p, F.concat(p, F.lit(".")), as_of, lax))

    return let(elements(value), lambda own: F.when(own.isNull(), wrong).when(F.size(own) < f.shortest, few).when(F.size(own) > f.longest, many).otherwise(F.flatten(F.transform(own, of_element))))


def step(path: str, name: str) -> str:
    return f"{path}['{name}']" if "'" not in name else f'{path}["{name}"]'


def with_issues(rows: DataFrame, fields: tuple[Field, ...], doc: str, whole: Column, as_of: Column, lax: bool, result: str, where: Column | None = None, texts: str | None = None) -> DataFrame:
    """rows with result, all issues of the object in the variant column doc: fields in order, then unknown keys.

    Objects without unknown keys are read at once, as texts and the names of their kinds, and only a field that is not plainly
    good is judged rule by rule. Of the others, scalars and records are read in layers of plain columns, which are compiled;
    only lists go element by element. Rows that where excludes, and those whose doc is no object, get NULL.

    texts: a name for the texts of those that were read at once, NULL for other rows.
    """
    out, keep = rows, rows.columns
    *layers, found = layers_of(fields, doc, whole, as_of, lax, where)
    for layer in layers:
        out = out.select(*out.columns, *layer)
    return out.select(*keep, *([F.col("__texts").alias(texts)] if texts else []), found.alias(result))


_layers: dict[tuple, list] = {}


def told(c: Column) -> tuple[str, str]:
    """An expression as text, without the place in the program that made it, and of a literal the kind of its value too."""
    node = c._jc.node()
    if node.getClass().getSimpleName() != "Literal":
        return node.normalized().toString(), ""
    value = node.value()
    return node.normalized().toString(), value.getClass().getName() if hasattr(value, "getClass") else type(value).__name__


def layers_of(fields: tuple[Field, ...], doc: str, whole: Column, as_of: Column, lax: bool, where: Column | None) -> list:
    """The layers of columns of with_issues, and its result. They depend on no rows, so the last ones are kept: building some
    thousands of expressions takes seconds, which a stream would pay for each batch."""
    parts = [told(c) if c is not None else None for c in (whole, as_of, where)]
    key = (fields, doc, lax, *parts, id(F.col("x")._jc._gateway_client), *((n, id(k)) for n, k in sorted(KINDS.items())))
    if key not in _layers:
        if len(_layers) >= 32:
            _layers.clear()
        _layers[key] = _made_layers(fields, doc, whole, as_of, lax, where)
    return _layers[key]


def shape_of(fields: tuple[Field, ...], listed: bool = False) -> tuple[str, list[str]] | None:
    """A pattern of the types that an object of known keys has, as schema_of_variant names them, with a group for each field but
    records, and their paths in the order of the groups; a field that is left out has an empty group. None for fields that it
    can't tell. The types of a list are those of all its elements together, so only kinds that they must share are taken."""
    any_kind = r"[A-Z]+(?:\([0-9]+,[0-9]+\))?+"
    number = r"|DOUBLE|DECIMAL\([0-9]+,[0-9]+\)"
    pattern, paths = "", []
    for f in sorted(fields, key=lambda x: x.name):
        if f.kind in ("record", "records"):
            inner = None if listed else shape_of(f.fields, f.kind == "records")
            if inner is None:
                return None
            paths += [f.name] if f.kind == "records" else []
            made = f"(ARRAY)<(?:VOID|{inner[0]})>" if f.kind == "records" else inner[0]
            paths += [f"{f.name}.{p}" for p in inner[1]]
        else:
            made = f"(STRING|BIGINT|BOOLEAN{number if f.kind == 'money' else ''})" if listed else f"({any_kind})"
            paths.append(f.name)
        if (f.nullable and f.default is not None) or (listed and f.has_default) or not re.fullmatch("[a-z_][a-z0-9_]*", f.name):
            return None
        pattern += f"(?:{f.name}: {made}(?:, |(?=>)))" + ("" if f.kind == "record" else "?+")
    return f"OBJECT<{pattern}>", paths


def all_texts(fields: tuple[Field, ...]) -> T.StructType:
    """The fields with every scalar as text."""
    kinds = {"record": lambda f: all_texts(f.fields), "records": lambda f: T.ArrayType(all_texts(f.fields))}
    return T.StructType([T.StructField(f.name, kinds.get(f.kind, lambda _: T.StringType())(f)) for f in fields])


def plainly_good(f: Field, text: Column, of: Column, as_of: Column) -> Column:
    """Whether a scalar of this text and kind certainly breaks no rule."""
    if f.kind == "whole":
        return (of == "BIGINT") & surely_good(f, text.try_cast("bigint"), as_of)
    return (of == "STRING") & text.isNotNull() & surely_good(f, text, as_of)


def _quick_layers(fields: tuple[Field, ...], doc: str, whole: Column, as_of: Column, lax: bool, wanted: Column) -> list[list[Column]]:
    """Layers that end in __quick and __texts: the issues and the texts of objects without unknown keys whose lists are uniform, NULL for
    all others."""
    none = F.array().cast(f"array<{ISSUE.simpleString()}>")
    told_shape = shape_of(fields)
    if told_shape is None:
        return [[F.lit(None).cast(f"array<{ISSUE.simpleString()}>").alias("__quick"), F.lit(None).cast(all_texts(fields)).alias("__texts")]]
    pattern, paths = told_shape
    of = lambda path: F.col("__kinds")[paths.index(path)]
    texts = lambda path: F.col("__read." + path)
    groups = "#" + "|".join(f"${k + 1}" for k in range(len(paths)))
    shape = F.regexp_replace(F.schema_of_variant(doc), rf"^{pattern}\z", groups)
    first = [held(F.when(wanted, shape)).alias("__shape")]
    second = [held(F.when(F.col("__shape").startswith("#"), F.split(F.substring("__shape", 2, 2**31 - 1), "[|]"))).alias("__kinds"), held(F.when(F.col("__shape").startswith("#"), F.try_variant_get(doc, "$", all_texts(fields).simpleString()))).alias("__read")]

    every: list[tuple[Field, str]] = []

    def gather(own: tuple[Field, ...], under: str) -> None:
        for f in own:
            if f.kind == "record":
                gather(f.fields, f"{under}{f.name}.")
            else:
                every.append((f, under + f.name))

    gather(fields, "")
    uniform = F.col("__kinds").isNotNull()
    for f, path in every:
        if f.kind == "records":
            uniform = uniform & ((of(path) == "") | ~F.size(texts(path)).between(f.shortest, f.longest) | ~F.exists(texts(path), _lacking(f)))
    third = [held(F.coalesce(uniform, F.lit(False))).alias("__uniform")]
    place = {path: f"__q{k}" for k, (_, path) in enumerate(every)}

    def within(path: str) -> Column:
        above = path.rpartition(".")[0]
        return F.try_variant_get(doc, "$" + "".join(step("", n) for n in above.split(".")), "string") if above else whole

    def of_list(f: Field, path: str) -> Column:
        value = texts(path)
        raw = F.try_variant_get(doc, "$" + "".join(step("", n) for n in path.split(".")), "string")
        few = F.array(issue(path, "too_short", f"At least {f.shortest} elements are needed", raw))
        many = F.array(issue(path, "too_long", f"At most {f.longest} elements are allowed", raw))
        good = F.lit(True)
        for x in f.fields:
            good = good & (of(f"{path}.{x.name}") == ("BIGINT" if x.kind == "whole" else "STRING"))
        fine = F.forall(value, lambda e: F.coalesce(_all_plain(f, e, as_of), F.lit(False)))

        def of_element(e: Column, i: Column) -> Column:
            made = []
            for x in f.fields:
                kind_, at = of(f"{path}.{x.name}"), F.concat(F.lit(f"{path}."), i.cast("string"), F.lit(f".{x.name}"))
                made.append(F.when(plainly_good(x, e[x.name], kind_, as_of), F.lit(None).cast(ISSUE)).otherwise(_checked(x, e[x.name], kind_, at, as_of, lax)))
            return F.array_compact(F.array(*made))

        return F.when(F.size(value) < f.shortest, few).when(F.size(value) > f.longest, many).when(good & fine, none).otherwise(F.flatten(F.transform(value, of_element)))

    issues = []
    for f, path in every:
        missing = issue(path, "missing", "Field required", within(path)) if f.required else F.lit(None).cast(ISSUE)
        if f.kind == "records":
            missing = F.array(missing) if f.required else none
            made = F.when(of(path) == "", missing).otherwise(of_list(f, path))
        else:
            made = F.when(plainly_good(f, texts(path), of(path), as_of), F.lit(None).cast(ISSUE)).when(of(path) == "", missing).otherwise(_checked(f, texts(path), of(path), path, as_of, lax))
        issues.append(held(F.when(F.col("__uniform"), made)).alias(place[path]))
    found = [F.col(place[path]) if f.kind == "records" else F.when(F.col(place[path]).isNotNull(), F.array(place[path])).otherwise(none) for f, path in every]
    any_found = F.lit(False)
    for f, path in every:
        any_found = any_found | ((F.size(place[path]) > 0) if f.kind == "records" else F.col(place[path]).isNotNull())
    quick = F.when(F.col("__uniform"), F.when(any_found, F.concat(*found)).otherwise(none))
    return [first, second, third, issues, [held(quick).alias("__quick"), held(F.when(F.col("__uniform"), F.col("__read"))).alias("__texts")]]


def _lacking(f: Field) -> Callable[[Column], Column]:
    """Whether an element of a list, or one of its texts, is NULL."""

    def lacks(e: Column) -> Column:
        out = e.isNull()
        for x in f.fields:
            out = out | e[x.name].isNull()
        return out

    return lacks


def _all_plain(f: Field, e: Column, as_of: Column) -> Column:
    out = F.lit(True)
    for x in f.fields:
        out = out & surely_good(x, e[x.name].try_cast("bigint") if x.kind == "whole" else e[x.name], as_of)
    return out


def texts_record(fields: tuple[Field, ...], have: Column) -> Column:
    """The typed struct of a valid object's texts, as all_texts has them."""
    made = []
    for f in fields:
        x = have.getField(f.name)
        if f.kind == "record":
            out = texts_record(f.fields, x)
        elif f.kind == "records":
            out = F.transform(x, _texts_record(f))
        else:
            out = typed_text(f, x, x.isNull())
        made.append(out.alias(f.name))
    return F.struct(*made)


def _texts_record(f: Field) -> Callable[[Column], Column]:
    return lambda x: texts_record(f.fields, x)


def _made_layers(fields: tuple[Field, ...], doc: str, whole: Column, as_of: Column, lax: bool, where: Column | None) -> list:
    wanted = F.col(doc).isNotNull() if where is None else where & F.col(doc).isNotNull()
    quick = _quick_layers(fields, doc, whole, as_of, lax, wanted)
    wanted = wanted & F.col("__quick").isNull()
    scalars: list[tuple[Field, str, str]] = []  # field, path in the variant, path in issues
    parts: list[tuple[tuple[Field, ...], str, str]] = [(fields, "$", "")]  # objects, in the order of their issues
    for own, at, named in parts:
        for f in own:
            scalars.append((f, step(at, f.name), named + f.name))
            if f.kind == "record":
                parts.append((f.fields, step(at, f.name), f"{named}{f.name}."))
    name = {path: f"__{k}" for k, (_, path, _) in enumerate(scalars)}
    col = lambda path, what: F.col(f"{name[path]}_{what}")
    values = [held(F.when(wanted, F.try_variant_get(doc, path, "variant"))).alias(f"{name[path]}_v") for _, path, _ in scalars]
    keys = [held(F.when(wanted, F.map_keys(F.try_variant_get(doc, at, "map<string,variant>")))).alias(f"__keys{k}") for k, (_, at, _) in enumerate(parts)]
    read = [c for _, path, _ in scalars for c in (held(as_text(col(path, "v"))).alias(f"{name[path]}_t"), held(kind(col(path, "v"))).alias(f"{name[path]}_k"))]
    sizes = [held(F.when(F.trim(col(path, "t")).rlike(DECIMAL), digits(F.trim(col(path, "t"))))).alias(f"{name[path]}_d") for f, path, _ in scalars if f.kind == "money"]
    lists = [held(F.when(col(path, "v").isNotNull(), list_issues(f, col(path, "v"), col(path, "k"), named, as_of, lax))).alias(f"{name[path]}_i") for f, path, named in scalars if f.kind == "records"]
    none = F.array().cast(f"array<{ISSUE.simpleString()}>")

    def of_part(k: int, within: Column) -> list[Column]:
        own, at, named = parts[k]
        found: list[Column] = []
        for f in own:
            path, place = step(at, f.name), named + f.name
            value = col(path, "v")
            if f.kind == "record":
                below = next(i for i, (_, p, _) in enumerate(parts) if p == path)
                made = F.when(F.col(f"__keys{below}").isNull(), F.array(issue(place, "model_type", "Input should be an object", col(path, "t")))).otherwise(F.concat(*of_part(below, col(path, "t"))))
            elif f.kind == "records":
                made = col(path, "i")
            else:
                one = _checked(f, col(path, "t"), col(path, "k"), place, as_of, lax, col(path, "d") if f.kind == "money" else None)
                made = F.array_compact(F.array(one))
            missing = F.array(issue(place, "missing", "Field required", within)) if f.required else none
            found.append(F.when(value.isNull(), missing).otherwise(made))
        extra = F.array_except(F.col(f"__keys{k}"), F.array(*[F.lit(f.name) for f in own]))
        have = F.try_variant_get(doc, at, "map<string,variant>")
        told = F.transform(extra, lambda x: issue(F.concat(F.lit(named), x), "extra_forbidden", "Extra inputs are not permitted", as_text(F.try_element_at(have, x))))
        return [*found, F.when(F.size(extra) > 0, told).otherwise(none)]

    found = F.when(wanted & F.col("__keys0").isNotNull(), F.concat(*of_part(0, whole))).otherwise(F.col("__quick"))
    return [*quick, [*values, *keys], read, [*sizes, *lists], held(found)]


def list_issues(f: Field, value: Column, of: Column, at: str, as_of: Column, lax: bool) -> Column:
    """The issues of a list's variant. Lists whose elements all have the plain types, and break no rule, are told at once."""
    if lax or any(x.kind in ("record", "records") for x in f.fields):
        return _list_issues(f, value, at, f"{at}.", as_of, lax)
    names = sorted(f.fields, key=lambda x: x.name)
    plain = "ARRAY<OBJECT<" + ", ".join(f"{x.name}: {'BIGINT' if x.kind == 'whole' else 'STRING'}" for x in names) + ">>"
    typed_ = F.try_variant_get(value, "$", T.ArrayType(text_schema(f.fields)).simpleString())
    good = (of == plain) & F.coalesce(surely_good(f, typed_, as_of), F.lit(False))
    return F.when(good, F.array().cast(f"array<{ISSUE.simpleString()}>")).otherwise(_list_issues(f, value, at, f"{at}.", as_of, lax))


def record_of(fields: tuple[Field, ...], have: Column) -> Column:
    """The typed struct of a valid object's map of variants."""
    made = []
    for f in fields:
        value = F.try_element_at(have, F.lit(f.name))
        if f.kind == "record":
            out = let(members(value), _record(f, False))
        elif f.kind == "records":
            out = F.transform(elements(value), _record(f, True))
        else:
            out = typed(f, value)
        made.append(out.alias(f.name))
    return F.struct(*made)


def _record(f: Field, element: bool) -> Callable[[Column], Column]:
    """The struct of an object, or of an element that is still a variant."""
    if element:
        return lambda x: let(members(x), lambda own: record_of(f.fields, own))
    return lambda own: record_of(f.fields, own)


def text_schema(fields: tuple[Field, ...]) -> T.StructType:
    """The fields as from_json reads them for the short way: whole numbers as such, other scalars as text."""
    kinds = {"record": lambda f: text_schema(f.fields), "records": lambda f: T.ArrayType(text_schema(f.fields)), "whole": lambda f: T.LongType()}
    return T.StructType([T.StructField(f.name, kinds.get(f.kind, lambda _: T.StringType())(f)) for f in fields])


def surely_good(f: Field, x: Column, as_of: Column) -> Column:
    """Whether a field that was read by text_schema certainly breaks no rule; what is in doubt goes the long way."""
    if f.kind == "record":
        out = x.isNotNull() & all_good(f.fields, x, as_of)
    elif f.kind == "records":
        out = F.size(x).between(f.shortest, f.longest) & F.forall(x, lambda i: i.isNotNull() & all_good(f.fields, i, as_of))
    elif f.kind in KINDS:
        out = F.lit(False)
    elif f.kind == "uuid":
        out = x.rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z")
    elif f.kind == "choice":
        out = x.isin(*f.choices)
    elif f.kind == "money":
        out = x.rlike(rf"^[0-9]{{1,{MONEY_DIGITS - MONEY_PLACES}}}(?:\.[0-9]{{1,{MONEY_PLACES}}})?\z")
        out = out & x.rlike("[1-9]") if f.above == 0 else out & F.lit(f.above is None and f.at_least in (None, 0))
    elif f.kind == "whole":
        out = (x > (f.above if f.above is not None else -(2**63))) & (x <= (f.at_most if f.at_most is not None else 2**63 - 1))
    elif f.kind == "moment":
        out = x.rlike(MOMENT.replace("[Tt _]", "T") + ZONE) & (F.try_to_timestamp(x) <= as_of + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES"))
    else:
        out = F.length(x).between(f.shortest or 0, f.longest or 2**31 - 1)
        out = out & x.rlike(f.pattern[:-1] + r"\z") if f.pattern else out
    return F.coalesce(x.isNull() | out if f.has_default else out, F.lit(False))


def timely(fields: tuple[Field, ...], have: Column, as_of: Column) -> Column:
    """Whether the times of what good_form has matched are times, and not ahead."""
    out = have.isNotNull()
    for f in fields:
        if f.kind == "moment":
            out = out & (F.try_to_timestamp(have.getField(f.name)) <= as_of + F.expr(f"INTERVAL {SKEW_MINUTES} MINUTES"))
        elif f.kind == "record":
            out = out & timely(f.fields, have.getField(f.name), as_of)
    return out


def all_good(fields: tuple[Field, ...], have: Column, as_of: Column) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & surely_good(f, have.getField(f.name), as_of)
    return out


def _money_text(text: Column) -> Column:
    return text.cast(f"decimal({MONEY_DIGITS},{MONEY_PLACES})")


def text_record(fields: tuple[Field, ...], have: Column) -> Column:
    """The typed struct of what text_schema has read."""
    made = []
    for f in fields:
        x = have.getField(f.name)
        if f.kind == "record":
            out = text_record(f.fields, x)
        elif f.kind == "records":
            out = F.transform(x, _text_record(f))
        else:
            plain = {"whole": lambda x: x, "uuid": F.lower, "moment": F.try_to_timestamp, "money": _money_text}.get(f.kind)  # as good_form has it
            out = plain(x) if plain and not (f.has_default and f.kind == "whole") else typed_text(f, x, x.isNull())
            if f.kind == "money" and f.has_default:
                out = F.coalesce(out, F.lit(f.default).cast(type_of(f)))
        made.append(out.alias(f.name))
    return F.struct(*made)


def _text_record(f: Field) -> Callable[[Column], Column]:
    return lambda x: text_record(f.fields, x)


def good_form(fields: tuple[Field, ...]) -> str | None:
    """A pattern of the compact JSON of an object that breaks no rule but those on the clock and across fields.

    Keys come in order; a space may follow commas and colons; text has no escapes; fields with a default may be left out
    at the end of their object only, or be null if they are nullable. What doesn't match goes the long way.
    """
    text = r"[^\x22\\\x00-\x1F]"
    money = lambda f: (r"(?=[0-9.]*[1-9])" if f.above == 0 else "") + rf"[0-9]{{1,{MONEY_DIGITS - MONEY_PLACES}}}(?:\.[0-9]{{1,{MONEY_PLACES}}})?"

    def value(f: Field) -> str | None:
        if f.kind == "record":
            return good_form(f.fields)
        if f.kind == "records":
            one = good_form(f.fields)
            return one and rf"\[(?:{one}(?:, ?+(?=\{{)|(?=\]))){{{f.shortest},{f.longest}}}+\]"
        if f.kind in KINDS:
            return None
        if f.kind == "whole":
            return whole_form(f)
        if f.kind == "money":
            return f'"{money(f)}"' if f.above in (None, 0) and f.at_least in (None, 0) and f.at_most is None else None
        if f.kind == "text":
            inner = f.pattern[1:-1] if f.pattern else text + "{" + f"{f.shortest or 0},{f.longest or ''}" + "}+"
            sized = f'(?={text}{{{f.shortest or 0},{f.longest or ""}}}+")' if f.pattern else ""
            return f'"{sized}{inner}"'
        return '"' + {"uuid": "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "choice": f"(?:{'|'.join(map(re.escape, f.choices))})", "moment": MOMENT[1:].replace("[Tt _]", "T").replace("[.,]", r"\.") + r"(?:Z|[+-][0-9]{2}:[0-9]{2})"}[f.kind] + '"'

    made = [value(f) for f in fields]
    if None in made:
        return None
    last = max((k for k, f in enumerate(fields) if not f.has_default), default=-1)
    out = ""
    for k, (f, v) in enumerate(zip(fields, made, strict=True)):
        one = f'"{re.escape(f.name)}": ?+(?:{v}' + ("|null)" if f.nullable else ")")
        comma = ", ?+" if k else ""
        out += f"(?:{comma}{one})?+" if k > last and k else comma + one
    return rf"\{{{out}\}}"


def whole_form(f: Field) -> str | None:
    """A pattern of the whole numbers from 1 to a power of ten; None for other bounds."""
    places = len(str(f.at_most)) - 1 if f.at_most else 0
    if f.above != 0 or not places or f.at_most != 10**places:
        return None
    return rf"(?:[1-9][0-9]{{0,{places - 1}}}+(?![0-9])|1{'0' * places}(?![0-9]))"


def items_total(items: Column) -> Column:
    """The exact sum of price times quantity."""
    return F.aggregate(items, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x["price"] * x["quantity"].cast("decimal(10,0)")).cast("decimal(38,2)"))


def line_totals(items: Column) -> Column:
    return F.transform(items, lambda x: x["price"] * x["quantity"].cast("decimal(10,0)"))


def value_issue(event: Column, total: Column) -> Column:
    """The issue of an event whose value is not its items' total plus shipping less discount, or NULL."""
    expected = (total + event["shipping"] - event["discount"]).cast("decimal(38,2)")
    message = F.format_string("The value is %s, but items of %s with shipping of %s and a discount of %s make %s", *[c.cast("string") for c in (event["value"], total, event["shipping"], event["discount"], expected)])
    return F.when(expected != event["value"], issue("", "value_mismatch", message, canonical(event)))


#: The fields that those rules are about; contracts without them have no such rules.
AMOUNTS = {"items", "value", "shipping", "discount"}
#: Further rules on clean events: functions of the event struct and its items' total that give an issue or NULL.
RECORD_RULES: list[Callable[[Column, Column], Column]] = [value_issue]
