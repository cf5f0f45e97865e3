"""Synthetic purchase events with faults of known kinds, as DataFrames.

All choices are hashes of (seed, row, what is chosen), so the rows are the same however they are partitioned. The exact
number of faults comes from the rows of the least hashes, and their even kinds from prefix counts. Faults are laid over
events that are made here, or over those that are given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.contract import CHANNELS, CURRENCIES, PURCHASE, VERSION
from tollgate.functions.payload import utc_text
from tollgate.operators.ordinals import least, numbered

class Fault(NamedTuple):
    """A kind of fault: the reason that its records must get, what is done to them, and for kinds that are added to the
    built-in ones the injector: from a valid line and its event to the faulty line."""

    reason: str
    about: str
    inject: Callable[[Column, Column], Column] | None = None


#: Kind of fault, the reason that a record with it must get, and what is done.
FAULTS: dict[str, Fault] = {
    "value_mismatch": Fault("value_mismatch", "the value differs from the sum of the items"),
    "future_timestamp": Fault("future_timestamp", "the event is 1 to 14 hours ahead"),
    "non_positive_amount": Fault("non_positive_amount", "a price or quantity is zero or less"),
    "unsupported_currency": Fault("unsupported_currency", "the currency is not of the contract"),
    "duplicate_transaction": Fault("duplicate_transaction", "the id is that of an earlier valid record"),
    "missing_field": Fault("missing_field", "a required field is left out"),
    "unexpected_field": Fault("unexpected_field", "an unknown field is added to the event or an item"),
    "type_mismatch": Fault("type_mismatch", "a quantity is text"),
}
PRODUCTS = [("P-01", "Notebook", "4.99"), ("P-02", "Desk lamp", "39.50"), ("P-03", "Office chair", "189.00"), ("P-04", "Monitor arm", "79.90"), ("P-05", "Cable set", "12.49"), ("P-06", "Backpack", "64.99"), ("P-07", "Water bottle", "17.00"), ("P-08", "Headphones", "129.95")]
#: Sources by their campaigns; the medium is drawn from the contract's, so every pair comes up.
SOURCES = ["atlas", "beacon", "cedar"]
CAMPAIGNS = [None, "autumn", "clearance", "members", None]
SHIPPING = ["0.00", "3.50", "7.25", "12.80"]


#: Events that are made for one config; those that are given are as many as they are.
MOST_MADE = 10_000_000


@dataclass(frozen=True)
class GeneratorConfig:
    """What is made, or for given events what is laid over them: count is then their number, which has no bound."""

    count: int
    error_rate: float = 0.0
    seed: int = 0
    faults: tuple[str, ...] = tuple(FAULTS)
    reference_time: datetime = field(default_factory=lambda: datetime.now(UTC))
    given: bool = False

    def __post_init__(self) -> None:
        if self.count < 1 or (self.count > MOST_MADE and not self.given):
            raise ValueError("count must be 1 or more" if self.given else f"count must be within 1 to {MOST_MADE:,}")
        if not 0 <= self.error_rate <= 1:
            raise ValueError("error_rate must be within 0 to 1")
        if not 0 <= self.seed <= 2**32:
            raise ValueError("seed must be within 0 to 2**32")
        if not self.faults or set(self.faults) - set(FAULTS):
            raise ValueError(f"faults must be some of {', '.join(FAULTS)}")
        if self.reference_time.tzinfo is None:
            raise ValueError("reference_time needs a time zone")

    @property
    def n_faults(self) -> int:
        anchored = int("duplicate_transaction" in self.faults)
        return min(round(self.count * self.error_rate), self.count - anchored)


def draw(config: GeneratorConfig, what: str, n: int, *more: Column) -> Column:
    """A number from 0 to n - 1 for this row and purpose."""
    return F.pmod(F.xxhash64(F.lit(config.seed), F.col("index"), F.lit(what), *more), F.lit(n))


def of(values: list, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def money(c: Column) -> Column:
    return c.cast("decimal(12,2)")


def valid_events(spark: SparkSession, config: GeneratorConfig) -> DataFrame:
    """index and event, a valid event as a struct with amounts as text."""
    rows = spark.range(config.count).select(F.col("id").alias("index"))
    ids = [p[0] for p in PRODUCTS]
    start, step = draw(config, "first", len(ids)), of([1, 3, 5, 7], draw(config, "step", 4))  # odd steps never meet twice
    places = F.sequence(F.lit(0).cast("long"), draw(config, "items", 4))

    def item(i: Column) -> Column:
        p = F.pmod(start + i * step, F.lit(len(ids)))
        return F.struct(of(ids, p).alias("item_id"), of([x[1] for x in PRODUCTS], p).alias("item_name"), of([x[2] for x in PRODUCTS], p).alias("price"), (draw(config, "quantity", 3, i) + 1).alias("quantity"))

    rows = rows.withColumn("items", F.transform(places, item)).withColumn("shipping", money(of(SHIPPING, draw(config, "shipping", len(SHIPPING)))))
    rows = rows.withColumn("sum", F.aggregate("items", F.lit(0).cast("decimal(12,2)"), lambda a, x: (a + money(x["price"]) * x["quantity"].cast("int")).cast("decimal(12,2)")))
    off = (F.floor(F.col("sum") * of([5, 10, 15, 20], draw(config, "off", 4))) / 100).cast("decimal(12,2)")
    rows = rows.withColumn("discount", F.when(draw(config, "discounted", 10) < 3, off).otherwise(money(F.lit("0.00"))))
    hexes = F.md5(F.concat_ws("|", F.lit(str(config.seed)), F.col("index").cast("string"), F.lit("event")))
    uuid = F.concat_ws("-", hexes.substr(1, 8), hexes.substr(9, 4), F.concat(F.lit("4"), hexes.substr(14, 3)), F.concat(F.lit("a"), hexes.substr(18, 3)), hexes.substr(21, 12))
    age = draw(config, "age", 7 * 24 * 3600 - 60) + 60
    when = utc_text(F.timestamp_seconds(F.lit(int(config.reference_time.timestamp())) - age), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    event = F.struct(
        uuid.alias("event_id"),
        F.format_string("T-%d-%06d", F.lit(config.reference_time.year), F.col("index") + 1).alias("transaction_id"),
        F.format_string("CUST-%05d", draw(config, "customer", 100_000)).alias("customer_id"),
        of(CURRENCIES, draw(config, "currency", len(CURRENCIES))).alias("currency"),
        (F.col("sum") + F.col("shipping") - F.col("discount")).cast("decimal(12,2)").cast("string").alias("value"),
        F.col("shipping").cast("string").alias("shipping"),
        F.col("discount").cast("string").alias("discount"),
        F.col("items"),
        when.alias("event_timestamp"),
        F.struct(*[of(values, draw(config, name, len(values))).alias(name) for name, values in (("source", SOURCES), ("medium", CHANNELS), ("campaign", CAMPAIGNS))]).alias("traffic_source"),
        F.lit(VERSION).alias("contract_version"),
    )
    return rows.select("index", event.alias("event"))


def fault_plan(spark: SparkSession, config: GeneratorConfig, rows: DataFrame | None = None) -> DataFrame:
    """index and fault (NULL for valid rows): exactly config.n_faults faults, the kinds as even as they can be."""
    rows = spark.range(config.count).select(F.col("id").alias("index")) if rows is None else rows.select("index")
    free = rows.filter("index > 0") if "duplicate_transaction" in config.faults else rows
    kinds = sorted(config.faults)
    mark = F.xxhash64(F.lit(config.seed), F.lit("plan"), "index")
    picked = numbered(least(free, mark, config.n_faults, ["index"]).withColumn("mark", mark), [], ["mark", "index"], "place")
    placed = picked.select("index", of(kinds, F.pmod("place", F.lit(len(kinds)))).alias("fault"))
    return rows.join(placed, "index", "left")


def generate(spark: SparkSession, config: GeneratorConfig, events: DataFrame | None = None) -> DataFrame:
    """index, line (JSON) and fault (NULL where the line is valid).

    events: config.count rows of index (from 0, each once) and event, as valid_events() has them, in place of new ones.
    """
    if config.given and events is None:
        raise ValueError("the config is for given events, and there are none")
    rows = (valid_events(spark, config) if events is None else events).join(fault_plan(spark, config, events), "index")
    event, fault = F.col("event"), F.col("fault")
    # A duplicate takes the id of the last valid row before it; runs of faults are short, so a few candidates are tried.
    if "duplicate_transaction" in config.faults and config.n_faults:
        rows = with_earlier(rows, config)
    else:
        rows = rows.withColumn("earlier", F.lit(None).cast("string"))
    n_items = F.size("event.items")
    bad = F.pmod(draw(config, "bad item", 4), n_items)
    change = lambda c: F.when(fault == "non_positive_amount", c)
    amounts, counts = of(["0.00", "-1.00", "-19.99"], draw(config, "bad price", 3)), of([0, -1, -3], draw(config, "bad quantity", 3)).cast("long")
    on_price = draw(config, "price or quantity", 2) == 0
    items = F.transform("event.items", lambda x, i: F.struct(x["item_id"].alias("item_id"), x["item_name"].alias("item_name"), F.coalesce(change(F.when((i == bad) & on_price, amounts)), x["price"]).alias("price"), F.coalesce(change(F.when((i == bad) & ~on_price, counts)), x["quantity"]).alias("quantity")))
    ahead = utc_text(F.timestamp_seconds(F.lit(int(config.reference_time.timestamp())) + 3600 * (draw(config, "ahead", 14) + 1)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    wrong = (event["value"].cast("decimal(12,2)") + money(of(["0.01", "1.00", "10.00"], draw(config, "wrong", 3)))).cast("decimal(12,2)").cast("string")
    new = {
        "transaction_id": F.when(fault == "duplicate_transaction", F.col("earlier")).otherwise(event["transaction_id"]),
        "currency": F.when(fault == "unsupported_currency", of([CURRENCIES[0].lower(), "CHF", "BTC", "PLZ"], draw(config, "bad currency", 4))).otherwise(event["currency"]),
        "value": F.when(fault == "value_mismatch", wrong).otherwise(event["value"]),
        "items": items,
        "event_timestamp": F.when(fault == "future_timestamp", ahead).otherwise(event["event_timestamp"]),
    }
    left_out = of(PURCHASE.required, draw(config, "left out", len(PURCHASE.required)))
    parts = []
    for name in PURCHASE.names:
        text = F.to_json(F.struct(new.get(name, event[name]).alias("v")), {"ignoreNullFields": "false"})
        part = F.expr(f"'\"{name}\":'")
        part = F.concat(part, text.substr(F.lit(6), F.length(text) - 6))
        parts.append(F.when((fault == "missing_field") & (left_out == name), F.lit(None)).otherwise(part))
    in_item = draw(config, "in item", 2) == 0
    parts.append(F.when((fault == "unexpected_field") & ~in_item, F.lit('"coupon_code":"X1"')))
    line = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    line = F.when((fault == "unexpected_field") & in_item, F.regexp_replace(line, r'"items":\[\{', '"items":[{"colour":"red",')).otherwise(line)
    line = F.when(fault == "type_mismatch", F.regexp_replace(line, r'"quantity":([0-9]+)', '"quantity":"$1"')).otherwise(line)
    for kind in config.faults:
        if FAULTS[kind].inject:
            line = F.when(fault == kind, FAULTS[kind].inject(line, event)).otherwise(line)
    return rows.select("index", line.alias("line"), "fault")


def with_earlier(rows: DataFrame, config: GeneratorConfig, tries: int = 8) -> DataFrame:
    """rows with earlier, the id of a valid row before a duplicate: one of a few hashed choices, else the first row's."""
    wanted = rows.filter(F.col("fault") == "duplicate_transaction").select("index", F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(config.seed), "index", F.lit(k), F.lit("earlier")), F.col("index")) for k in range(tries)], F.lit(0).cast("long"))).alias("other"))
    valid = rows.filter("fault is null").select(F.col("index").alias("other"), F.col("event.transaction_id").alias("earlier"))
    found = wanted.join(valid, "other").groupBy("index").agg(F.max_by("earlier", F.struct("other")).alias("earlier"))
    return rows.join(found, "index", "left")


def fault_counts(records: DataFrame) -> DataFrame:
    """fault and n, valid first and then by name."""
    return records.groupBy(F.coalesce("fault", F.lit("valid")).alias("fault")).agg(F.count("*").alias("n")).orderBy(F.col("fault") != "valid", "fault")
