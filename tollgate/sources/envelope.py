"""Push envelopes: {"subscription", "message": {"data" (base64), "messageId", "publishTime", "attributes", ...}}.

Keys come in camel or snake case and unknown ones are ignored. A bad envelope is the transport's problem: it goes to the
retry branch and never to the quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.payload import utc_text

MESSAGE = "data string, messageId string, message_id string, publishTime string, publish_time string, attributes map<string,string>"
ENVELOPE = f"subscription string, message struct<{', '.join(f.replace(' ', ':', 1) for f in MESSAGE.split(', '))}>, deliveryAttempt int, delivery_attempt int"


def read_envelopes(rows: DataFrame, value_col: str = "value") -> DataFrame:
    """rows with body (binary), message_id, publish_time, attributes, subscription, attempt and good.

    A message without data has an empty body; the validator then finds it malformed.
    """
    out = rows.withColumn("__e", F.from_json(F.col(value_col).cast("string"), ENVELOPE))
    either = lambda a, b: F.coalesce(F.col(f"__e.{a}"), F.col(f"__e.{b}"))
    body = F.try_to_binary(F.coalesce(F.col("__e.message.data"), F.lit("")), F.lit("base64"))
    sent = F.try_to_timestamp(either("message.publishTime", "message.publish_time"))
    out = out.select(
        *rows.columns,
        body.alias("body"),
        either("message.messageId", "message.message_id").alias("message_id"),
        sent.alias("publish_time"),
        F.coalesce("__e.message.attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        F.col("__e.subscription").alias("subscription"),
        F.coalesce(F.col("__e.deliveryAttempt"), F.col("__e.delivery_attempt"), F.lit(1)).alias("attempt"),
    )
    good: Column = F.lit(True)
    for name in ("body", "message_id", "publish_time", "subscription"):
        good = good & F.col(name).isNotNull()
    return out.withColumn("good", good)


def to_envelope(body: Column, message_id: Column, published: Column, attributes: Column, subscription: str = "events") -> Column:
    """An envelope as JSON text."""
    message = F.struct(F.base64(body).alias("data"), message_id.alias("messageId"), utc_text(published, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishTime"), attributes.alias("attributes"))
    return F.to_json(F.struct(F.lit(subscription).alias("subscription"), message.alias("message")))
