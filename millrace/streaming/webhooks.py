"""Webhook events as a stream: verified, routed, and handed on once each."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import command_after_mention

ZERO_SHA = "0" * 40
EVENT_SCHEMA = "event_id string, event string, signature string, payload string"
_PAYLOAD = "action string, comment struct<body:string,user:struct<login:string>>, issue struct<number:bigint>, repository struct<full_name:string>, after string, ref string"


def signature_ok(secret: str, payload: Column, signature: Column) -> Column:
    """HMAC-SHA256 with the prefix sha256=, compared in constant time; a missing secret, payload or signature fails."""

    @F.pandas_udf("boolean")
    def check(p: pd.Series, s: pd.Series) -> pd.Series:
        def one(body, sig):
            if not secret or body is None or not sig or not sig.startswith("sha256="):
                return False
            return hmac.compare_digest(hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest(), sig[7:])

        return pd.Series([one(a, b) for a, b in zip(p, s)], dtype="bool")

    return check(payload, signature)


def route_events(events: DataFrame, login: str) -> DataFrame:
    """(event_id, action, repo, detail, reason): a comment that mentions the bot is answered, a push that is no deletion is
    indexed again, all else is ignored with a reason; bad JSON is ignored."""
    j = F.from_json("payload", _PAYLOAD)
    e = events.select("event_id", "event", j.alias("j"))
    command = command_after_mention(F.col("j.comment.body"), login)
    comment = F.col("event") == "issue_comment"
    push = F.col("event") == "push"
    reason = (
        F.when(F.col("j").isNull(), "bad payload")
        .when(comment & ~F.coalesce(F.col("j.action").isin("created", "edited"), F.lit(False)), "action")
        .when(comment & (F.lower(F.coalesce("j.comment.user.login", F.lit(""))) == login.lower()), "own comment")
        .when(comment & command.isNull(), "no mention")
        .when(push & (F.coalesce("j.after", F.lit(ZERO_SHA)) == ZERO_SHA), "branch deleted")
        .when(~(comment | push) | F.col("event").isNull(), "event")
    )
    action = F.when(reason.isNotNull(), "ignore").when(comment, "answer").otherwise("reindex")
    detail = F.when(action == "answer", command).when(action == "reindex", F.col("j.after"))
    return e.select("event_id", action.alias("action"), F.col("j.repository.full_name").alias("repo"), detail.alias("detail"), reason.alias("reason"))


def start(spark: SparkSession, folder: str, sink: str, checkpoint: str, login: str, secret: str | None = None, files_per_batch: int = 100):
    """A streaming query over JSON files in `folder`; each event id is written once, within the day it may be delivered again."""
    raw = spark.readStream.schema(EVENT_SCHEMA + ", received timestamp").option("maxFilesPerTrigger", files_per_batch).json(folder)
    if secret is not None:
        raw = raw.where(signature_ok(secret, F.col("payload"), F.col("signature")))
    once = raw.withWatermark("received", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return route_events(once, login).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
