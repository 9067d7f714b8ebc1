"""Delivery: recipients, worklist, claims and state (U1, J6, J7, J16, T4, T5 as batch operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweft.operators.joins import checked_broadcast, stored


def recipients(configured: DataFrame, intake: DataFrame) -> DataFrame:
    """Distinct chats of both tables (``chat_id``), blanks dropped."""
    both = configured.select("chat_id").unionByName(intake.select("chat_id"))
    return both.select(F.trim("chat_id").alias("chat_id")).where("chat_id <> ''").distinct()


def merged_recipients(configured: Column, found: Column) -> Column:
    """U1 for arrays: order kept, blanks dropped."""
    return F.filter(F.array_distinct(F.concat(configured, found)), lambda x: F.trim(x) != "")


def delivered_pairs(audits: DataFrame, operation: str) -> DataFrame:
    """Distinct (document_id, chat_id) of successful deliveries; a missing result counts as sent.

    The chat is the column ``chat_id``, or, without one, ``$.chat_id`` of the json column ``details``.
    """
    ok = (F.col("operation") == operation) & (F.coalesce("result", F.lit("Sent")) == "Sent")
    chat = F.col("chat_id") if "chat_id" in audits.columns else F.get_json_object("details", "$.chat_id")
    return audits.where(ok).select("document_id", chat.alias("chat_id")).where("chat_id IS NOT NULL").distinct()


def worklist(published: DataFrame, chats: DataFrame, audits: DataFrame, operation: str, block: int = 1000) -> DataFrame:
    """(document_id, chat_id) still to be delivered.

    Every document goes to every recipient: that is the operator's result, not a step of a join. Recipients are dealt by hash
    into arrays of about ``block``; each document meets each array by its number and then its elements, so any number of
    recipients works and none passes the driver; the arrays are broadcast if their bytes are few. Audits are reduced to distinct pairs before the anti join.
    """
    parts = max(1, -(-chats.count() // block))
    lists = chats.groupBy(F.pmod(F.xxhash64("chat_id"), F.lit(parts)).alias("part")).agg(F.collect_list("chat_id").alias("chats"))
    every = published.select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    pairs = every.join(checked_broadcast(stored(lists, "recipients")), "part").select("document_id", F.explode("chats").alias("chat_id"))
    return pairs.join(delivered_pairs(audits, operation), ["document_id", "chat_id"], "left_anti")


def already_delivered(pairs: DataFrame, audits: DataFrame, operation: str) -> DataFrame:
    """J7."""
    return pairs.join(delivered_pairs(audits, operation), ["document_id", "chat_id"], "left_semi")


def progress_rows(delivery: DataFrame, intake: DataFrame, default_chat: str) -> DataFrame:
    """Delivery rows with the chat and message to update; rows without a message are left out."""
    known = intake.select(F.col("document_id"), F.col("chat_id").alias("intake_chat"), F.col("progress_message_id"))
    out = delivery.join(known, "document_id", "left").where("progress_message_id IS NOT NULL")
    return out.withColumn("chat_id", F.coalesce("intake_chat", F.lit(default_chat))).drop("intake_chat")


def claim(state: DataFrame, requests: DataFrame, now: Column, lease_minutes: int = 10) -> DataFrame:
    """T4: one row for each distinct request: ``document_id, chat_id, claimed, attempts, first_attempt_at, last_attempt_at``.

    ``sent`` is final; a row locked less than the lease ago stays with its holder; else the claim counts one more attempt.
    Run by a single writer for each batch, which stores the claimed rows.
    """
    asked = requests.select("document_id", "chat_id").distinct()
    both = asked.join(state, ["document_id", "chat_id"], "left")
    held = F.coalesce(F.col("locked_at") > now - F.expr(f"INTERVAL {int(lease_minutes)} MINUTES"), F.lit(False))
    free = ~F.coalesce(F.col("status") == "sent", F.lit(False)) & ~held
    return both.select(
        "document_id",
        "chat_id",
        free.alias("claimed"),
        (F.coalesce("attempts", F.lit(0)) + free.cast("int")).cast("int").alias("attempts"),
        F.when(free, F.coalesce("first_attempt_at", now)).otherwise(F.col("first_attempt_at")).alias("first_attempt_at"),
        F.when(free, now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
    )


def fold_attempts(attempts: DataFrame) -> DataFrame:
    """T5: state of each (document_id, chat_id) after its attempt events (``status, message_id, at, event_id``).

    ``sent`` is final; else the last event's status holds. ``resumable``: a message went out, so only the file is missing.
    """
    order = F.struct("at", "event_id")
    return attempts.groupBy("document_id", "chat_id").agg(
        F.when(F.count_if(F.col("status") == "sent") > 0, "sent").otherwise(F.max_by("status", order)).alias("status"),
        F.count_if(F.col("status") == "pending").alias("attempts"),
        F.max_by("message_id", F.when(F.col("message_id").isNotNull(), order)).alias("message_id"),
        F.min("at").alias("first_attempt_at"),
        F.max("at").alias("last_attempt_at"),
    ).withColumn("resumable", F.col("message_id").isNotNull() & (F.col("status") != "sent"))
