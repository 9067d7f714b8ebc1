"""Lifecycle: states, recovery, health and links.

``now`` is always a parameter. Documents: ``id, source_app, source_location, source_id, processing_status,
publication_status, approved, delivery_status, ...``; intake: ``id, message_id, file_id, status, storage_status, ...``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docweft.functions import fixed_values as fixed


def canonical_source(apps: Sequence[str], locations: Sequence[str]) -> Column:
    """P4."""
    return F.coalesce(F.col("source_app").isin(*apps), F.lit(False)) | F.coalesce(F.col("source_location").isin(*locations), F.lit(False))


def within(at: Column, now: Column, hours: int) -> Column:
    """P5."""
    return at >= now - F.expr(f"INTERVAL {int(hours)} HOURS")


def age_minutes(at: Column, now: Column) -> Column:
    """Minutes from ``at`` (a timestamp) to ``now``, 0 at least; null if unknown."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), seconds / F.lit(60e6)))


def stored_and_verified(key: Column, status: Column) -> Column:
    """P8."""
    return (F.coalesce(key, F.lit("")) != "") & status.eqNullSafe("AVAILABLE")


def ready_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued jobs, and failed ones whose next attempt is due."""
    return jobs.where((F.col("status") == "Queued") | (F.col("status") == "Failed") & (F.col("next_attempt_at") <= now))


def claimable(rows: DataFrame) -> DataFrame:
    """P20: rows to take up, with their new status; run by one writer for each batch."""
    return rows.where(F.col("status").isin("Stored", "Processing Failed")).withColumn("new_status", F.lit("Processing"))


def published_and_approved() -> Column:
    """Strict: unknown approval is none."""
    return (F.col("publication_status") == "Published") & F.col("approved").eqNullSafe(True)


def status_counts(rows: DataFrame, col: str = "status") -> DataFrame:
    """A1: rows by status, with NULL as a status."""
    return rows.groupBy(F.coalesce(col, F.lit("NULL")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def recent_count(rows: DataFrame, at: str, now: Column, hours: int = 24) -> DataFrame:
    """A2."""
    return rows.where(within(F.col(at), now, hours)).agg(F.count(F.lit(1)).alias("n"))


def oldest_by_source(docs: DataFrame, *, key: str = "source_id", at: str = "received_at", id_col: str = "id") -> DataFrame:
    """One row for each source id, the oldest, as an aggregation (no window, no hot task)."""
    rows = docs.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.min_by(F.struct(*docs.columns), F.struct(at, id_col)).alias("r")).select("r.*")


def link_intake(intake: DataFrame, docs: DataFrame) -> DataFrame:
    """``intake_id, linked_id, link_kind``: by document id, else by source id = intake id, else by source id =
    message id; only canonical documents (``canonical``) link. Intake without any document has nulls.

    Three equi-joins, of which the best is taken by one aggregation for each intake row.
    """
    known = docs.where("canonical").select(F.col("id").alias("linked_id"), F.col("source_id"))
    by_source = known.where("source_id IS NOT NULL").groupBy("source_id").agg(F.min("linked_id").alias("linked_id"))
    one = intake.select(F.col("id").alias("intake_id"), "document_id", F.col("message_id").alias("message_id"))
    ways = [
        ("document_id", 1, one.join(known.select("linked_id"), F.col("document_id") == F.col("linked_id"))),
        ("intake_id", 2, one.join(by_source, F.col("intake_id") == F.col("source_id"))),
        ("message_id", 3, one.join(by_source, F.col("message_id") == F.col("source_id"))),
    ]
    found = None
    for kind, rank, rows in ways:
        part = rows.select("intake_id", F.struct(F.lit(rank).alias("rank"), "linked_id", F.lit(kind).alias("kind")).alias("best"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("intake_id").agg(F.min("best").alias("best"))
    return one.select("intake_id").join(best, "intake_id", "left").select(
        "intake_id", F.col("best.linked_id").alias("linked_id"), F.col("best.kind").alias("link_kind")
    )


def link_drift(intake: DataFrame, docs: DataFrame, now: Column, minutes: int = fixed.STAGE_MINUTES["stored"]) -> DataFrame:
    """Stored files that no canonical document names by either source key, older than the limit."""
    named = docs.where("canonical AND source_id IS NOT NULL").select("source_id").distinct()
    rows = intake.where("file_id IS NOT NULL AND storage_status = 'Stored'")
    rows = rows.join(named, F.col("id") == F.col("source_id"), "left_anti")
    rows = rows.join(named, F.col("message_id") == F.col("source_id"), "left_anti")
    return rows.where(age_minutes(F.col("received_at"), now) > minutes)


def storage_state() -> Column:
    """The nested state of the file, else the row's own."""
    return F.coalesce(F.nullif("nested_storage_status", F.lit("")), F.col("storage_status"), F.lit(""))


def lifecycle_state(docs: DataFrame) -> DataFrame:
    """adds ``state, next_action, reason, manual``, by the first of nine rules that holds.

    ``docs`` is documents left-joined with intake (J15): ``has_intake``, ``nested_storage_status``, ``storage_status``. A row
    without id gets the state REJECTED, so that callers can route it.
    """
    processing, publication = F.coalesce("processing_status", F.lit("")), F.coalesce("publication_status", F.lit(""))
    approved, delivery, storage = F.col("approved").eqNullSafe(True), F.coalesce("delivery_status", F.lit("")), storage_state()
    done = publication == "Published"

    def rule(state: str, action: str, reason: Column | str, manual: bool = False) -> Column:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(F.lit(state).alias("state"), F.lit(action).alias("next_action"), reason.alias("reason"), F.lit(manual).alias("manual"))

    found = (
        F.when(F.coalesce(F.col("id").cast("string"), F.lit("")) == "", rule("REJECTED", "none", "document id is required", True))
        .when(processing.isin(*fixed.FAILED_PROCESSING), rule("RECOVERY_REQUIRED", "processing", F.concat(F.lit("processing_state="), processing), True))
        .when(storage.isin(*fixed.FAILED_STORAGE), rule("RECOVERY_REQUIRED", "storage", F.concat(F.lit("storage_state="), storage)))
        .when(done & approved & delivery.isin("Sent", "Delivered"), rule("DELIVERED", "none", "published_and_delivery_confirmed"))
        .when(done & approved, rule("DELIVERY_PENDING", "delivery", "published_and_approved"))
        .when((publication == "Unpublished") & (processing == "Completed"), rule("PUBLICATION_PENDING", "publication", "processing_complete_but_publication_not_confirmed"))
        .when(processing == "Completed", rule("PROCESSED", "publication", "processing_complete"))
        .when(storage.isin("AVAILABLE", "Stored"), rule("STORED", "processing", "storage_confirmed"))
        .when(F.coalesce("has_intake", F.lit(False)), rule("INTAKE_RECEIVED", "storage", "intake_exists_but_storage_not_confirmed"))
        .otherwise(rule("UNKNOWN", "manual_review", "insufficient_evidence", True))
    )
    return docs.withColumn("_found", found).select(*docs.columns, "_found.*")


def with_intake(docs: DataFrame, intake: DataFrame, key: str = "document_id") -> DataFrame:
    """Documents left-joined with their intake row (``nested_storage_status, storage_status, has_intake``)."""
    known = intake.select(F.col(key).alias("id"), "nested_storage_status", "storage_status").withColumn("has_intake", F.lit(True))
    return docs.join(known, "id", "left").withColumn("has_intake", F.coalesce("has_intake", F.lit(False)))


def stuck_intake(intake: DataFrame, docs: DataFrame, now: Column, minutes: int = fixed.STAGE_MINUTES["stored"]) -> DataFrame:
    """``intake_id, status, state, next_action, reason, manual, recoverable`` of each intake row in an open status for longer than the limit.

    The walk starts from intake, so a row without any document (by source id) is judged too, as a document of its id with empty states.
    """
    open_rows = intake.where(F.col("status").isin(*fixed.OPEN_INTAKE) & (F.col("received_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES")))
    known = docs.where("source_id IS NOT NULL").groupBy("source_id")
    known = known.agg(F.max_by(F.struct("id", "processing_status", "publication_status", "approved", "delivery_status"), "id").alias("d"))
    rows = open_rows.select(F.col("id").alias("intake_id"), "status", "nested_storage_status", "storage_status")
    rows = rows.join(known, F.col("intake_id") == F.col("source_id"), "left").select("*", F.lit(True).alias("has_intake"), "d.*")
    rows = rows.withColumn("id", F.coalesce(F.col("id").cast("string"), "intake_id"))
    states = lifecycle_state(rows).select("intake_id", "status", "state", "next_action", "reason", "manual")
    return states.withColumn("recoverable", F.col("next_action") != "none")


def recovery_counts(states: DataFrame) -> DataFrame:
    """By state: rows, and how many of them something can be done for."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if("recoverable").alias("recoverable"))


def relink_legacy(docs: DataFrame, intake: DataFrame, extraction_method: str) -> DataFrame:
    """``id, intake_id, link_kind`` of documents of an old extraction method: by intake's document id, else, for documents with a
    source id, by intake id = source id, else by the document id inside intake's metadata json. Of several the smallest intake id."""
    old = docs.where(F.col("extraction_method") == extraction_method).select("id", "source_id")
    by = lambda key: intake.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.min("id").alias("intake_id"))
    sourced, text = F.col("source_id").isNotNull(), F.col("id").cast("string")
    ways = [
        ("document_id", by(F.col("document_id").cast("string")), text),
        ("intake_id", by(F.col("id").cast("string")), F.col("source_id").cast("string")),
        ("metadata", by(F.get_json_object("metadata", "$.document_id")), F.when(sourced, text)),
    ]
    found = old
    for kind, table, key in ways:
        found = found.withColumn("key", key).join(table.withColumnRenamed("intake_id", f"by_{kind}"), "key", "left").drop("key")
    kinds = [k for k, _, _ in ways]
    kind = F.coalesce(*[F.when(F.col(f"by_{k}").isNotNull(), F.lit(k)) for k in kinds])
    return found.select("id", F.coalesce(*[f"by_{k}" for k in kinds]).alias("intake_id"), kind.alias("link_kind"))


def recovery_plan(docs: DataFrame) -> DataFrame:
    """``id, stage, reason`` of the documents that need work, by the first of four rules; rows without id are skipped."""
    processing, publication, storage = F.coalesce("processing_status", F.lit("")), F.coalesce("publication_status", F.lit("")), storage_state()
    approved = F.col("approved").eqNullSafe(True)

    def rule(stage: str, reason: Column) -> Column:
        return F.struct(F.lit(stage).alias("stage"), reason.alias("reason"))

    found = (
        F.when(processing.isin(*fixed.FAILED_PROCESSING), rule("processing", F.concat(F.lit("processing_state="), processing)))
        .when(storage.isin(*fixed.FAILED_STORAGE_IN_PLANS), rule("storage", F.concat(F.lit("storage_state="), storage)))
        .when((publication == "Unpublished") & (processing == "Completed") & F.col("approved").eqNullSafe(False), rule("publication", F.lit("completed_document_not_published")))
        .when((publication == "Published") & approved, rule("delivery", F.lit("published_document_requires_delivery_reconciliation")))
    )
    return docs.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "").select("id", found.alias("f")).where("f IS NOT NULL").select("id", "f.*")


def state_summary(states: DataFrame) -> DataFrame:
    """A15."""
    return states.groupBy("state", "next_action").agg(F.count(F.lit(1)).alias("n"))


def _findings(rows: DataFrame, entity: str, rules: Sequence[tuple[Column, str, str]], age: Column) -> DataFrame:
    """One pass over a table: an array of the rules that hold, exploded."""
    made = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"))) for test, severity, kind in rules]))
    found = rows.select(F.lit(entity).alias("entity"), F.col("id"), age.alias("age_minutes"), F.explode(made).alias("f"))
    return found.select("entity", "id", "f.severity", "f.kind", "age_minutes")


def health_issues(
    intake: DataFrame, docs: DataFrame, notified: DataFrame, *, now: Column, provenance: str, minutes: Mapping[str, int] = fixed.STAGE_MINUTES
) -> DataFrame:
    """``entity, id, severity, kind, age_minutes``; nine kinds of ISSUE, three of WARNING.

    No row limit: both windows are the caller's filters (P5). ``docs`` are canonical rows; ``notified`` has the ``id`` of
    documents with a delivery audit. Each table is read once for its own rules; the two linkage rules are J3 and J4.
    """
    age = age_minutes(F.col("received_at"), now)
    status, storage = F.col("status"), F.coalesce("storage_status", F.lit(""))
    own = _findings(
        intake, "intake",
        [
            (F.col("file_id").isNotNull() & status.isin("Received", "Processing") & (storage != "Stored") & (age > minutes["intake"]), "ISSUE", "not_stored"),
            ((storage == "Stored") & ((F.coalesce("bucket", F.lit("")) == "") | (F.coalesce("path", F.lit("")) == "")), "ISSUE", "storage_metadata"),
            (status == "Processing Failed", "ISSUE", "ingestion_failed"),
        ],
        age,
    )
    late = intake.where((F.col("storage_status") == "Stored") & (age > minutes["stored"]))  # few rows: only these are linked
    linked = link_intake(late, docs).where("linked_id IS NULL").select(F.col("intake_id").alias("id"))
    unprocessed = _findings(late.join(linked, "id", "left_semi"), "intake", [(F.lit(True), "ISSUE", "no_document")], age)
    drift = _findings(link_drift(intake, docs, now, minutes["stored"]), "intake", [(F.lit(True), "WARNING", "link_drift")], age)
    touched = age_minutes(F.coalesce("updated_at", "received_at"), now)
    processing, published = F.col("processing_status"), F.col("publication_status") == "Published"
    marked = docs.join(notified.select("id").distinct().withColumn("notified", F.lit(True)), "id", "left")
    about_docs = _findings(
        marked, "document",
        [
            ((processing == "Processing") & (touched > minutes["processing"]), "ISSUE", "processing_stalled"),
            (processing == "Processing Failed", "ISSUE", "processing_failed"),
            ((processing == "Completed") & ~F.coalesce("extraction_method", F.lit("")).contains(provenance), "ISSUE", "provenance_missing"),
            ((processing == "Completed") & (F.coalesce("full_text", F.lit("")) == ""), "ISSUE", "text_missing"),
            ((processing == "Completed") & (F.coalesce("backup_id", F.lit("")) == ""), "WARNING", "backup_pending"),
            (published & (~F.coalesce("approved", F.lit(False)) | (F.coalesce("public_url", F.lit("")) == "")), "ISSUE", "publication_inconsistent"),
            (published & F.col("notified").isNull() & (touched > minutes["published"]), "WARNING", "delivery_pending"),
        ],
        touched,
    )
    return own.unionByName(unprocessed).unionByName(drift).unionByName(about_docs)


def health_verdict(issues: DataFrame) -> DataFrame:
    """1 if any hard issue."""
    return issues.agg(F.when(F.count_if(F.col("severity") == "ISSUE") > 0, 1).otherwise(0).alias("exit_status"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """Rows by outcome of a worker's run."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def write_counted(rows: DataFrame, path: str, outcomes: Sequence[str]) -> dict[str, int]:
    """``rows`` written to ``path`` and counted by ``outcome`` on the way: the counters are metrics of the one job that writes.

    A task that is run again does not count twice. Outcomes that are not listed are under ``other`` if there are any.
    """
    seen = Observation("outcomes")
    counters = [F.count_if(F.col("outcome").eqNullSafe(o)).alias(o) for o in outcomes]
    rows.observe(seen, F.count(F.lit(1)).alias("_rows"), *counters).write.parquet(path)
    found = dict(seen.get)
    other = found.pop("_rows") - sum(found.values())
    return found | ({"other": other} if other else {})


def backward_transitions(events: DataFrame, ranks: Mapping[str, int]) -> DataFrame:
    """Events (``id, at, status, event_id``) whose stage comes before that of the document's previous event."""
    rank = F.lit(None).cast("int")
    for status, r in ranks.items():
        rank = F.when(F.col("status") == status, F.lit(r)).otherwise(rank)
    order = Window.partitionBy("id").orderBy("at", "event_id")
    rows = events.withColumn("rank", rank).where("rank IS NOT NULL")
    rows = rows.withColumns({"previous_status": F.lag("status").over(order), "previous_rank": F.lag("rank").over(order)})
    return rows.where("rank < previous_rank").select("id", "event_id", "at", "previous_status", "status")
