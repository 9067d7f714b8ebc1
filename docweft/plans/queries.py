"""Registered queries of the document operators, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import text as tx
from docweft.functions.extract import date_candidates as date_candidates_of
from docweft.functions.extract import normalised_date
from docweft.functions.files import canonical_filename
from docweft.functions.messages import field_lines
from docweft.operators import checks, compare, dedup, deliver, layout, lifecycle, pages, publish, quality, search, vocab
from docweft.plans import model as m

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TS_NOW = f"TIMESTAMP '{m.NOW}'"


def now():
    return F.lit(m.NOW).cast("timestamp_ntz")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- publication -------------------------------------------------------------------------------------------------

_CANON = """c AS (SELECT d.*, first_value(id) OVER (PARTITION BY checksum ORDER BY received_at, id) AS canonical_id FROM d),
g AS (SELECT *, canonical_id <> id AS duplicate FROM c)"""
_REASONS = """array_to_string(list_filter([
  CASE WHEN processing_status IS DISTINCT FROM 'Completed' THEN 'processing_not_completed' END,
  CASE WHEN publication_status IS NOT NULL AND publication_status <> 'Unpublished' THEN 'publication_not_pending' END,
  CASE WHEN coalesce(backup_id, '') = '' THEN 'drive_backup_missing' END, CASE WHEN coalesce(sensitive, false) THEN 'sensitive_document' END,
  CASE WHEN duplicate THEN 'duplicate_document' END, CASE WHEN useful = false THEN 'document_marked_not_useful' END,
  CASE WHEN length(trim(full_text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))) < 80 THEN 'insufficient_ocr_text' END,
  CASE WHEN trim(extraction_method) = '' THEN 'missing_extraction_provenance' END], lambda x: x IS NOT NULL), ',')"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.gate(dedup.canonical_by_checksum(m.documents(spark, sf_dir).drop("full_text")))


@query(f"""WITH {m.DOCUMENTS_SQL}, {_CANON}, q AS (SELECT id, {_REASONS} AS r FROM g)
SELECT id, r = '' AS gate_ok, CASE WHEN r = '' THEN 'ok' ELSE r END AS gate_reason FROM q""")
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P7 over J8: why each document may or may not be published."""
    return _gated(spark, sf_dir).select("id", "gate_ok", "gate_reason")


@query(f"""WITH {m.DOCUMENTS_SQL}, {_CANON}, q AS (SELECT *, {_REASONS} AS r FROM g)
SELECT id, source_app, lang, received_at FROM q WHERE r = '' ORDER BY received_at DESC NULLS LAST, id LIMIT 100""")
def publication_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 100 publishable documents (the limit is the operator)."""
    ok = _gated(spark, sf_dir).where("gate_ok").select("id", "source_app", "lang", "received_at")
    return publish.newest(ok, 100, by=[F.col("received_at").desc_nulls_last(), F.col("id")])


@query(f"WITH {m.DOCUMENTS_SQL}, {_CANON} SELECT id, canonical_id, duplicate FROM g")
def duplicate_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J8, W10."""
    docs = m.documents(spark, sf_dir).select("id", "checksum", "received_at")
    return dedup.canonical_by_checksum(docs).select("id", "canonical_id", "duplicate")


@query("""SELECT doc_id AS id, lang AS category, source AS priority FROM documents
WHERE lang = 'en' AND contains(lower(text), 'the and') AND contains(lower(text), 'is') """)
def archive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive listing by category and literal search texts."""
    d = m.table(spark, sf_dir, "documents")
    pub = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.col("source").alias("priority"), F.col("text").alias("search_text"))
    found = publish.listing(publish.listing(pub, category="en", search=" the, and "), search="IS")
    return found.select("id", "category", "priority")


# --- lifecycle ---------------------------------------------------------------------------------------------------


@query(f"WITH {m.LIFECYCLE_SQL} SELECT coalesce(publication_status, 'NULL') AS status, count(*) AS n FROM ld GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return lifecycle.status_counts(m.lifecycle_documents(spark, sf_dir), "publication_status")


_WITH_INTAKE = f"""{m.LIFECYCLE_SQL}, {m.INTAKE_SQL},
fi AS (SELECT document_id, min(nested_storage_status) AS nested, max(storage_status) AS own FROM i WHERE document_id IS NOT NULL GROUP BY 1),
w AS (SELECT ld.*, coalesce(nullif(nested, ''), own, '') AS st, fi.document_id IS NOT NULL AS has_intake FROM ld LEFT JOIN fi ON ld.id = fi.document_id)"""


def _with_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = m.intake(spark, sf_dir).where("document_id IS NOT NULL").groupBy("document_id")
    i = i.agg(F.min("nested_storage_status").alias("nested_storage_status"), F.max("storage_status").alias("storage_status"))
    return lifecycle.with_intake(m.lifecycle_documents(spark, sf_dir), i)


_STATE = """CASE WHEN processing_status = 'Processing Failed' THEN 'RECOVERY_REQUIRED/processing/processing_state=Processing Failed'
  WHEN st = 'Failed' THEN 'RECOVERY_REQUIRED/storage/storage_state=Failed'
  WHEN publication_status = 'Published' AND coalesce(approved, false) AND coalesce(delivery_status, '') = 'Delivered' THEN 'DELIVERED/none/published_and_delivery_confirmed'
  WHEN publication_status = 'Published' AND coalesce(approved, false) THEN 'DELIVERY_PENDING/delivery/published_and_approved'
  WHEN publication_status = 'Unpublished' AND processing_status = 'Completed' THEN 'PUBLICATION_PENDING/publication/processing_complete_but_publication_not_confirmed'
  WHEN processing_status = 'Completed' THEN 'PROCESSED/publication/processing_complete'
  WHEN st IN ('AVAILABLE', 'Stored') THEN 'STORED/processing/storage_confirmed'
  WHEN has_intake THEN 'INTAKE_RECEIVED/storage/intake_exists_but_storage_not_confirmed'
  ELSE 'UNKNOWN/manual_review/insufficient_evidence' END"""


@query(f"""WITH {_WITH_INTAKE}, s AS (SELECT id, string_split({_STATE}, '/') AS p FROM w)
SELECT id, p[1] AS state, p[2] AS next_action, p[3] AS reason,
  p[1] = 'UNKNOWN' OR p[2] = 'processing' AND p[1] = 'RECOVERY_REQUIRED' AS manual FROM s""")
def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15, F59."""
    return lifecycle.lifecycle_state(_with_intake(spark, sf_dir)).select("id", "state", "next_action", "reason", "manual")


@query(f"""WITH {_WITH_INTAKE}, s AS (SELECT id, string_split({_STATE}, '/') AS p FROM w)
SELECT p[1] AS state, p[2] AS next_action, count(*) AS n FROM s GROUP BY ALL""")
def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return lifecycle.state_summary(lifecycle.lifecycle_state(_with_intake(spark, sf_dir)))


@query(f"""WITH {_WITH_INTAKE}, s AS (SELECT id, CASE WHEN processing_status = 'Processing Failed' THEN 'processing/processing_state=Processing Failed'
  WHEN st = 'Failed' THEN 'storage/storage_state=Failed'
  WHEN publication_status = 'Unpublished' AND processing_status = 'Completed' AND approved = false THEN 'publication/completed_document_not_published'
  WHEN publication_status = 'Published' AND coalesce(approved, false) THEN 'delivery/published_document_requires_delivery_reconciliation' END AS p FROM w)
SELECT id, string_split(p, '/')[1] AS stage, string_split(p, '/')[2] AS reason FROM s WHERE p IS NOT NULL""")
def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F60."""
    return lifecycle.recovery_plan(_with_intake(spark, sf_dir))


def _recent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    i = m.intake(spark, sf_dir)
    docs = m.lifecycle_documents(spark, sf_dir).where(lifecycle.within(F.col("received_at"), now(), 48))
    return i.where(lifecycle.within(F.col("received_at"), now(), 24)), docs


_LINK = """known AS (SELECT source_id, min(id) AS lid FROM ld WHERE canonical AND source_id IS NOT NULL GROUP BY 1),
link AS (SELECT i.id, a.id AS l1, b.lid AS l2, c.lid AS l3 FROM i
  LEFT JOIN (SELECT id FROM ld WHERE canonical) a ON i.document_id = a.id LEFT JOIN known b ON i.id = b.source_id LEFT JOIN known c ON i.message_id = c.source_id)"""


@query(f"""WITH {m.LIFECYCLE_SQL}, {m.INTAKE_SQL}, {_LINK}
SELECT id AS intake_id, coalesce(l1, l2, l3) AS linked_id,
  CASE WHEN l1 IS NOT NULL THEN 'document_id' WHEN l2 IS NOT NULL THEN 'intake_id' WHEN l3 IS NOT NULL THEN 'message_id' END AS link_kind FROM link""")
def intake_document_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, P4."""
    return lifecycle.link_intake(m.intake(spark, sf_dir), m.lifecycle_documents(spark, sf_dir))


_DRIFT = f"""SELECT id, date_diff('second', received_at, {TS_NOW}) / 60.0 AS age FROM i WHERE file_id IS NOT NULL AND storage_status = 'Stored'
  AND id NOT IN (SELECT source_id FROM known) AND (message_id IS NULL OR message_id NOT IN (SELECT source_id FROM known)) AND received_at < {TS_NOW} - INTERVAL 20 MINUTE"""


@query(f"WITH {m.LIFECYCLE_SQL}, {m.INTAKE_SQL}, {_LINK} SELECT id FROM ({_DRIFT})")
def link_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4."""
    return lifecycle.link_drift(m.intake(spark, sf_dir), m.lifecycle_documents(spark, sf_dir), now()).select("id")


_AGE = f"date_diff('second', received_at, {TS_NOW}) / 60.0"
_TOUCH = f"date_diff('second', coalesce(updated_at, received_at), {TS_NOW}) / 60.0"
_HEALTH = f"""WITH {m.LIFECYCLE_SQL}, {m.INTAKE_SQL}, {m.AUDITS_SQL}, {_LINK}, dd AS (SELECT *, {_TOUCH} AS age FROM ld WHERE canonical),
h AS (SELECT 'intake' AS entity, id, 'ISSUE' AS severity, 'not_stored' AS kind, {_AGE} AS age FROM i
  WHERE file_id IS NOT NULL AND status IN ('Received', 'Processing') AND storage_status IS NULL AND {_AGE} > 10
UNION ALL SELECT 'intake', id, 'ISSUE', 'storage_metadata', {_AGE} FROM i WHERE storage_status = 'Stored' AND (bucket IS NULL OR path IS NULL)
UNION ALL SELECT 'intake', id, 'ISSUE', 'ingestion_failed', {_AGE} FROM i WHERE status = 'Processing Failed'
UNION ALL SELECT 'intake', i.id, 'ISSUE', 'no_document', {_AGE} FROM i JOIN link ON i.id = link.id WHERE storage_status = 'Stored' AND coalesce(l1, l2, l3) IS NULL AND {_AGE} > 20
UNION ALL SELECT 'intake', id, 'WARNING', 'link_drift', age FROM ({_DRIFT})
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'ISSUE', 'processing_stalled', age FROM dd WHERE processing_status = 'Processing' AND age > 30
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'ISSUE', 'processing_failed', age FROM dd WHERE processing_status = 'Processing Failed'
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'ISSUE', 'provenance_missing', age FROM dd WHERE processing_status = 'Completed' AND NOT contains(extraction_method, 'vision')
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'ISSUE', 'text_missing', age FROM dd WHERE processing_status = 'Completed' AND full_text = ''
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'WARNING', 'backup_pending', age FROM dd WHERE processing_status = 'Completed' AND backup_id IS NULL
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'ISSUE', 'publication_inconsistent', age FROM dd WHERE publication_status = 'Published' AND (NOT coalesce(approved, false) OR public_url = '')
UNION ALL SELECT 'document', CAST(id AS VARCHAR), 'WARNING', 'delivery_pending', age FROM dd WHERE publication_status = 'Published' AND age > 15 AND id NOT IN (SELECT document_id FROM a))"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent, docs = _recent(spark, sf_dir)
    docs = docs.where("canonical").withColumn("key", F.col("id"))
    notified = m.audits(spark, sf_dir).select(F.col("document_id").alias("id"))
    found = lifecycle.health_issues(recent, docs.where("canonical"), notified, now=now(), provenance="vision")
    return found.withColumn("id", F.col("id").cast("string"))


@query(_HEALTH + " SELECT entity, id, severity, kind, round(age, 3) AS age_minutes FROM h")
def health_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is broken or late, by row."""
    return _health(spark, sf_dir).withColumn("age_minutes", F.round("age_minutes", 3))


@query(_HEALTH + " SELECT severity, kind, count(*) AS n, CASE WHEN severity = 'ISSUE' THEN 1 ELSE 0 END AS exit_status FROM h GROUP BY ALL")
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by kind with the exit status that each asks for."""
    n = _health(spark, sf_dir).groupBy("severity", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("exit_status", F.when(F.col("severity") == "ISSUE", 1).otherwise(0))


@query(f"""SELECT l_orderkey AS document_id, l_linenumber AS job, l_returnflag AS flag, l_shipdate AS next_attempt_at FROM lineitem
WHERE l_returnflag = 'N' OR l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1998-01-01 00:00:00'""")
def ready_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as jobs."""
    li = m.table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "Queued").when(F.col("l_returnflag") == "R", "Failed").otherwise("Done")
    jobs = li.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("job"), F.col("l_returnflag").alias("flag"), F.col("l_shipdate").alias("next_attempt_at"), status.alias("status"))
    return lifecycle.ready_jobs(jobs, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")).drop("status")


RANKS = {"signup": 1, "view": 2, "click": 3, "purchase": 4}


@query("""SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS "at" FROM events GROUP BY 1""")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T7 over a batch."""
    from docweft.streaming.streams import latest_status as latest

    e = m.table(spark, sf_dir, "events").withColumnRenamed("user_id", "id")
    return latest(e, "id", "ts", "event_type", "event_id")


@query("""WITH r AS (SELECT user_id AS id, event_id, ts AS "at", event_type AS status,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 END AS rank FROM events),
l AS (SELECT *, lag(status) OVER w AS previous_status, lag(rank) OVER w AS pr FROM r WHERE rank IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY "at", event_id))
SELECT id, event_id, "at", previous_status, status FROM l WHERE rank < pr""")
def backward_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    e = m.table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").alias("id"), "event_id", F.col("ts").alias("at"), F.col("event_type").alias("status"))
    return lifecycle.backward_transitions(e, RANKS)


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def window_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T9 over a batch."""
    from docweft.streaming.streams import window_counts

    e = m.table(spark, sf_dir, "events")
    out = window_counts(e, "ts", "event_type", "24 hours")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id AS id, min(event_id) AS first_id, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1""")
def oldest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest event of each user and type, counted by user."""
    e = m.table(spark, sf_dir, "events").withColumn("source_id", F.concat_ws("/", "user_id", "event_type"))
    one = lifecycle.oldest_by_source(e, at="ts", id_col="event_id")
    return one.groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


# --- delivery ----------------------------------------------------------------------------------------------------


@query(f"""WITH {m.LIFECYCLE_SQL}, {m.AUDITS_SQL}, ok AS (SELECT DISTINCT document_id, chat_id FROM a WHERE coalesce(result, 'Sent') = 'Sent')
SELECT id AS document_id, c AS chat_id FROM ld, (SELECT unnest(['c0', 'c1', 'c2', 'c3']) AS c) WHERE publication_status = 'Published' AND coalesce(approved, false)
  AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.document_id = id AND ok.chat_id = c)""")
def delivery_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, P21, J6."""
    a = m.audits(spark, sf_dir)
    published = m.lifecycle_documents(spark, sf_dir).where(lifecycle.published_and_approved())
    extra = a.select(F.concat(F.col("chat_id"), F.lit(" ")).alias("chat_id"))
    return deliver.worklist(published, deliver.recipients(a, extra), a, "delivery")


@query(f"""WITH {m.LIFECYCLE_SQL}, {m.AUDITS_SQL} SELECT DISTINCT document_id, chat_id FROM a JOIN ld ON ld.id = a.document_id
WHERE coalesce(result, 'Sent') = 'Sent'""")
def already_delivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    a = m.audits(spark, sf_dir)
    docs = m.lifecycle_documents(spark, sf_dir).select(F.col("id").alias("document_id"))
    pairs = a.select("document_id", "chat_id").distinct().join(docs, "document_id", "left_semi")
    return deliver.already_delivered(pairs, a, "delivery")


_ATTEMPTS = """t AS (SELECT user_id AS document_id, 'c' || (event_id % 4) AS chat_id,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'message_sent' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN CASE WHEN event_id % 10 = 0 THEN 'sent' ELSE 'failed' END ELSE 'pending' END AS status,
  CASE WHEN event_type = 'view' THEN event_id END AS message_id, ts AS "at", event_id FROM events)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = m.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    status = F.when(kind == "view", "message_sent").when(kind == "error", "failed").when((kind == "purchase") & (F.col("event_id") % 10 == 0), "sent").when(kind == "purchase", "failed").otherwise("pending")
    return e.select(F.col("user_id").alias("document_id"), F.concat(F.lit("c"), F.col("event_id") % 4).alias("chat_id"), status.alias("status"), F.when(kind == "view", F.col("event_id")).alias("message_id"), F.col("ts").alias("at"), "event_id")


_FOLD = f"""WITH {_ATTEMPTS}, f AS (SELECT document_id, chat_id,
  CASE WHEN count(*) FILTER (status = 'sent') > 0 THEN 'sent' ELSE arg_max(status, ("at", event_id)) END AS status,
  count(*) FILTER (status = 'pending') AS attempts, arg_max(message_id, ("at", event_id)) FILTER (message_id IS NOT NULL) AS message_id,
  min("at") AS first_attempt_at, max("at") AS last_attempt_at FROM t GROUP BY 1, 2)"""


@query(_FOLD + " SELECT *, message_id IS NOT NULL AND status <> 'sent' AS resumable FROM f")
def delivery_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5 over a batch."""
    return deliver.fold_attempts(_attempts(spark, sf_dir))


@query(_FOLD + f""", r AS (SELECT DISTINCT user_id AS document_id, 'c' || (event_id % 5) AS chat_id FROM events WHERE event_type = 'click'),
x AS (SELECT r.document_id, r.chat_id, f.status, f.attempts, f.first_attempt_at, f.last_attempt_at,
  f.status IS DISTINCT FROM 'sent' AND NOT coalesce(f.last_attempt_at > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 10 MINUTE, false) AS claimed FROM r LEFT JOIN f USING (document_id, chat_id))
SELECT document_id, chat_id, claimed, CAST(coalesce(attempts, 0) + CASE WHEN claimed THEN 1 ELSE 0 END AS INT) AS attempts,
  CASE WHEN claimed THEN coalesce(first_attempt_at, TIMESTAMP '2024-01-30 12:00:00') ELSE first_attempt_at END AS first_attempt_at,
  CASE WHEN claimed THEN TIMESTAMP '2024-01-30 12:00:00' ELSE last_attempt_at END AS last_attempt_at FROM x""")
def delivery_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4 over a batch: claims by clicks against the folded state."""
    state = deliver.fold_attempts(_attempts(spark, sf_dir)).withColumn("locked_at", F.col("last_attempt_at"))
    e = m.table(spark, sf_dir, "events").where("event_type = 'click'")
    asked = e.select(F.col("user_id").alias("document_id"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("chat_id"))
    return deliver.claim(state, asked, F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


# --- comparison --------------------------------------------------------------------------------------------------


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, key = m.table(spark, sf_dir, "customer"), F.col("c_custkey")
    fields = F.array(
        F.struct(F.lit("full_name").alias("k"), F.col("c_name").alias("p"), F.when(key % 3 == 0, F.translate(F.lower("c_name"), "#", "-")).when(key % 3 == 1, F.col("c_name")).alias("s")),
        F.struct(F.lit("segment").alias("k"), F.when(key % 4 != 0, F.col("c_mktsegment")).alias("p"), F.when(key % 5 == 0, F.concat(F.lit(" "), F.lower("c_mktsegment"))).when(key % 5 == 1, F.lit("OTHER")).otherwise(F.col("c_mktsegment")).alias("s")),
    )
    rows = c.select(key.alias("entity"), F.explode(fields).alias("f"))
    portal = rows.where("NOT (entity % 7 = 0 AND f.k = 'segment')").select("entity", F.lit("general").alias("profile_type"), F.col("f.k").alias("field_key"), F.col("f.p").alias("value"))
    source = rows.where("NOT (entity % 8 = 0 AND f.k = 'full_name')").select("entity", F.lit("general").alias("profile_type"), F.col("f.k").alias("field_key"), F.col("f.s").alias("value"))
    return compare.compare_profiles(portal, source)


_PROFILES = r"""WITH p AS (SELECT c_custkey AS entity, 'full_name' AS field_key, c_name AS v FROM customer UNION ALL
  SELECT c_custkey, 'segment', CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END FROM customer WHERE c_custkey % 7 <> 0),
s AS (SELECT c_custkey AS entity, 'full_name' AS field_key, CASE c_custkey % 3 WHEN 0 THEN replace(lower(c_name), '#', '-') WHEN 1 THEN c_name END AS v FROM customer WHERE c_custkey % 8 <> 0 UNION ALL
  SELECT c_custkey, 'segment', CASE c_custkey % 5 WHEN 0 THEN ' ' || lower(c_mktsegment) WHEN 1 THEN 'OTHER' ELSE c_mktsegment END FROM customer),
b AS (SELECT entity, 'general' AS profile_type, field_key, CASE field_key WHEN 'full_name' THEN 'Full Name' ELSE 'Segment' END AS label, p.v AS portal_value, s.v AS source_value,
  lower(trim(coalesce(p.v, ''))) AS a, lower(trim(coalesce(s.v, ''))) AS z FROM p FULL JOIN s USING (entity, field_key)),
k AS (SELECT *, CASE WHEN a = '' AND z = '' THEN 'NOT_AVAILABLE' WHEN a = '' THEN 'MISSING_IN_PORTAL' WHEN z = '' THEN 'MISSING_IN_SOURCE' WHEN a = z THEN 'MATCH'
  WHEN regexp_replace(a, '[^a-z0-9]', '', 'g') = regexp_replace(z, '[^a-z0-9]', '', 'g') THEN 'MINOR_VARIATION' ELSE 'VALUE_DIFFERENT' END AS status FROM b),
c AS (SELECT entity, profile_type, field_key, label, portal_value, source_value, status,
  CASE WHEN status IN ('MISSING_IN_PORTAL', 'MINOR_VARIATION', 'VALUE_DIFFERENT') THEN source_value WHEN status = 'MATCH' THEN portal_value END AS proposed FROM k)"""


@query(_PROFILES + " SELECT * FROM c")
def profile_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, F45, F46, U2."""
    return _profiles(spark, sf_dir)


@query(_PROFILES + " SELECT * FROM c WHERE status IN ('MISSING_IN_PORTAL', 'MINOR_VARIATION', 'VALUE_DIFFERENT') AND coalesce(proposed, '') <> ''")
def change_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10."""
    return compare.change_preview(_profiles(spark, sf_dir))


@query("""WITH a AS (SELECT p_partkey AS key, p_size AS size, sha256(p_name) AS h FROM part WHERE p_partkey % 10 <> 0),
b AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size, sha256(CASE WHEN p_partkey % 9 = 0 THEN 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 11 <> 0)
SELECT key, CASE WHEN a.h IS NULL THEN 'MISSING_IN_PRIMARY' WHEN b.h IS NULL THEN 'MISSING_IN_BACKUP' WHEN a.size <> b.size THEN 'SIZE_MISMATCH'
  WHEN a.h <> b.h THEN 'HASH_MISMATCH' ELSE 'OK' END AS verdict FROM a FULL JOIN b USING (key)""")
def inventory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as two inventories."""
    p, key = m.table(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.where(key % 10 != 0).select(key.alias("key"), F.col("p_size").alias("size"), F.sha2("p_name", 256).alias("sha256"))
    b = p.where(key % 11 != 0).select(key.alias("key"), F.when(key % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.sha2(F.when(key % 9 == 0, "x").otherwise(F.col("p_name")), 256).alias("sha256"))
    return compare.reconcile_inventories(a, b)


@query("""SELECT s_suppkey AS file_id, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'S' || s_suppkey END AS wanted, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'S' || s_suppkey END AS name FROM supplier
WHERE (s_suppkey % 3 = 0) <> (s_suppkey % 2 = 0)""")
def name_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files."""
    s, key = m.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    short = F.concat(F.lit("S"), key)
    docs = s.select(key.alias("file_id"), F.when(key % 3 == 0, F.col("s_name")).otherwise("").alias("display_filename"), short.alias("original_filename"))
    return compare.name_drift(docs, s.select(key.alias("file_id"), F.when(key % 2 == 0, F.col("s_name")).otherwise(short).alias("name")))


@query(f"""WITH {m.LIFECYCLE_SQL}, q AS (SELECT id AS o, id + 5 AS n FROM ld WHERE id % 5 = 0),
ok AS (SELECT o, n, a.id % 4 + 1 AS v FROM q JOIN ld a ON a.id = o JOIN ld b ON b.id = n WHERE a.publication_status = 'Published' AND b.publication_status = 'Published')
SELECT o AS id, 'Superseded' AS publication_status, n AS canonical_id, CAST(NULL AS BIGINT) AS supersedes_id, CAST(v AS INT) AS version FROM ok
UNION ALL SELECT n, 'Published', NULL, o, CAST(v + 1 AS INT) FROM ok""")
def supersede_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J20."""
    docs = m.lifecycle_documents(spark, sf_dir).select("id", "publication_status", (F.col("id") % 4 + 1).cast("int").alias("version"))
    return dedup.supersede(docs, docs.where("id % 5 = 0").select(F.col("id").alias("old_id"), (F.col("id") + 5).alias("new_id")))


@query("""SELECT o_orderkey AS id, o_custkey AS n FROM orders o WHERE o_orderkey % 2 = 0 UNION ALL
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0""")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders into a target that has the even ones."""
    o = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("n"))
    target, incoming = o.where("id % 2 = 0"), o.where("id % 3 = 0")
    return target.unionByName(dedup.insert_if_absent(target, incoming.unionByName(incoming), ["id"], order="n"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderstatus END AS status, o_custkey AS n FROM orders""")
def patch_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9."""
    o = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("n"))
    return dedup.patch_by_key(o, o.where("id % 3 = 0").select("id", F.lit("patched").alias("status"), F.lit(None).cast("long").alias("n")), ["id"])


# --- taxonomy ----------------------------------------------------------------------------------------------------

DEFINITIONS = [
    {"category_key": "first", "sort_order": 1, "office_terms": ["src1"], "content_terms": ["the and", "this is"], "aliases": ["des"]},
    {"category_key": "second", "sort_order": 2, "office_terms": ["src2"], "content_terms": ["of the", "die der"], "aliases": ["que"]},
    {"category_key": "third", "sort_order": 3, "office_terms": ["src3", "src4"], "content_terms": ["de la"], "aliases": ["on the", "und"]},
    {"category_key": "other", "sort_order": 0, "office_terms": ["src"], "content_terms": ["e"], "aliases": []},
]


def _score_sql() -> str:
    parts = []
    for d in DEFINITIONS[:3]:
        hit = lambda t, of: f"CASE WHEN contains({of}, '{t}') THEN 1 ELSE 0 END"
        office = " + ".join(hit(t, "o") for t in d["office_terms"])
        content = " + ".join(hit(t, "c") for t in d["content_terms"])
        alias = " + ".join(hit(t, "o || ' ' || c") for t in d["aliases"])
        parts.append(f"({office}) AS h{d['sort_order']}, 8 * ({office}) + 3 * ({content}) + 2 * ({alias}) AS s{d['sort_order']}")
    return ", ".join(parts)


_FOLDED = r"replace(lower(trim(regexp_replace(coalesce({0}, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'))), 'ß', 'ss')"


@query(f"""WITH f AS (SELECT doc_id AS id, {_FOLDED.format("source")} AS o, {_FOLDED.format("text")} AS c FROM documents), s AS (SELECT id, {_score_sql()} FROM f),
b AS (SELECT *, greatest(s1, s2, s3) AS m FROM s), k AS (SELECT id, m, CASE WHEN m = 0 THEN 'other' WHEN s1 = m THEN 'first' WHEN s2 = m THEN 'second' ELSE 'third' END AS category_key,
  CASE WHEN s1 = m THEN h1 WHEN s2 = m THEN h2 ELSE h3 END AS h FROM b)
SELECT id, category_key, m AS category_score, CASE WHEN m = 0 THEN 'LOW' WHEN h > 0 OR m >= 8 THEN 'HIGH' WHEN m >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS category_confidence FROM k""")
def category_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A10."""
    d = m.table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "id")
    return vocab.suggest_category(d, F.col("source"), F.col("text"), DEFINITIONS).select("id", "category_key", "category_score", "category_confidence")


_DEFS = """v AS (SELECT n_name AS category_key, k AS version, n_name || ' v' || k AS display_name,
  TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 2 YEAR * (k - 1) AS valid_from,
  CASE WHEN k < 1 + n_nationkey % 3 THEN TIMESTAMP '1995-01-01 00:00:00' + INTERVAL 2 YEAR * k END AS valid_to FROM nation, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= 1 + n_nationkey % 3),
c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 26 = 25 THEN 'unlisted' ELSE 'NATION_' || (o_orderkey % 26) END AS category_key, o_orderdate AS "at" FROM orders)"""


def _definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = m.table(spark, sf_dir, "nation").withColumn("version", F.explode(F.sequence(F.lit(1), 1 + F.col("n_nationkey") % 3)))
    year = lambda k: F.make_timestamp_ntz(1995 + 2 * k, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return n.select(
        F.col("n_name").alias("category_key"), F.col("version").cast("int").alias("version"), F.concat("n_name", F.lit(" v"), "version").alias("display_name"),
        year(F.col("version") - 1).alias("valid_from"), F.when(F.col("version") < 1 + F.col("n_nationkey") % 3, year(F.col("version"))).alias("valid_to"),
    )


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 26 == 25, "unlisted").otherwise(F.concat(F.lit("NATION_"), key % 26))
    return m.table(spark, sf_dir, "orders").select(key.alias("id"), name.alias("category_key"), F.col("o_orderdate").alias("at"))


@query(f"WITH {_DEFS} SELECT id, c.category_key, coalesce(display_name, c.category_key) AS category_label FROM c LEFT JOIN v ON v.category_key = c.category_key AND valid_to IS NULL")
def category_current_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1."""
    return vocab.join_current(_categorised(spark, sf_dir), _definitions(spark, sf_dir)).select("id", "category_key", "category_label")


@query(f"""WITH {_DEFS} SELECT id, c.category_key, version AS category_version, display_name AS category_label FROM c
LEFT JOIN v ON v.category_key = c.category_key AND valid_from <= "at" AND (valid_to IS NULL OR "at" < valid_to)""")
def category_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2."""
    return vocab.join_as_of(_categorised(spark, sf_dir), _definitions(spark, sf_dir), "at").drop("at")


@query(f"""WITH {_DEFS}, n AS (SELECT category_key, max(version) + 1 AS version, category_key || ' new' AS display_name, TIMESTAMP '2002-01-01 00:00:00' AS valid_from FROM v WHERE category_key LIKE '%1' GROUP BY 1),
u AS (SELECT *, NULL AS x FROM n UNION ALL SELECT category_key, version, display_name, valid_from, valid_to FROM v)
SELECT category_key, CAST(version AS INT) AS version, display_name, valid_from, coalesce(x, lead(valid_from) OVER (PARTITION BY category_key ORDER BY version)) AS valid_to FROM u""")
def scd2_close_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12."""
    d = _definitions(spark, sf_dir)
    keys = d.where("category_key LIKE '%1'").select("category_key").distinct()
    changes = keys.select("category_key", F.concat("category_key", F.lit(" new")).alias("display_name"), F.lit("2002-01-01 00:00:00").cast("timestamp_ntz").alias("valid_from"))
    return vocab.close_and_insert(d, changes)


VOCABULARY = {"en": ["the", "and of", "this"], "fr": ["des", "que la", "dans"], "de": ["der", "die", "und"], "es": ["las", "para"]}


def _match_sql() -> str:
    out = []
    for k, terms in VOCABULARY.items():
        body = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
        out.append(rf"CASE WHEN regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({body})([^\p{{L}}\p{{M}}\p{{N}}_]|$)') THEN '{k}' END")
    return "list_sort(list_filter([" + ", ".join(out) + "], lambda x: x IS NOT NULL))"


@query(f"""WITH k AS (SELECT doc_id AS id, {_match_sql()} AS ks FROM documents)
SELECT id, CASE WHEN len(ks) = 1 THEN ks[1] END AS key, len(ks) > 1 AS ambiguous, CASE WHEN len(ks) > 1 THEN array_to_string(ks, ',') ELSE '' END AS candidates FROM k""")
def vocab_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, A11."""
    d = m.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), vocab.resolve(F.col("text"), VOCABULARY).alias("r")).select("id", "r.*")


@query("""WITH b AS (SELECT item_id AS case_id, unnest(list_distinct(string_split(lower(text), ' '))) AS term FROM benchmark),
v AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM documents) SELECT case_id, term FROM b WHERE term NOT IN (SELECT term FROM v)""")
def vocab_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items that no document has."""
    cases = m.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.array_distinct(F.split(F.lower("text"), " ")).alias("expected_terms"))
    words = m.table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("term"))
    return vocab.coverage_gaps(cases, words)


# --- search, text and files --------------------------------------------------------------------------------------


@query(rf"""WITH f AS (SELECT doc_id AS id, lang, {_FOLDED.format("text")} AS t FROM documents WHERE lang = 'en'),
s AS (SELECT id, lang, round((CASE WHEN contains(t, 'thanea') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'stand') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'there') THEN 1 ELSE 0 END) / 3.0, 4) AS score FROM f)
SELECT id, lang, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 20""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 (the limit is the operator)."""
    d = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    return search.search(d, "Thanea stand, THERE a", text=publish.searchable([F.col("text")]), filters={"lang": " EN"}).select("id", "lang", "score")


_NORMAL = r"""WITH a AS (SELECT doc_id AS id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
b AS (SELECT id, replace(replace(t, chr(160), ' '), chr(8203), '') AS t FROM a), c AS (SELECT id, regexp_replace(t, '[ \t]+', ' ', 'g') AS t FROM b),
d AS (SELECT id, regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '^[\s\xA0]+|[\s\xA0]+$', '', 'g') AS t FROM c),
e AS (SELECT id, replace(replace(t, '–', '-'), '—', '-') AS t FROM d), g AS (SELECT id, regexp_replace(regexp_replace(t, '[ \t]+([,.:;])', '\1', 'g'), '[,;:]+([,;:])', '\1', 'g') AS t FROM e)"""


@query(_NORMAL + r" SELECT id, sha256(regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '^[\s\xA0]+|[\s\xA0]+$', '', 'g')) AS normalised FROM g")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F4, F7, F6, F9 over whole texts (F8, whose lookarounds SQL lacks, is a unit test); digests of the results."""
    c = tx.line_whitespace(F.col("text"))
    out = tx.line_whitespace(tx.punctuation(tx.label_aliases(tx.phrase_aliases(tx.unicode_equivalents(c)))))
    return m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(out, 256).alias("normalised"))


@query(rf"""SELECT c_custkey AS id, {_FOLDED.format("c_name || '  ' || c_mktsegment")} AS folded, regexp_replace(lower(c_name || c_mktsegment), '[^a-z0-9]', '', 'g') AS compact FROM customer""")
def compare_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14."""
    c = m.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), tx.folded(F.concat("c_name", F.lit("  "), "c_mktsegment")).alias("folded"), tx.compact(F.concat("c_name", "c_mktsegment")).alias("compact"))


@query(r"""WITH t AS (SELECT o_orderkey AS id, 'on ' || (o_orderkey % 35) || '/' || (o_orderkey % 14) || '/' || (1995 + o_orderkey % 9) || ' or ' || strftime(o_orderdate, '%Y-%m-%d') || '.' AS x,
  (o_orderkey % 35) AS d, (o_orderkey % 14) AS mo, (1995 + o_orderkey % 9) AS y FROM orders)
SELECT id, d || '/' || mo || '/' || y AS text, CAST(3 AS INT) AS "start", try_cast(y || '-' || lpad(CAST(mo AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS valid FROM t
UNION ALL SELECT id, x[-11:-2], CAST(length(x) - 11 AS INT), true FROM t""")
def date_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("on "), key % 35, F.lit("/"), key % 14, F.lit("/"), 1995 + key % 9, F.lit(" or "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("."))
    return m.table(spark, sf_dir, "orders").select(key.alias("id"), F.explode(date_candidates_of(text)).alias("d")).select("id", "d.text", "d.start", "d.valid")


@query("""SELECT p_partkey AS id, strftime(try_cast((1995 + p_partkey % 9) || '-' || lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_partkey % 35 AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d') AS day FROM part""")
def normalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F20."""
    key = F.col("p_partkey")
    printed = F.concat_ws(".", key % 35, key % 14, F.when(key % 9 > 4, key % 9 - 5 + 2000).otherwise(1995 + key % 9))
    return m.table(spark, sf_dir, "part").select(key.alias("id"), normalised_date(printed).cast("string").alias("day"))


@query(r"""SELECT p_partkey AS id, concat_ws('_', '2024-01-0' || (1 + p_partkey % 9), trim(replace(p_brand, '#', '#')), trim(regexp_replace(p_name, '[<>:"/\\|?*]', ' ', 'g')), CASE WHEN p_partkey % 2 = 0 THEN 'R ' || p_partkey END) || CASE WHEN p_partkey % 3 = 0 THEN '.jpg' ELSE '.pdf' END AS name FROM part""")
def canonical_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F37."""
    p, key = m.table(spark, sf_dir, "part"), F.col("p_partkey")
    original = F.concat(F.lit("file"), F.when(key % 3 == 0, ".JPG").otherwise(""))
    reference = F.when(key % 2 == 0, F.concat(F.lit("R/"), key))
    return p.select(key.alias("id"), canonical_filename(original, F.col("p_name"), F.col("p_brand"), F.concat(F.lit("2024-01-0"), 1 + key % 9), reference).alias("name"))


@query("""SELECT s_suppkey AS id, concat_ws(chr(10), 'Name: ' || replace(s_name, '#', '&lt;'), CASE WHEN s_suppkey % 2 = 0 THEN 'Nation: ' || s_nationkey END) AS message FROM supplier""")
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F40."""
    s = m.table(spark, sf_dir, "supplier")
    name = F.translate("s_name", "#", "<")
    return s.select(F.col("s_suppkey").alias("id"), field_lines([("Name", name), ("Nation", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey"))), ("Empty", F.lit(" "))]).alias("message"))


@query("""SELECT l_orderkey AS id, 'tax_below_8_percent' AS rule FROM lineitem WHERE NOT l_tax < 0.08 UNION ALL
SELECT l_orderkey, 'flag_enum' FROM lineitem WHERE l_returnflag NOT IN ('N', 'R') UNION ALL SELECT l_orderkey, 'quantity_least' FROM lineitem WHERE l_quantity < 5""")
def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    li = m.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "id")
    rules = {"tax_below_8_percent": F.col("l_tax") < 0.08, "flag_enum": F.col("l_returnflag").isin("N", "R"), "quantity_least": F.col("l_quantity") >= 5}
    return checks.constraint_report(li, rules)


@query("""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'filename' ELSE '' END AS missing_keys, CAST(event_id % 4 AS INT) AS page_count,
  event_id % 4 > 0 AND event_id % 5 <> 0 AS sequential_pages, event_id % 3 <> 0 AND event_id % 4 > 0 AND event_id % 5 <> 0 AS valid FROM events""")
def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results built from events."""
    e, key = m.table(spark, sf_dir, "events"), F.col("event_id")
    first = F.when(key % 5 == 0, 2).otherwise(1)
    pages_json = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(key % 4, F.lit(1))), lambda i: F.concat(F.lit('{"page_number":'), i + first - 1, F.lit("}"))), ","), F.lit("]"))
    pages_json = F.when(key % 4 == 0, "[]").otherwise(pages_json)
    result = F.concat(F.lit('{"schema_version":"1","text":"","normalized_text":"","ocr":{},'), F.when(key % 3 != 0, '"filename":"f",').otherwise(""), F.lit('"pages":'), pages_json, F.lit("}"))
    return checks.release_gate(e.select(key.alias("id"), result.alias("result"))).drop("result")


# --- pages and quality -------------------------------------------------------------------------------------------


def _columns_sql() -> str:
    """Columns of the regions ``r``."""
    return """WITH o AS (SELECT *, max(x2) OVER (PARTITION BY doc_id ORDER BY x1, x2, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM r),
s AS (SELECT *, sum(CASE WHEN x1 - far >= 24 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x1, x2, id ROWS UNBOUNDED PRECEDING) AS isl FROM o),
z AS (SELECT *, count(*) OVER (PARTITION BY doc_id, isl) AS sz, count(*) OVER (PARTITION BY doc_id) AS al FROM s),
k AS (SELECT doc_id, isl, row_number() OVER (PARTITION BY doc_id ORDER BY isl) - 1 AS rk, count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, isl FROM z WHERE sz >= 2))
SELECT z.doc_id, z.page, z.id, CAST(CASE WHEN coalesce(n2, 0) >= 2 AND al >= 4 THEN coalesce(rk, 0) ELSE 0 END AS INT) AS "column", CAST(CASE WHEN coalesce(n2, 0) >= 2 AND al >= 4 THEN n2 ELSE 1 END AS INT) AS column_count
FROM z LEFT JOIN k ON k.doc_id = z.doc_id AND k.isl = z.isl LEFT JOIN (SELECT doc_id, max(n) AS n2 FROM k GROUP BY 1) q ON q.doc_id = z.doc_id"""


@query(f"WITH {m.REGIONS_SQL}, co AS ({_columns_sql()}) SELECT * FROM co")
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return layout.columns(m.regions(spark, sf_dir)).select("doc_id", "page", "id", "column", "column_count")


#: Lines of a page by recursion over its regions: each joins the nearest line whose head is near or overlaps it by half.
_LINES_SQL = """n AS (SELECT *, (y1 + y2) / 2.0 AS c, greatest(1, y2 - y1) AS h, row_number() OVER (PARTITION BY doc_id, page ORDER BY (y1 + y2) / 2.0, x1, id) AS n FROM r),
f AS (SELECT DISTINCT doc_id, page, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(c DOUBLE, x1 INT, id BIGINT, y1 INT, y2 INT, h INT, m STRUCT(x1 INT, id BIGINT)[])[]) AS ls FROM n
UNION ALL SELECT doc_id, page, n, CASE WHEN best IS NULL THEN list_append(ls, {'c': c, 'x1': x1, 'id': id, 'y1': y1, 'y2': y2, 'h': h, 'm': [{'x1': x1, 'id': id}]})
  ELSE list_transform(ls, lambda l, i: CASE WHEN i <> best THEN l
    WHEN x1 < l.x1 OR (x1 = l.x1 AND id < l.id) THEN {'c': c, 'x1': x1, 'id': id, 'y1': y1, 'y2': y2, 'h': h, 'm': list_append(l.m, {'x1': x1, 'id': id})}
    ELSE {'c': l.c, 'x1': l.x1, 'id': l.id, 'y1': l.y1, 'y2': l.y2, 'h': l.h, 'm': list_append(l.m, {'x1': x1, 'id': id})} END) END
FROM (SELECT o.*, f.ls, (list_sort(list_filter(list_transform(f.ls, lambda l, i: {'a': abs(l.c - o.c), 'i': i,
    'ok': abs(l.c - o.c) <= 12 OR 2 * greatest(0, least(l.y2, o.y2) - greatest(l.y1, o.y1)) >= least(l.h, o.h)}), lambda z: z.ok))[1]).i AS best
  FROM f JOIN n o ON o.doc_id = f.doc_id AND o.page = f.page AND o.n = f.n + 1)),
g AS (SELECT doc_id, page, list_transform(list_sort(ls), lambda l: list_sort(l.m)) AS ls FROM f QUALIFY n = max(n) OVER (PARTITION BY doc_id, page)),
pl AS (SELECT doc_id, page, line, unnest(l).id AS id, unnest(range(0, len(l))) AS place FROM (SELECT doc_id, page, unnest(ls) AS l, unnest(range(0, len(ls))) AS line FROM g))"""


def _page_lines_sql(regions: str) -> str:
    return f"""WITH RECURSIVE {regions}, {_LINES_SQL}, co AS ({_columns_sql()}),
j AS (SELECT co.*, pl.line, pl.place, r.x1, r.y1, max(pl.line) OVER (PARTITION BY co.doc_id, co.page) = 0 AS one FROM co JOIN pl USING (doc_id, page, id) JOIN r USING (doc_id, page, id)),
k AS (SELECT *, column_count >= 2 AND NOT one AS by_column FROM j)
SELECT doc_id, page, id, CAST(line AS INT) AS line, "column", CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN by_column THEN "column" ELSE 0 END,
  CASE WHEN by_column OR one THEN y1 ELSE line END, CASE WHEN by_column OR one THEN x1 ELSE place END, id) - 1 AS INT) AS position FROM k"""


def _page_tables_sql(regions: str) -> str:
    return f"""WITH RECURSIVE {regions}, {_LINES_SQL}, e AS (SELECT doc_id, page, list_transform(ls, lambda l: list_transform(l, lambda z: z.x1)) AS ed FROM g),
t AS (SELECT *, list_reduce(list_transform(flatten(ed), lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda y: abs(y - x[1]) <= 12)) > 0 THEN a ELSE list_concat(a, x) END) AS ta FROM e),
a AS (SELECT doc_id, page, len(list_filter(ta, lambda x: len(list_filter(ed, lambda l: len(list_filter(l, lambda y: abs(y - x) <= 12)) > 0)) >= 2)) AS n, len(ed) AS line_count, len(list_filter(ed, lambda l: len(l) >= 2)) AS candidate_rows FROM t)
SELECT doc_id, page, line_count, candidate_rows, CASE WHEN line_count >= 2 THEN n ELSE 0 END AS repeated_columns, CASE WHEN line_count >= 2 THEN n ELSE 0 END >= 2 AND line_count >= 2 AS table_candidate FROM a"""


@query(_page_lines_sql(m.REGIONS_SQL))
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and reading order."""
    return layout.reading_places(m.regions(spark, sf_dir)).select("doc_id", "page", "id", "line", "column", "position")


@query(_page_lines_sql(m.SHARED_REGIONS_SQL))
def shared_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, W5 where regions share lines."""
    return layout.reading_places(m.shared_line_regions(spark, sf_dir)).select("doc_id", "page", "id", "line", "column", "position")


@query(_page_tables_sql(m.REGIONS_SQL))
def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8."""
    r = m.regions(spark, sf_dir)
    return layout.table_evidence(layout.lines(r), layout.table_anchors(r))


@query(_page_tables_sql(m.SHARED_REGIONS_SQL))
def shared_page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W7, W8 where regions share lines."""
    r = m.shared_line_regions(spark, sf_dir)
    return layout.table_evidence(layout.lines(r), layout.table_anchors(r))


@query(f"""WITH RECURSIVE {m.SHARED_REGIONS_SQL}, {_LINES_SQL} SELECT doc_id, page, CAST(line AS INT) AS line, string_agg(r.text, ' ' ORDER BY place) AS text FROM pl JOIN r USING (doc_id, page, id) WHERE r.text <> '' GROUP BY ALL""")
def shared_line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6 where regions share lines."""
    r = m.shared_line_regions(spark, sf_dir)
    return layout.line_texts(r, layout.lines(r))


@query(f"""WITH {m.REGIONS_SQL} SELECT doc_id, page, count(*) AS region_count, count(confidence) AS scored_count, round(avg(confidence), 6) AS mean_confidence, min(confidence) AS least_confidence,
  coalesce(round(avg(confidence), 6) < 0.7, false) AS low_confidence, false AS approval FROM r GROUP BY 1, 2""")
def confidence_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A5."""
    out = pages.confidence_rollup(m.regions(spark, sf_dir), ["doc_id", "page"])
    mean = F.round("mean_confidence", 6)
    return out.withColumns({"mean_confidence": mean, "low_confidence": F.coalesce(mean < 0.7, F.lit(False))})


@query(f"WITH {m.REGIONS_SQL} SELECT doc_id, count(*) AS candidate_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS candidates FROM r WHERE confidence < 0.65 GROUP BY 1")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, A16."""
    return layout.review_contract(m.regions(spark, sf_dir))


_METHOD = "CASE WHEN turn % 3 = 0 THEN 'embedded-text' ELSE 'ocr:e' || (turn % 2) END"


@query(f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, {_METHOD} AS method, CASE WHEN turn % 3 <> 0 THEN 'e' || (turn % 2) END AS engine FROM conversations)
SELECT doc_id, count(*) AS page_count, count(*) FILTER (method LIKE 'ocr:%') AS recognised_pages, count(*) FILTER (method = 'embedded-text') AS embedded_pages,
  coalesce(string_agg(DISTINCT engine, ',' ORDER BY engine), '') AS engines, string_agg(method, ',' ORDER BY page, method) AS methods, count(DISTINCT method) > 1 AS mixed,
  CASE WHEN bool_or(method LIKE 'ocr:%') AND bool_or(method = 'embedded-text') THEN 'mixed' WHEN bool_or(method LIKE 'ocr:%') THEN 'ocr' ELSE 'embedded' END AS method_label FROM p GROUP BY 1""")
def multipage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as pages."""
    t = F.col("turn")
    rows = m.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), t.alias("page"), F.when(t % 3 == 0, "embedded-text").otherwise(F.concat(F.lit("ocr:e"), t % 2)).alias("method"), F.when(t % 3 != 0, F.concat(F.lit("e"), t % 2)).alias("engine"))
    return pages.page_summary(rows)


@query("SELECT conv_id AS doc_id, sha256(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, text)) AS text_sha256 FROM conversations GROUP BY 1")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    rows = m.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return pages.document_text(rows).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT p_partkey AS case_id, round(levenshtein(p_name, p_brand || ' ' || p_type) / length(p_brand || ' ' || p_type), 6) AS cer, p_name = p_brand || ' ' || p_type AS exact_match FROM part""")
def text_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F53, J13 (ASCII, where both count alike; F54 is a unit test)."""
    p = m.table(spark, sf_dir, "part")
    pairs = p.select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("actual"), F.concat_ws(" ", "p_brand", "p_type").alias("expected"))
    return quality.error_rates(pairs).select("case_id", F.round("cer", 6).alias("cer"), "exact_match")


def _edits_sql(a: str, b: str) -> str:
    """Edits between two lists: what both have is a character of its own, all else of a list is one; DuckDB counts bytes, so all are ASCII."""
    common = f"list_intersect(list_distinct({a}), {b})"
    coded = lambda of, other: f"array_to_string(list_transform({of}, lambda w: chr(coalesce(2 + nullif(list_position({common}, w), 0), {other})::INT)), '')"
    return f"levenshtein({coded(a, 1)}, {coded(b, 2)})"


_STRIP_SQL = r"regexp_replace(%s, '^[\s\xA0]+|[\s\xA0]+$', '', 'g')"


@query(rf"""WITH p AS (SELECT a.role, a.text AS actual, b.text AS expected FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
l AS (SELECT *, list_filter(string_split_regex(actual, '\s+'), lambda w: w <> '') AS wa, list_filter(string_split_regex(expected, '\s+'), lambda w: w <> '') AS wb, string_split(actual, '') AS ca, string_split(expected, '') AS cb FROM p),
e AS (SELECT role, {_edits_sql("ca", "cb")} AS ce, length(expected) AS cn, {_edits_sql("wa", "wb")} AS we, len(wb) AS wn, {_STRIP_SQL % "actual"} = {_STRIP_SQL % "expected"} AS same FROM l),
r AS (SELECT *, CASE WHEN cn = 0 THEN CASE WHEN ce = 0 THEN 0.0 ELSE 1.0 END ELSE ce / cn END AS cer, CASE WHEN wn = 0 THEN CASE WHEN we = 0 THEN 0.0 ELSE 1.0 END ELSE we / wn END AS wer FROM e)
SELECT role, count(*) AS cases, round(avg(cer), 6) AS mean_cer, round(avg(wer), 6) AS mean_wer, round(sum(ce) / nullif(sum(cn), 0), 6) AS pooled_cer, round(sum(we) / nullif(sum(wn), 0), 6) AS pooled_wer,
  round(avg(CAST(same AS DOUBLE)), 6) AS exact_share FROM r GROUP BY role""")
def word_error_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word error rates of assistant turns against the turn before, by role."""
    c = m.table(spark, sf_dir, "conversations")
    left = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected"))
    pairs = c.join(left, ["conv_id", "turn"]).select(F.concat_ws(":", "conv_id", "turn").alias("case_id"), F.col("text").alias("actual"), "expected", "role")
    rates = quality.corpus_rates(quality.error_rates(pairs, carry=["role"]), "role")
    return rates.select("role", "cases", *[F.round(c, 6).alias(c) for c in rates.columns[2:]])
