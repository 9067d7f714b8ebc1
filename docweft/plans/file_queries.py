"""Registered queries of sources, sinks, streams and the remaining columns: what they write comes from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import extract as ex
from docweft.functions import text as tx
from docweft.operators import hooks, layout, lifecycle, publish, search
from docweft.plans import model as m
from docweft.plans.queries import TS_NOW, now, query
from docweft.sources import io
from docweft.streaming import streams


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{io.shared_dir(spark)}/docweft/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS id, l_linenumber AS n, l_quantity AS quantity FROM lineitem WHERE l_quantity > 45""")
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1."""
    rows = io.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_orderkey", "l_linenumber", "l_quantity"], F.col("l_quantity") > 45)
    return rows.toDF("id", "n", "quantity")


@query("""SELECT CAST(s_nationkey AS INT) AS folder, sum(length(s_name) + 1)::BIGINT AS size, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256, 'unknown' AS format FROM supplier GROUP BY s_nationkey""")
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file for each nation, listed with size, digest and format."""
    path = _fresh(spark, "inventory")
    s = m.table(spark, sf_dir, "supplier").repartition("s_nationkey").sortWithinPartitions("s_nationkey", "s_suppkey")
    s.select(F.col("s_nationkey").alias("folder"), F.col("s_name").alias("value")).write.partitionBy("folder").text(path)
    files = io.file_inventory(io.read_files(spark, path, "*.txt"))
    return files.select(F.regexp_extract("path", r"folder=(\d+)", 1).cast("int").alias("folder"), "size", "sha256", "format")


@query("""SELECT 'c' || c_custkey AS case_id, c_mktsegment AS source, c_name AS expected_text FROM customer""")
def json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Json lines between blank lines and comments."""
    path, c = _fresh(spark, "cases"), m.table(spark, sf_dir, "customer")
    line = F.to_json(F.struct(F.concat(F.lit("c"), "c_custkey").alias("case_id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("expected_text")))
    c.select(F.explode(F.array(line, F.lit("  "), F.concat(F.lit(" # "), "c_name"))).alias("value")).write.text(path)
    return io.read_cases(spark, path).select("case_id", "source", "expected_text")


@query("""SELECT CAST(ts AS DATE) AS day, event_type AS status, count(*) AS n FROM events GROUP BY ALL""")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log that is partitioned by day."""
    path, e = _fresh(spark, "log"), m.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("created_at"))
    for part in (0, 1):
        io.append_events(e.where(F.col("event_id") % 2 == part), path)
    return spark.read.parquet(path).groupBy("day", F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'nation' AS kind, r_name AS key, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey""")
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pack for each region."""
    path = _fresh(spark, "packs")
    rows = m.table(spark, sf_dir, "nation").join(m.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    packs = rows.groupBy("r_name").agg(F.collect_list("n_name").alias("terms")).repartition("r_name")
    packs.select(F.create_map("r_name", "terms").alias("nation"), F.col("r_name").alias("pack")).write.partitionBy("pack").json(path)
    return io.read_vocabulary(spark, f"{path}/*/*.json").select("kind", "key", "term")


@query("""SELECT 's' || s_suppkey AS profile_type, 'name' AS field_key, s_name AS value FROM supplier UNION ALL SELECT 's' || s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier""")
def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of profiles as long rows."""
    path, s = _fresh(spark, "profiles"), m.table(spark, sf_dir, "supplier")
    fields = F.create_map(F.lit("name"), "s_name", F.lit("nation"), F.col("s_nationkey").cast("string"))
    whole = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), "s_suppkey"), fields))))
    s.groupBy("s_nationkey").agg(whole.alias("value")).repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)  # a nation's profiles are one file
    return io.read_profiles(spark, f"{path}/*/*.txt").select("profile_type", "field_key", "value")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status FROM orders""")
def exported_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as json and read again."""
    path = _fresh(spark, "preview")
    io.write_json(m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")), path)
    return spark.read.schema("id long, status string").json(path)


# --- recovery and links --------------------------------------------------------------------------------------------

_STUCK = f"""{m.LIFECYCLE_SQL}, {m.INTAKE_SQL}, o AS (SELECT * FROM i WHERE status IN ('Received', 'Stored', 'Processing Failed', 'Storage Failed', 'Storage Partial') AND received_at < {TS_NOW} - INTERVAL 20 MINUTE),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id DESC) AS r FROM ld WHERE source_id IS NOT NULL) WHERE r = 1),
j AS (SELECT o.id AS intake_id, o.status, coalesce(nullif(o.nested_storage_status, ''), o.storage_status, '') AS st, coalesce(k.processing_status, '') AS p, coalesce(k.publication_status, '') AS pub, coalesce(k.approved, false) AS ok, coalesce(k.delivery_status, '') AS del FROM o LEFT JOIN k ON k.source_id = o.id),
s AS (SELECT intake_id, status, CASE WHEN p = 'Processing Failed' THEN 'RECOVERY_REQUIRED/processing' WHEN st = 'Failed' THEN 'RECOVERY_REQUIRED/storage' WHEN pub = 'Published' AND ok AND del = 'Delivered' THEN 'DELIVERED/none'
  WHEN pub = 'Published' AND ok THEN 'DELIVERY_PENDING/delivery' WHEN pub = 'Unpublished' AND p = 'Completed' THEN 'PUBLICATION_PENDING/publication' WHEN p = 'Completed' THEN 'PROCESSED/publication'
  WHEN st IN ('AVAILABLE', 'Stored') THEN 'STORED/processing' ELSE 'INTAKE_RECEIVED/storage' END AS x FROM j)"""


@query(f"""WITH {_STUCK} SELECT intake_id, status, string_split(x, '/')[1] AS state, string_split(x, '/')[2] AS next_action, string_split(x, '/')[2] <> 'none' AS recoverable FROM s""")
def stuck_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake rows that wait too long, with or without a document."""
    return lifecycle.stuck_intake(m.intake(spark, sf_dir), m.lifecycle_documents(spark, sf_dir), now()).select("intake_id", "status", "state", "next_action", "recoverable")


@query(f"""WITH {_STUCK} SELECT string_split(x, '/')[1] AS state, count(*) AS n, count(*) FILTER (string_split(x, '/')[2] <> 'none') AS recoverable FROM s GROUP BY 1""")
def recovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15."""
    return lifecycle.recovery_counts(lifecycle.stuck_intake(m.intake(spark, sf_dir), m.lifecycle_documents(spark, sf_dir), now()))


@query(f"""WITH {m.LIFECYCLE_SQL}, {m.INTAKE_SQL}, a AS (SELECT CAST(document_id AS VARCHAR) AS key, min(id) AS x FROM i WHERE document_id IS NOT NULL GROUP BY 1),
c AS (SELECT CAST(event_id * 5 % 15000 AS VARCHAR) AS key, min(CAST(event_id AS VARCHAR)) AS x FROM events GROUP BY 1), u AS (SELECT id AS key, min(id) AS x FROM i GROUP BY 1)
SELECT ld.id, coalesce(a.x, u.x, c.x) AS intake_id, CASE WHEN a.x IS NOT NULL THEN 'document_id' WHEN u.x IS NOT NULL THEN 'intake_id' WHEN c.x IS NOT NULL THEN 'metadata' END AS link_kind
FROM ld LEFT JOIN a ON a.key = CAST(ld.id AS VARCHAR) LEFT JOIN u ON u.key = ld.source_id LEFT JOIN c ON c.key = CAST(ld.id AS VARCHAR) AND ld.source_id IS NOT NULL WHERE extraction_method = 'legacy'""")
def legacy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5."""
    meta = F.to_json(F.struct((F.col("id").cast("long") * 5 % 15000).alias("document_id")))
    return lifecycle.relink_legacy(m.lifecycle_documents(spark, sf_dir), m.intake(spark, sf_dir).withColumn("metadata", meta), "legacy")


# --- columns -------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey AS id, regexp_replace(p_name, '\b(almond|azure)\b', 'tone', 'g') AS name FROM part""")
def ocr_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return m.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tx.word_aliases(F.col("p_name"), {"almond": "tone", "azure": "tone"}).alias("name"))


@query("""SELECT o_orderkey AS id, 'due ' || strftime(o_orderdate, '%d/%m/%Y') || ' or 5' || strftime(o_orderdate, '%d.%m.%Y') AS text, true AS valid, o_orderkey % 2 = 0 AS invalid, o_orderpriority AS field FROM orders""")
def unified_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F21, F35."""
    o = m.table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("due "), F.date_format("o_orderdate", "dd . MM - yyyy"), F.lit(" or 5"), F.date_format("o_orderdate", "dd.MM.yyyy"))
    text = tx.date_separators(raw)
    signals = ex.date_signals(ex.date_candidates(F.concat(text, F.when(F.col("o_orderkey") % 2 == 0, " 31/02/2026").otherwise(""))))
    field = ex.clean_field(F.concat(F.lit(" : "), "o_orderpriority", F.lit(" .-")))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"), signals["has_valid_date"].alias("valid"), signals["has_invalid_date"].alias("invalid"), field.alias("field"))


@query(r"""SELECT s_suppkey AS id, 'विषय: ' || s_name || chr(10) || 'paid 01/02/2026, total' AS text, lower(s_name || ' ' || s_suppkey) AS searchable FROM supplier""")
def fully_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, F49."""
    raw = F.concat(F.lit(" विषयक "), "s_name", F.lit("\r\npaid 01 . 02-2026 ,;,  totall "))
    s = m.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), tx.normalise(raw, words={"totall": "total"}).alias("text"), publish.searchable([F.col("s_name"), F.lit(""), F.col("s_suppkey").cast("string")]).alias("searchable"))


# --- layout: regions of a page are apart by more than a line, so that each is a line of its own ---------------------


@query(f"""WITH {m.REGIONS_SQL} SELECT doc_id, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY y1 + y2, x1, id) - 1 AS INT) AS line, text FROM r""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, W6."""
    r = m.regions(spark, sf_dir)
    return layout.line_texts(r, layout.lines(r))


@query(f"""WITH {m.REGIONS_SQL} SELECT doc_id, page, count(*) AS region_count, count(*) AS line_count FROM r GROUP BY ALL""")
def layout_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, W9."""
    return layout.page_summaries(m.regions(spark, sf_dir)).select("doc_id", "page", "region_count", "line_count")


# --- streams -------------------------------------------------------------------------------------------------------


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, each twice, as a stream of a few files at a time."""
    path, e = _fresh(spark, "stream"), m.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    e.unionByName(e).repartition(6, "event_id").write.parquet(path)
    return streams.read_bounded(spark, path, e.schema, files_per_trigger=2)


@query("""SELECT event_id, user_id FROM events""")
def stream_new_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, whatever the lateness, batch by batch."""
    path = _fresh(spark, "seen")
    spark.createDataFrame([], "event_id long, user_id long").write.parquet(path)

    def each(batch: DataFrame, number: int) -> None:
        rows = streams.new_keys_only(batch, spark.read.schema("event_id long, user_id long, batch int").parquet(path).where(F.coalesce("batch", F.lit(-1)) != number), ["event_id"])
        rows.select("event_id", "user_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    streams.run_available(_stream(spark, sf_dir), _fresh(spark, "check"), each)
    return spark.read.schema("event_id long, user_id long").parquet(f"{path}/batch=*")


@query("""SELECT min(event_id) AS first_item, max(event_id) AS last_item, 2 * count(*) AS items FROM events""")
def stream_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each batch, united; a second run has nothing left to do."""
    path, check, s = _fresh(spark, "sections"), _fresh(spark, "check"), _stream(spark, sf_dir)
    for _ in range(2):
        streams.run_available(s, check, lambda batch, n: streams.batch_bounds(batch, "event_id").write.mode("overwrite").parquet(f"{path}/batch={n}"))
    rows = spark.read.parquet(path)
    return rows.agg(F.min("first_item").alias("first_item"), F.max("last_item").alias("last_item"), F.sum("items").alias("items"))


@query(f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS "at" FROM events GROUP BY 1)
SELECT user_id, status FROM l WHERE date_diff('second', "at", {TS_NOW}) > 60 * CASE status WHEN 'signup' THEN 10 WHEN 'view' THEN 20 END""")
def stream_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchdog over the stream's last state."""
    path = _fresh(spark, "latest")
    state = streams.latest_status(_stream(spark, sf_dir), "user_id", "ts", "event_type", "event_id")
    streams.run_available(state, _fresh(spark, "check"), lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"), mode="complete")
    last = spark.read.parquet(path)
    newest = last.agg(F.max("batch").alias("batch"))
    latest = last.join(F.broadcast(newest), "batch").select("user_id", F.col("at").alias("ts"), F.col("status").alias("event_type"), F.lit(0).alias("event_id"))
    return streams.stalled(latest, "user_id", "ts", "event_type", "event_id", {"signup": 10, "view": 20}, now()).select("user_id", "status")


@query("""SELECT DISTINCT user_id AS document_id, 'c' || (event_id % 4) AS chat_id, 1 AS attempts FROM events""")
def stream_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: claims of a stream of requests: one holder each, however often it is asked for within the lease."""
    path = _fresh(spark, "claims")
    asked = _stream(spark, sf_dir).select(F.col("user_id").alias("document_id"), F.concat(F.lit("c"), F.col("event_id") % 4).alias("chat_id"))
    streams.run_available(asked, _fresh(spark, "check"), streams.claim_writer(spark, path, now()))
    return streams.claims(spark, path).select("document_id", "chat_id", "attempts")


@query(f"""WITH {m.LIFECYCLE_SQL}, {m.AUDITS_SQL}, ok AS (SELECT DISTINCT document_id, chat_id FROM a WHERE coalesce(result, 'Sent') = 'Sent')
SELECT id AS document_id, c AS chat_id FROM ld, (SELECT unnest(['c0', 'c1', 'c2', 'c3']) AS c) WHERE publication_status = 'Published' AND coalesce(approved, false)
  AND NOT EXISTS (SELECT 1 FROM ok WHERE ok.document_id = id AND ok.chat_id = c)""")
def stream_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation run twice; chats of audits are inside their json."""
    path = _fresh(spark, "queue")
    a = m.audits(spark, sf_dir)
    spark.createDataFrame([], "document_id long, chat_id string").write.parquet(path)
    published = m.lifecycle_documents(spark, sf_dir).where(lifecycle.published_and_approved())
    by_json = a.select("document_id", "operation", "result", F.to_json(F.struct("chat_id")).alias("details"))
    for _ in range(2):
        out = streams.reconciled(published, a.select("chat_id").distinct(), by_json, "delivery", path)
    return out


# --- hooks ---------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id AS id, length(coalesce(text, '')) AS n, 'plain' AS engine FROM documents""")
def recognised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser of plain text, run once for each distinct content."""

    def engine(batches):
        for b in batches:
            text = [bytes(x).decode("utf-8", "replace") for x in b["content"]]
            yield b[["key"]].assign(text=text, engine="plain", confidence=1.0, regions=[[] for _ in text])

    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(content, 256).alias("sha256"), content.alias("content"))
    return hooks.recognise(files, engine).select("id", F.length("text").alias("n"), "engine")


@query("""SELECT p_partkey AS id, 1.0::DOUBLE AS score FROM part WHERE contains(p_name, 'a') AND contains(lower(p_type), 'steel') AND contains(lower(p_type), 'small') ORDER BY CAST(p_partkey AS VARCHAR) LIMIT 20""")
def search_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default search behind the interface (the limit is the operator)."""
    p = m.table(spark, sf_dir, "part").where(F.col("p_name").contains("a"))
    rows = p.select(F.col("p_partkey").alias("id"), publish.searchable([F.col("p_type")]).alias("search_text"))
    return search.SearchBackend().search(rows, "steel small").where("score = 1").select("id", "score")
