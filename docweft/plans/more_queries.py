"""Further registered queries: single columns and small operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import extract as ex
from docweft.functions import files, messages
from docweft.functions import text as tx
from docweft.operators import checks, compare, deliver, layout, lifecycle, pages, publish, search, vocab
from docweft.plans import model as m
from docweft.plans.queries import TS_NOW, now, query

# --- letters: parts written as short letters, whose fields are known -----------------------------------------------

_LETTER = r"""l AS (SELECT p_partkey AS id, (1 + p_partkey % 28) || '.' || (1 + p_partkey % 12) || '.' || (2001 + p_partkey % 20) AS day, p_name, p_brand, p_type, p_partkey % 3 AS k FROM part)"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, key = m.parts(spark, sf_dir), F.col("p_partkey")
    day = F.concat_ws(".", 1 + key % 28, 1 + key % 12, 2001 + key % 20)
    text = F.concat(
        F.lit("From: Office of "), "p_brand", F.lit("\r\nMemo no : P/"), key, F.when(key % 3 == 0, F.concat(F.lit("  Date: "), day)).otherwise(F.concat(F.lit("\nDate - "), day)),
        F.lit("\n\nSubject: "), F.when(key % 3 == 1, F.lit("\n")).otherwise(F.lit("")), "p_name", F.lit(" for "), "p_type", F.lit("\nReference is made\tto it.  \nhttp://site.org/a/long/path\n"),
        F.when(key % 3 == 2, F.concat(F.lit("Last date: "), day, F.lit(" urgent\n"))).otherwise(F.lit("")), F.when(key % 3 == 0, "exam result").otherwise("training"),
    )
    return p.select(key.alias("id"), text.alias("text"))


@query(f"""WITH {_LETTER} SELECT id, 'P/' || id AS reference, day AS printed, 'Office of ' || p_brand AS authority, p_name || ' for ' || p_type AS subject,
  CASE WHEN k = 2 THEN day ELSE day END AS deadline, CASE WHEN k = 2 THEN 'label' ELSE 'fallback' END AS deadline_source, CASE WHEN k = 2 THEN 'HIGH' ELSE 'NORMAL' END AS priority,
  CASE WHEN k = 0 THEN 'Examination' ELSE 'Other' END AS category, 'HIGH' AS confidence FROM l""")
def letter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule extraction."""
    lines = tx.text_lines(F.col("text"), strip_signs=True)
    d = _letters(spark, sf_dir).withColumn("lines", lines)
    # "Date - d" is the form without colon; the deadline rule takes colons, dots and dashes alike
    due = ex.deadline(F.col("text"))
    out = d.select(
        "id", ex.reference_number(F.col("lines")).alias("reference"), ex.printed_date(F.col("lines"), F.col("text")).alias("printed"),
        ex.rule_authority(F.col("lines"), F.col("text")).alias("authority"), ex.rule_subject(F.col("lines")).alias("subject"),
        due["value"].alias("deadline"), due["source"].alias("deadline_source"), ex.priority(F.col("text")).alias("priority"), ex.category(F.col("text")).alias("category"),
    )
    return out.withColumn("confidence", ex.filled_confidence([F.col(c) for c in ("reference", "printed", "authority", "subject")]))


@query(f"""WITH {_LETTER} SELECT id, p_name || ' for ' || p_type || ' Reference is made to it. http://site.org/a/long/path ' || CASE WHEN k = 2 THEN 'Last date: ' || day || ' urgent' WHEN k = 0 THEN 'exam result' ELSE 'training' END
  || CASE WHEN k = 2 THEN ' training' ELSE '' END AS subject, 'subject_label' AS subject_source, 'HIGH' AS subject_confidence, 'LOW' AS authority_confidence,
  CASE WHEN k = 0 THEN 'examination' ELSE 'training' END AS document_type, CASE WHEN k = 0 THEN 'HIGH' ELSE 'MEDIUM' END AS type_confidence, day AS deadlines FROM l""")
def document_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12, F22, F24, F28, F36, A9, L5."""
    d = _letters(spark, sf_dir).select("id", ex.document_intelligence(F.col("text")).alias("i"))
    return d.select(
        "id", F.col("i.subject.value").alias("subject"), F.col("i.subject.source").alias("subject_source"), F.col("i.subject.confidence").alias("subject_confidence"),
        F.col("i.authority.confidence").alias("authority_confidence"), F.col("i.document_type.value").alias("document_type"),
        F.col("i.document_type.confidence").alias("type_confidence"), F.array_join("i.deadlines", ",").alias("deadlines"),
    )


@query(f"""WITH {_LETTER} SELECT id, 'From: Office of ' || p_brand || ' ' || CASE WHEN k = 0 THEN 'Memo no : P/' || id || ' Date: ' || day WHEN length('Memo no : P/' || id) >= 15 THEN 'Memo no : P/' || id
  WHEN length('Date - ' || day) >= 15 THEN 'Date - ' || day WHEN k = 1 THEN p_name || ' for ' || p_type ELSE 'Subject: ' || p_name || ' for ' || p_type END AS description FROM l""")
def short_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F34."""
    return _letters(spark, sf_dir).select("id", ex.short_description(tx.text_lines(F.col("text"))).alias("description"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'BSEB' WHEN 1 THEN 'District Education Office' WHEN 2 THEN 'District Magistrate' ELSE p_brand END AS name FROM part""")
def authority_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26."""
    p, k = m.table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    raw = F.when(k == 0, "the bseb ").when(k == 1, "District  education officer").when(k == 2, "office of the DISTRICT MAGISTRATE").otherwise(F.concat(F.lit(" "), "p_brand"))
    return p.select(F.col("p_partkey").alias("id"), ex.authority_name(raw).alias("name"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'rule' END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'intelligence' WHEN o_orderkey % 3 = 1 THEN 'rule' END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'first' WHEN '2' THEN 'second' ELSE 'other' END AS key FROM orders""")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32, F33."""
    o, k = m.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    merged = ex.merged_field(F.when(k == 0, F.col("o_orderpriority")), F.lit("HIGH"), F.when(k < 2, "rule").otherwise(""))
    key = ex.taxonomy_key(F.left("o_orderpriority", F.lit(1)), {"1": "first", "2": "second"})
    return o.select(F.col("o_orderkey").alias("id"), merged.alias("m"), key.alias("key")).select("id", "m.*", "key")


# --- files, names, messages, json ----------------------------------------------------------------------------------


@query("""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'png' WHEN 3 THEN 'webp' WHEN 4 THEN 'unknown' ELSE 'office' END AS format,
  CASE WHEN s_suppkey % 6 = 4 THEN 'n.pdf' ELSE 'n.pdf' END AS output_name, s_suppkey % 6 NOT IN (0, 4) AS converted FROM supplier""")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, F61."""
    s, k = m.table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 6
    head = F.when(k == 0, "255044462D312E34").when(k == 1, "FFD8FFE0").when(k == 2, "89504E470D0A1A0A").when(k == 3, "524946460000000057454250").otherwise("74657874")
    name = F.when(k == 5, "n.docx").otherwise("n.pdf")
    return s.select(F.col("s_suppkey").alias("id"), files.delivered_as(F.unhex(head), name).alias("f")).select("id", "f.*")


@query("""SELECT o_orderkey AS id, 'in/' || strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderkey || '/' || o_orderpriority AS key, strftime(o_orderdate, '%d-%m-%Y') AS shown, sha256(o_orderpriority) AS digest FROM orders""")
def object_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F38, F39, F40."""
    o = m.table(spark, sf_dir, "orders")
    key = files.object_key(F.lit("in"), F.col("o_orderdate"), F.col("o_orderkey"), F.concat(F.lit(" "), "o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), key.alias("key"), messages.display_date(F.col("o_orderdate")).alias("shown"), files.digest(F.col("o_orderpriority")).alias("digest"))


_TAG_WORDS = r"list_filter(regexp_extract_all(lower(p_name), '[\p{L}\p{M}\p{N}]+'), lambda w: length(w) >= 4)"


@query(rf"""WITH t AS (SELECT p_partkey AS id, (CASE WHEN p_size < 20 THEN ['small', 'item'] ELSE [] END) || {_TAG_WORDS} AS ws FROM part),
u AS (SELECT id, w, min(i) AS i FROM (SELECT id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM t) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS k FROM u)
SELECT t.id, coalesce(string_agg(w, ',' ORDER BY i) FILTER (k <= 8), '') AS tags FROM t LEFT JOIN r ON r.id = t.id GROUP BY t.id""")
def search_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F41, A12, L5."""
    p = m.table(spark, sf_dir, "part")
    tags = messages.search_tags(F.when(F.col("p_size") < 20, "s"), F.col("p_name"), {"s": ["small", "item"]})
    return p.select(F.col("p_partkey").alias("id"), F.array_join(tags, ",").alias("tags"))


@query("""SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'Received' WHEN 'view' THEN 'Stored' END AS text,
  CASE WHEN event_type NOT IN ('signup', 'view') THEN 'unknown status: ' || event_type END AS error, upper(left(event_type, 1)) || substr(event_type, 2) || ' Stage' AS title FROM events""")
def stage_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F42, F46."""
    e = m.table(spark, sf_dir, "events")
    t = messages.stage_text(F.col("event_type"), {"signup": "Received", "view": "Stored"})
    return e.select(F.col("event_id").alias("id"), t.alias("t"), messages.title(F.concat("event_type", F.lit("_stage"))).alias("title")).select("id", "t.*", "title")


@query("""SELECT event_id AS id, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE json_extract_string(props, '$.k') END AS merged, event_type AS source, event_id % 2 = 0 AS has_page FROM events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F43, F44, F57."""
    e, even = m.table(spark, sf_dir, "events"), F.col("event_id") % 2 == 0
    base = F.from_json("props", "map<string,string>")
    merged = messages.merged_map(base, F.when(even, F.create_map(F.lit("k"), F.lit("new"))), ["gone"])
    where = messages.evidence(F.col("event_type"), F.when(even, 1), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return e.select(F.col("event_id").alias("id"), messages.json_first(F.col("props"), ["$.none", "$.k"]).alias("k"), merged["k"].alias("merged"), where["source"].alias("source"), F.map_contains_key(where, "page").alias("has_page"))


@query(r"""SELECT c_custkey AS id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(c_name || ' ' || c_mktsegment || ' ' || c_mktsegment), '[\p{L}\p{M}\p{N}_]+'))), ' ') AS tokens FROM customer""")
def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F50."""
    c = m.table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.array_join(search.token_vector(F.concat_ws(" ", "c_name", "c_mktsegment", "c_mktsegment")), " ").alias("tokens"))


@query("""SELECT p_partkey AS id, 'a b' || chr(10) || chr(10) || 'c ' || p_partkey AS cleaned, CASE WHEN p_partkey % 2 = 0 THEN 'embedded-text' ELSE 'recognise' END AS route FROM part""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2, P15."""
    p, key = m.table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.concat(F.lit(" a \t b​\r\n\n\n\nc\x00 "), key, F.lit("\n"))
    cleaned = tx.clean_control(tx.clean_recognised(raw))
    page = F.when(key % 2 == 0, F.repeat(F.lit("x y "), 40)).otherwise(F.repeat(F.lit("x  "), 79))
    return p.select(key.alias("id"), cleaned.alias("cleaned"), layout.page_route(page).alias("route"))


# --- small operators -----------------------------------------------------------------------------------------------


@query(f"""WITH {m.LIFECYCLE_SQL} SELECT id, source_app FROM ld WHERE approved AND NOT (id % 5 = 0) AND NOT (id % 7 = 0)""")
def public_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1, P3."""
    d = m.lifecycle_documents(spark, sf_dir).withColumns({"sensitive": F.col("id") % 5 == 0, "duplicate": F.col("id") % 7 == 0})
    return publish.visible(d, "anon").select("id", "source_app")


@query("""SELECT event_id AS id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) OR event_id % 7 IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 2)""")
def allowed_senders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    e = m.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", (F.col("event_id") % 7).alias("chat_id"))
    users = m.table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("user_id"))
    chats = m.table(spark, sf_dir, "supplier").where("s_suppkey < 2").select(F.col("s_suppkey").alias("chat_id"))
    return publish.allowed_senders(e, users, chats).select("id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'd' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'p' || (o_orderkey % 4) END AS file FROM orders""")
def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    o, key = m.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    photos = F.when(key % 3 == 1, F.transform(F.sequence(F.lit(0), key % 4), lambda i: F.concat(F.lit("p"), i))).otherwise(F.array().cast("array<string>"))
    return o.select(key.alias("id"), publish.chosen_attachment(F.when(key % 3 == 0, F.concat(F.lit("d"), key)), photos).alias("file"))


@query("""SELECT o_orderkey AS id, o_orderdate AS "at", row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS serial FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20""")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 20, numbered (the limit is the operator)."""
    o = m.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return publish.numbered(publish.oldest_first(o, 20, at="at", key="id"), F.col("at"), F.col("id")).withColumn("serial", F.col("serial").cast("long"))


@query(f"""WITH {m.LIFECYCLE_SQL} SELECT id, updated_at, received_at FROM ld ORDER BY updated_at DESC NULLS LAST, received_at DESC NULLS LAST, id LIMIT 50""")
def newest_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3 (the limit is the operator)."""
    d = m.lifecycle_documents(spark, sf_dir).select("id", "updated_at", "received_at")
    return publish.newest(d, 50, by=[F.col("updated_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.col("id")])


@query(f"""WITH {m.INTAKE_SQL} SELECT 'recent' AS kind, count(*) AS n FROM i WHERE received_at >= {TS_NOW} - INTERVAL 24 HOUR UNION ALL
SELECT 'claimable', count(*) FROM i WHERE status IN ('Stored', 'Processing Failed') UNION ALL SELECT 'verified', count(*) FROM i WHERE bucket IS NOT NULL AND nested_storage_status = 'AVAILABLE'""")
def intake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A13, P8, P20."""
    i = m.intake(spark, sf_dir)
    parts = [("recent", i.where(lifecycle.within(F.col("received_at"), now(), 24))), ("claimable", lifecycle.claimable(i)), ("verified", i.where(lifecycle.stored_and_verified(F.col("bucket"), F.col("nested_storage_status"))))]
    out = None
    for name, rows in parts:
        n = lifecycle.recent_count(rows, "received_at", now(), 24 * 365).select(F.lit(name).alias("kind"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("""SELECT e.event_id AS id, CASE WHEN conv_id % 2 = 0 THEN 'chat' || conv_id ELSE 'home' END AS chat_id, conv_id AS progress_message_id FROM events e JOIN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 > 0) c ON c.conv_id = e.user_id""")
def progress_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16."""
    e = m.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("document_id"))
    c = m.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    i = c.select(F.col("conv_id").alias("document_id"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("chat"), "conv_id")).alias("chat_id"), F.when(F.col("conv_id") % 3 > 0, F.col("conv_id")).alias("progress_message_id"))
    return deliver.progress_rows(e, i, "home").select("id", "chat_id", "progress_message_id")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN sha256(p_name) END AS expected, CASE WHEN p_partkey % 7 = 0 THEN sha256('x') ELSE sha256(p_name) END AS actual, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 7 <> 0 END AS ok FROM part""")
def verify_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J19."""
    p, key = m.table(spark, sf_dir, "part"), F.col("p_partkey")
    d = F.sha2("p_name", 256)
    expected = compare.first_digest(F.when(key % 2 == 0, "broken"), F.when(key % 5 != 0, F.upper(d)))
    return compare.verify_checksum(p.select(key.alias("id"), expected.alias("expected")), p.select(key.alias("id"), F.when(key % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(d).alias("actual")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS value, CASE WHEN o_orderkey % 2 = 0 THEN 'top' ELSE 'low' END AS source FROM orders""")
def preferred_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F47."""
    o, key = m.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    two = F.array(F.struct(F.lit("low").alias("source"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("top").alias("source"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("value")))
    rows = o.select(key.alias("id"), F.explode(two).alias("v")).select("id", "v.*")
    return compare.preferred_value(rows, ["id"], ["top", "low"])


@query("""SELECT n_name AS category_key, n_nationkey % 2 + n_nationkey % 3 AS open_versions FROM nation WHERE n_nationkey % 2 + n_nationkey % 3 <> 1""")
def open_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W11."""
    n, key = m.table(spark, sf_dir, "nation"), F.col("n_nationkey")
    rows = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).where((F.col("i") >= 3) | (F.col("i") < key % 2 + key % 3))
    return vocab.open_version_violations(rows.select(F.col("n_name").alias("category_key"), F.when(F.col("i") >= 3, 1).alias("valid_to")))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, concat_ws(',', CASE WHEN l_tax >= 0.055 THEN 'dark-ink-evidence' END, CASE WHEN l_discount >= 0.012 THEN 'colored-ink-evidence' END, CASE WHEN l_discount >= 0.035 THEN 'high-local-contrast-evidence' END) AS signals,
  (l_tax >= 0.055)::INT + (l_discount >= 0.012)::INT + (l_discount >= 0.035)::INT >= 2 AS review, CASE WHEN l_quantity / 40 < 0.35 AND l_linenumber % 2 = 0 THEN 'better' WHEN l_linenumber % 2 = 0 THEN 'plain' ELSE 'own' END AS engine,
  CASE WHEN l_quantity / 40 > 1 THEN 'quality out of range' END AS error FROM lineitem""")
def page_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16, P17."""
    li, q = m.table(spark, sf_dir, "lineitem"), F.col("l_quantity") / 40
    mark = layout.visual_marks(F.col("l_tax"), F.col("l_discount"), F.col("l_discount"))
    engine = layout.engine_choice(F.when(F.col("l_linenumber") % 2 == 0, "plain").otherwise("own"), q, default="plain", better="better")
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), mark.alias("m"), engine.alias("e")).select("id", "n", "m.*", "e.engine", "e.error")


@query(f"""WITH {m.REGIONS_SQL} SELECT doc_id, page, count(*) AS region_count, count(*) FILTER (id % 3 = 0) AS headings, bool_or(id % 3 = 1) AS has_body FROM r GROUP BY 1, 2""")
def structure_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, F56."""
    text = F.when(F.col("id") % 3 == 0, F.concat(F.col("id"), F.lit(") "), "text")).when(F.col("id") % 3 == 1, F.col("text")).otherwise(" ")
    return pages.structure_evidence(m.regions(spark, sf_dir).withColumn("text", text))


@query(f"""WITH {m.REGIONS_SQL} SELECT doc_id, CAST(id AS VARCHAR) AS id, x1, y1, CASE WHEN id % 4 = 0 THEN x1 - 1 ELSE x2 END AS x2, y2, id % 4 <> 0 AS valid FROM r""")
def valid_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F55."""
    r = m.regions(spark, sf_dir)
    x2 = F.when(F.col("id") % 4 == 0, F.col("x1") - 1).otherwise(F.col("x2"))
    raw = r.select("doc_id", F.col("id").cast("string").alias("id"), F.array(F.col("x1") + 0.2, F.col("y1") - 0.2, x2 + 0.0, F.col("y2") + 0.4).alias("bbox"), "text", F.lit(1).alias("position"))
    return layout.normalise_regions(raw).select("doc_id", "id", "x1", "y1", "x2", "y2", "valid")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'enum:priority' WHEN 2 THEN 'required:category' ELSE 'additional:more' END AS violations FROM events""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results built from events against the closed contract."""
    e, k = m.dealt(m.table(spark, sf_dir, "events").select("event_id")), F.col("event_id") % 4
    doc = F.concat(
        F.lit('{"required_action":"r","confidence":"LOW","needs_manual_review":false,"source_page":'), 1 + F.col("event_id") % 9, F.lit(',"priority":'),
        F.when(k == 1, '"SOON"').otherwise('"HIGH"'), F.when(k == 2, "").otherwise(',"category":"c"'), F.when(k == 3, ',"more":1').otherwise(""), F.lit("}"),
    )
    return e.select(F.col("event_id").alias("id"), F.array_join(checks.contract_violations(doc), ",").alias("violations"))
