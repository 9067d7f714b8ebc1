"""Registered queries of the remaining extraction rules and lifecycle operators over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweft.functions import extract as ex
from docweft.functions import text as tx
from docweft.functions import variants
from docweft.operators import lifecycle, publish, search_index, vocab
from docweft.plans import model as m
from docweft.plans.queries import _FOLDED, TS_NOW, now, query

DIGITS = "०१२३४५६७८९"

# --- dates in native digits ------------------------------------------------------------------------------------------


def _native(c: Column) -> Column:
    return F.translate(c, "0123456789", DIGITS)


_NATIVE = f"translate(%s, '0123456789', '{DIGITS}')"


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderkey % 3 = 0 AS bad, strftime(o_orderdate, '%d') AS dd, strftime(o_orderdate, '%m') AS mm, strftime(o_orderdate, '%Y') AS yy FROM orders),
x AS (SELECT id, bad, d, CASE WHEN bad THEN '31' ELSE dd END AS dd, CASE WHEN bad THEN '02' ELSE mm END AS mm, yy FROM o)
SELECT id, 'तिथि ' || {_NATIVE % "dd || '/' || mm || '/' || yy"} || ' तक' AS unified, CASE WHEN NOT bad THEN CAST(d AS DATE) END AS day, CASE WHEN NOT bad THEN CAST(d AS DATE) END AS short_day,
  {_NATIVE % "dd || '-' || mm || '-' || yy"} || ':' || CAST(5 AS VARCHAR) || ':' || CAST(15 AS VARCHAR) || ':' || CASE WHEN bad THEN 'false' ELSE 'true' END AS candidate,
  {_NATIVE % "dd || '.' || mm || '.' || yy"} AS deadlines, {_NATIVE % "dd || '.' || mm || '.' || yy"} AS printed FROM x""")
def native_digit_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, F18, F19, F20, F27 with dates in Devanagari digits, a third of them impossible."""
    o, bad = m.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3 == 0
    day, month = F.when(bad, "31").otherwise(F.date_format("o_orderdate", "dd")), F.when(bad, "02").otherwise(F.date_format("o_orderdate", "MM"))
    year = F.date_format("o_orderdate", "yyyy")
    by = lambda sign: _native(F.concat_ws(sign, day, month, year))
    text = F.concat(F.lit("तिथि "), _native(F.concat(day, F.lit(" . "), month, F.lit(" - "), year)), F.lit(" तक"))
    found = F.get(ex.date_candidates(F.concat(F.lit("तिथि "), by("-"), F.lit(" तक"))), F.lit(0))
    letter = F.concat(F.lit("दिनांक: "), by("."))
    return o.select(
        F.col("o_orderkey").alias("id"),
        tx.date_separators(text).alias("unified"),
        ex.normalised_date(by("/")).alias("day"),
        ex.normalised_date(_native(F.concat_ws("-", day, month, F.substring(year, 3, 2)))).alias("short_day0"),
        F.concat_ws(":", found["text"], found["start"], found["end"], found["valid"]).alias("candidate"),
        F.array_join(ex.deadlines(letter), ",").alias("deadlines"),
        ex.printed_date(tx.text_lines(letter), letter).alias("printed"),
        year.alias("_year"),
    ).withColumn("short_day", F.when(F.col("_year") < "2000", F.add_months("short_day0", -1200)).otherwise(F.col("short_day0"))).drop("short_day0", "_year")


# --- letters read by the script version's rules ----------------------------------------------------------------------

_SCRIPT = r"""l AS (SELECT p_partkey AS id, p_name, p_brand, p_type, p_partkey % 4 AS k, (1 + p_partkey % 28) AS d, (2001 + p_partkey % 20) AS y FROM part)"""
_SCRIPT_SUBJECT = "CASE WHEN k <> 3 THEN p_name || ' in ' || p_type END"
_SCRIPT_AUTHORITY = "CASE WHEN k = 1 THEN 'District Magistrate' WHEN k = 2 THEN 'BSEB' ELSE p_brand || ' works' END"
_SCRIPT_DATE = "CASE k WHEN 0 THEN d || ' March ' || y WHEN 1 THEN d || '/3/' || y WHEN 2 THEN d || '.03.' || y END"


def _script_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters: the date with the month's name, labelled in Hindi, unlabelled, or none; senders with a greeting, known ones, others."""
    p, key = m.parts(spark, sf_dir), F.col("p_partkey")
    day, year = (1 + key % 28).cast("string"), (2001 + key % 20).cast("string")
    k = key % 4
    sender = F.when(k == 1, "जारीकर्ता: श्रीमान District Magistrate, Patna").when(k == 2, "sent to all by the BSEB today").otherwise(F.concat(F.lit("Issued by - "), "p_brand", F.lit(" works")))
    dated = F.when(k == 0, F.concat(F.lit("date: "), day, F.lit(" March "), year)).when(k == 1, F.concat(F.lit("तिथि : "), day, F.lit("/3/"), year)).when(k == 2, F.concat(F.lit("on "), day, F.lit(".03."), year)).otherwise("no day")
    text = F.concat(
        F.lit("पत्रांक - अ-"), key, F.lit("/शि\n"), sender, F.lit("\n"), dated, F.lit("\n"), F.when(k != 3, F.concat(F.lit("विषय: "), "p_name", F.lit(" in "), "p_type", F.lit(" . \n"))).otherwise(F.lit("")),
        F.when(k == 0, "action required: send the list\n").when(k == 1, "reply immediately\n").otherwise(""), F.when(k == 2, "admission of new pupils").otherwise("other things"),
    )
    return p.select(key.alias("id"), text.alias("text"))


@query(rf"""WITH {_SCRIPT}, x AS (SELECT *, {_SCRIPT_SUBJECT} AS subject, {_SCRIPT_DATE} AS printed FROM l)
SELECT id, 'अ-' || id || '/श' AS reference, printed, subject, CASE k WHEN 1 THEN 'District Magistrate' WHEN 2 THEN 'BSEB' ELSE p_brand || ' works' END AS authority,
  CASE k WHEN 0 THEN 'send the list' WHEN 1 THEN 'Immediate action required' END AS action, CASE WHEN k = 2 THEN 'admission' ELSE 'other' END AS category_key, CASE WHEN k = 2 THEN 'Admission' ELSE 'Other' END AS category,
  CASE WHEN k = 3 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
  coalesce(subject, CASE WHEN length('पत्रांक - अ-' || id || '/शि') >= 15 THEN 'पत्रांक - अ-' || id || '/शि Issued by - ' || p_brand || ' works' ELSE 'Issued by - ' || p_brand || ' works' END) AS description,
  'यह दस्तावेज़ f' || id || '.pdf के रूप में प्राप्त हुआ। ' || coalesce('विषय: ' || subject || '. ', 'विषय स्वतः निर्धारित नहीं हो सका। ') || 'जारीकर्ता: ' || CASE k WHEN 1 THEN 'District Magistrate' WHEN 2 THEN 'BSEB' ELSE p_brand || ' works' END || '. '
    || coalesce('जारी तिथि: ' || printed || '. ', 'जारी तिथि स्वतः निर्धारित नहीं हो सकी। ') || 'OCR/पाठ निष्कर्षण के आधार पर विवरण तैयार किया गया है.' AS detailed FROM x""")
def script_letter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the script version's fields."""
    text = F.col("text")
    rows = _script_letters(spark, sf_dir).select(
        "id", "text", ex.script_reference(text).alias("reference"), ex.script_date(text).alias("printed"), ex.script_subject(text).alias("subject"),
        ex.script_authority(text).alias("authority"), ex.required_action(text).alias("action"), ex.rule_category(text).alias("c"),
    )
    name = F.concat(F.lit("f"), "id", F.lit(".pdf"))
    return rows.select(
        "id", "reference", "printed", "subject", "authority", "action", F.col("c.key").alias("category_key"), F.col("c.label").alias("category"),
        ex.rule_confidence(F.col("subject"), F.col("printed"), F.lit(None).cast("string")).alias("confidence"),
        ex.script_description(tx.text_lines(text), F.col("subject"), F.col("authority")).alias("description"),
        ex.detailed_description(name, F.col("subject"), F.col("authority"), F.col("printed")).alias("detailed"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Office of the ' || p_brand END AS authority, CASE WHEN p_partkey % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS confidence,
  CASE WHEN p_partkey % 2 = 0 THEN 'reply by friday is a must' ELSE '' END AS actions, CASE WHEN p_partkey % 5 = 0 THEN 'Brand#' ELSE '' END AS office,
  CASE WHEN p_partkey % 2 = 0 THEN 'Subject text: ' || p_name || '। पत्र में संबंधित कार्यवाही/निर्देश के रूप में reply by friday is a must।' ELSE 'यह दस्तावेज़ other संबंधी सूचना/निर्देश से संबंधित है: Subject text: ' || p_name || '.' END AS description FROM part""".replace("reply by friday is a must", "आदेश दिया जाता है"))
def letter_intelligence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24 with and without a hit, F28 lines, F34 templated, F36 office and description."""
    p, key = m.parts(spark, sf_dir), F.col("p_partkey")
    head = F.when(key % 3 == 0, F.concat(F.lit("Office of the "), "p_brand")).otherwise(F.lit("a letter"))
    text = F.concat(
        head, F.lit("\nSubject: Subject text: "), "p_name", F.lit("\n1. none\n"), F.when(key % 2 == 0, "आदेश दिया जाता है\n").otherwise(""),
        F.when(key % 5 == 0, "seen at zzoffice").otherwise("seen"),
    )
    lines = tx.text_lines(text)
    found = ex.document_intelligence(text, offices={"Brand#": ["zzoffice"]})
    return p.select(key.alias("id"), ex.header_authority(lines, ["office of the"]).alias("a"), found.alias("i")).select(
        "id", F.col("a.value").alias("authority"), F.col("a.confidence").alias("confidence"), F.array_join("i.actions", "|").alias("actions"),
        F.coalesce("i.office.key", F.lit("")).alias("office"), F.col("i.description").alias("description"),
    )


_LABELS = ["BSEB", "payment / fee", "Teacher / Staff", "computer science", "none of these", None, "Deadline / Urgent Action"]
_KEYS = ["bseb", "payment_fee", "teacher_staff", "computer_science", "other", "other", "deadline_urgent"]


@query(f"""SELECT o_orderkey AS id, ([{", ".join(repr(k) for k in _KEYS)}])[CAST(o_orderkey % 7 AS INT) + 1] AS key,
  (['admission', 'other', 'other'])[CAST(o_orderkey % 3 AS INT) + 1] AS type_key, (['Admission', 'Holiday', 'Land Record'])[CAST(o_orderkey % 3 AS INT) + 1] AS type_label,
  (['HIGH', 'LOW', 'LOW'])[CAST(o_orderkey % 3 AS INT) + 1] AS type_confidence FROM orders""")
def taxonomy_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: labels of the taxonomy whatever their case, types in and out of it."""
    o, key = m.table(spark, sf_dir, "orders"), F.col("o_orderkey")
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), (key % 7).cast("int"))
    kind = F.get(F.array(*map(F.lit, ["Admission ", "holiday", "land_record"])), (key % 3).cast("int"))
    sure = F.get(F.array(F.lit("high"), F.lit("sure"), F.lit(None)), (key % 3).cast("int"))
    t = ex.type_category(kind, sure)
    return o.select(key.alias("id"), ex.taxonomy_key(label).alias("key"), t["key"].alias("type_key"), t["label"].alias("type_label"), t["confidence"].alias("type_confidence"))


# --- lifecycle -------------------------------------------------------------------------------------------------------


@query(f"""WITH {m.LIFECYCLE_SQL} SELECT id, canonical FROM ld""")
def canonical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4."""
    return m.lifecycle_documents(spark, sf_dir).drop("canonical").select("id", lifecycle.canonical_source(["bot"], ["chat"]).alias("canonical"))


@query(f"""WITH {m.INTAKE_SQL} SELECT CAST(CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS INT) AS exit_status FROM i WHERE received_at > {TS_NOW} - INTERVAL 24 HOUR
  AND (status = 'Processing Failed' OR (storage_status = 'Stored' AND (coalesce(bucket, '') = '' OR coalesce(path, '') = '')))""")
def health_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard issues of the last day make the verdict."""
    recent = m.intake(spark, sf_dir).where(lifecycle.within(F.col("received_at"), now(), 24))
    docs = m.lifecycle_documents(spark, sf_dir).where("canonical")
    issues = lifecycle.health_issues(recent, docs, m.audits(spark, sf_dir).select(F.col("document_id").alias("id")), now=now(), provenance="vision")
    return lifecycle.health_verdict(issues)


@query(f"""WITH {m.INTAKE_SQL} SELECT CASE WHEN status IN ('Stored', 'Processing Failed') THEN CASE WHEN bucket IS NULL THEN 'failed' ELSE 'processed' END ELSE 'skipped' END AS outcome, count(*) AS n FROM i GROUP BY 1""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a worker's run, taken while it writes its rows: no second job, no second scan."""
    i = m.intake(spark, sf_dir)
    claimed = F.col("status").isin("Stored", "Processing Failed")
    outcome = F.when(~claimed, "skipped").when(F.col("bucket").isNull(), "failed").otherwise("processed")
    path = f"{m.shared_dir(spark)}/docweft/run-{m.fresh()}"
    counters = lifecycle.write_counted(i.select("id", outcome.alias("outcome")), path, ["processed", "failed", "skipped"])
    return spark.createDataFrame(sorted(counters.items()), "outcome string, n long").where("n > 0")


@query("""SELECT n_nationkey % 3 AS category_key, 2 AS version FROM nation WHERE n_nationkey % 3 = 1 GROUP BY 1""".replace("n_nationkey % 3 AS", "'k' || (n_nationkey % 3) AS"))
def protected_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version whose name was changed after the fact; closing a version is allowed."""
    n = m.table(spark, sf_dir, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey") % 3).alias("category_key")).distinct()
    rows = n.select("category_key", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    rows = rows.select("category_key", "version", F.concat(F.lit("n"), "version").alias("display_name"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(version)").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    after = rows.withColumn("valid_to", F.when(F.col("version") == 1, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")))
    renamed = F.when((F.col("category_key") == "k1") & (F.col("version") == 2), "other").otherwise(F.col("display_name"))
    return vocab.protected_changes(rows, after.withColumn("display_name", renamed))


# --- vocabulary tables -------------------------------------------------------------------------------------------------

_EDGE = r"[^\p{L}\p{M}\p{N}_]"


@query(rf"""WITH b AS (SELECT DISTINCT 'k' || (item_id % 7) AS key, regexp_extract(lower(text), '^[^a-z]*([a-z]+ [a-z]+ [a-z]+)', 1) AS term FROM benchmark
  UNION SELECT 'w' || (item_id % 3), regexp_extract(lower(text), '([a-z]{{9,}})', 1) FROM benchmark),
v AS (SELECT * FROM b WHERE term <> ''), d AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
f AS (SELECT DISTINCT id, key FROM d, v WHERE contains(t, term) AND CASE WHEN contains(t, term) THEN regexp_matches(t, '(^|{_EDGE})' || term || '({_EDGE}|$)') END),
g AS (SELECT id, list_sort(list(key)) AS ks FROM f GROUP BY id)
SELECT id, CASE WHEN len(ks) = 1 THEN ks[1] END AS key, coalesce(len(ks) > 1, false) AS ambiguous, CASE WHEN len(ks) > 1 THEN array_to_string(ks, ',') ELSE '' END AS candidates FROM d LEFT JOIN g USING (id)""")
def vocabulary_table_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6, J12, A11 with a vocabulary table: the opening words and the first long word of benchmark items, looked up in all documents."""
    b = m.table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t"))
    opening = b.select(F.concat(F.lit("k"), F.col("item_id") % 7).alias("key"), F.regexp_extract("t", "^[^a-z]*([a-z]+ [a-z]+ [a-z]+)", 1).alias("term"))
    long = b.select(F.concat(F.lit("w"), F.col("item_id") % 3).alias("key"), F.regexp_extract("t", "([a-z]{9,})", 1).alias("term"))
    docs = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return vocab.resolve_vocabulary(docs, opening.unionByName(long).where("term <> ''"))


@query(rf"""WITH f AS (SELECT doc_id AS id, lang, {_FOLDED.format("text")} AS t FROM documents WHERE lang = 'fr'),
s AS (SELECT id, lang, round((2 * CASE WHEN contains(t, 'aux') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'tionre') THEN 1 ELSE 0 END + CASE WHEN contains(t, 'éont') THEN 1 ELSE 0 END) / 4.0, 4) AS score FROM f)
SELECT id, lang, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, CAST(id AS VARCHAR) LIMIT 20""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 20 (the limit is the operator) from an index of all documents."""
    d = m.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    index = search_index.IndexedSearch.build(d, f"{m.shared_dir(spark)}/docweft/index-{m.fresh()}", text=publish.searchable([F.col("text")]), keep=["lang"])
    return index.search(None, "AUX tionre a éont, aux", filters={"lang": "FR "}).select("id", "lang", "score")


@query("""SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'malformed' WHEN event_id % 10 = 1 THEN 'missing' END AS error,
  CASE WHEN event_id % 10 > 1 THEN coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, json_extract_string(props, '$.k')) END AS value,
  CASE WHEN event_id % 10 > 1 THEN CAST(json_extract_string(props, '$.k') AS INT) END AS number,
  CASE WHEN event_id % 10 > 1 THEN CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END || ':new:' || json_extract_string(props, '$.k') ELSE ':new:' END AS merged,
  CASE WHEN event_id % 10 < 2 THEN 'not_json' ELSE 'required:name;' || CASE WHEN event_id % 3 = 0 THEN 'additional:a;' ELSE '' END || 'additional:z' END AS violations FROM events""")
def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F43, F44, P13 over variants of one parse; malformed and missing texts are told apart."""
    e, n = m.table(spark, sf_dir, "events"), F.col("event_id") % 10
    inner = F.get_json_object("props", "$.k")
    text = F.concat(F.lit("{"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"a":{"b":"'), "event_type", F.lit('"},'))).otherwise(""), F.lit('"k":'), inner, F.lit(',"z":{"q":[1]}}'))
    rows = e.select("event_id", F.when(n == 0, F.lit("{broken")).when(n > 1, text).alias("j"), F.lit('{"s":"new"}').alias("c"))
    rows = variants.contract_violations(rows, "j", {"k": ("integer?", False, None), "name": ("string", True, None)})
    rows = variants.parsed(variants.parsed(rows, "j", "v", "error"), "c", "cv", "ce")
    merged = rows.withColumn("m", variants.merged_object(F.col("v"), F.col("cv"), ["z"]))
    part = lambda *p: F.coalesce(variants.first_value(F.col("m"), p), F.lit(""))
    return merged.select(
        F.col("event_id").alias("id"), "error", variants.first_value(F.col("v"), ["$.a.b", "$.k"]).alias("value"), variants.first_value(F.col("v"), ["$.k"], "int").alias("number"),
        F.concat_ws(":", part("$.a.b"), part("$.s"), part("$.k")).alias("merged"), F.array_join("violations", ";").alias("violations"),
    )
