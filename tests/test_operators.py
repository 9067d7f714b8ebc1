"""Operators on small tables: the cases that queries over the given tables do not reach."""

import datetime
import json
import random

import pytest
from docweft.operators import checks, compare, dedup, deliver, hooks, layout, lifecycle, pages, publish, quality, search, vocab
from docweft.sources import io
from pyspark.sql import functions as F

NOW = datetime.datetime(2026, 9, 14, 12, 0)


def minutes(n):
    return NOW - datetime.timedelta(minutes=n)


STATE = "id string, processing_status string, publication_status string, approved boolean, delivery_status string, nested_storage_status string, storage_status string, has_intake boolean"


def test_state_table(spark):
    cases = [
        (("a", None, None, None, None, None, None, True), ("INTAKE_RECEIVED", "storage")),
        (("b", None, None, None, None, "AVAILABLE", None, True), ("STORED", "processing")),
        (("c", "Completed", None, None, None, None, None, False), ("PROCESSED", "publication")),
        (("d", "Completed", "Unpublished", None, None, None, None, False), ("PUBLICATION_PENDING", "publication")),
        (("e", None, "Published", True, None, None, None, False), ("DELIVERY_PENDING", "delivery")),
        (("f", None, "Published", True, "Delivered", None, None, False), ("DELIVERED", "none")),
        (("g", "Processing Failed", None, None, None, None, None, False), ("RECOVERY_REQUIRED", "processing")),
        (("h", None, None, None, None, "Storage Failed", None, True), ("RECOVERY_REQUIRED", "storage")),
        (("i", None, None, None, None, None, None, False), ("UNKNOWN", "manual_review")),
        ((None, None, None, None, None, None, None, False), ("REJECTED", "none")),
        (("k", None, None, None, None, "", "Stored", True), ("STORED", "processing")),
    ]
    rows = lifecycle.lifecycle_state(spark.createDataFrame([c[0] for c in cases], STATE)).collect()
    assert {r.id: (r.state, r.next_action) for r in rows} == {c[0][0]: c[1] for c in cases}
    plan = {r.id: r.stage for r in lifecycle.recovery_plan(spark.createDataFrame([c[0] for c in cases], STATE)).collect()}
    assert plan == {"e": "delivery", "f": "delivery", "g": "processing"}


def test_gate_nulls(spark):
    cols = "id int, processing_status string, publication_status string, backup_id string, sensitive boolean, duplicate boolean, useful boolean, full_text string, extraction_method string"
    text = "x" * 80
    rows = [
        (1, "Completed", None, "b", None, None, None, text, "m"), (2, "Completed", "Published", "b", True, True, False, "short", " "), (3, None, "Unpublished", "", False, False, True, text, "m"),
    ]
    got = {r.id: r.gate_reason for r in publish.gate(spark.createDataFrame(rows, cols)).collect()}
    assert got[1] == "ok"
    assert got[2] == "publication_not_pending,sensitive_document,duplicate_document,document_marked_not_useful,insufficient_ocr_text,missing_extraction_provenance"
    assert got[3] == "processing_not_completed,drive_backup_missing"


def test_senders_attachments_and_queue(spark):
    m = spark.createDataFrame([(1, "u1", "c9"), (2, "u9", "c1"), (3, "u1", "c1"), (4, "u9", "c9")], "id int, user_id string, chat_id string")
    users, chats = spark.createDataFrame([("u1",)], "user_id string"), spark.createDataFrame([("c1",)], "chat_id string")
    assert sorted(r.id for r in publish.allowed_senders(m, users, chats).collect()) == [1, 2, 3]
    files = spark.createDataFrame([(None, ["s", "l"]), ("d", ["s"]), (None, [])], "d string, p array<string>")
    assert [r[0] for r in files.select(publish.chosen_attachment(F.col("d"), F.col("p"))).collect()] == ["l", "d", None]
    q = spark.createDataFrame([(3, 5), (1, None), (2, 5), (4, 1)], "id int, at int")
    assert [r.id for r in publish.oldest_first(q, 3, at="at", key="id").collect()] == [4, 2, 3]
    assert [(r.id, r.serial) for r in publish.numbered(publish.oldest_first(q, 2, at="at", key="id"), F.col("at"), F.col("id")).collect()] == [(4, 1), (2, 2)]


def test_claim_lease_boundary(spark):
    state = "document_id int, chat_id string, status string, attempts int, locked_at timestamp_ntz, first_attempt_at timestamp_ntz, last_attempt_at timestamp_ntz"
    rows = [(i, "c", s, 1, minutes(m), minutes(99), minutes(m)) for i, s, m in ((1, "sent", 99), (2, "pending", 9), (3, "pending", 10), (4, "failed", 11))]
    asked = spark.createDataFrame([(i, "c") for i in (1, 2, 3, 4, 5, 5)], "document_id int, chat_id string")
    now = F.lit(NOW).cast("timestamp_ntz")
    got = {r.document_id: (r.claimed, r.attempts, r.first_attempt_at) for r in deliver.claim(spark.createDataFrame(rows, state), asked, now).collect()}
    assert got == {1: (False, 1, minutes(99)), 2: (False, 1, minutes(99)), 3: (True, 2, minutes(99)), 4: (True, 2, minutes(99)), 5: (True, 1, NOW)}


def test_worklist_is_idempotent(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id int")
    chats = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    audits = spark.createDataFrame([(1, "a", "d", None), (1, "b", "d", "Failed"), (2, "a", "other", "Sent")], "document_id int, chat_id string, operation string, result string")
    work = deliver.worklist(docs, chats, audits, "d")
    assert sorted(map(tuple, work.collect())) == [(1, "b"), (2, "a"), (2, "b")]
    done = audits.unionByName(work.select("document_id", "chat_id", F.lit("d").alias("operation"), F.lit("Sent").alias("result")))
    assert deliver.worklist(docs, chats, done, "d").count() == 0
    assert sorted(map(tuple, deliver.worklist(docs, chats, audits, "d", block=1).collect())) == sorted(map(tuple, work.collect()))
    by_json = audits.select("document_id", "operation", "result", F.to_json(F.struct("chat_id")).alias("details"))
    assert sorted(map(tuple, deliver.worklist(docs, chats, by_json, "d").collect())) == sorted(map(tuple, work.collect()))
    row = spark.createDataFrame([(["100", "200", " "], ["200", "300"])], "a array<string>, b array<string>")
    assert row.select(deliver.merged_recipients(F.col("a"), F.col("b"))).first()[0] == ["100", "200", "300"]


def test_compare_cases(spark):
    cols = "entity string, profile_type string, field_key string, value string"
    left = spark.createDataFrame([("e", "g", k, v) for k, v in (("same", " A "), ("minor", "TABBU-KHATOON"), ("gone", ""), ("only", "x"), ("none", None), ("diff", "1"))], cols)
    right = spark.createDataFrame([("e", "g", k, v) for k, v in (("same", "a"), ("minor", "Tabbu Khatoon"), ("gone", "v"), ("none", " "), ("diff", "2"), ("new", "n"))], cols)
    out = compare.compare_profiles(left, right)
    assert {r.field_key: (r.status, r.proposed) for r in out.collect()} == {
        "same": ("MATCH", " A "), "minor": ("MINOR_VARIATION", "Tabbu Khatoon"), "gone": ("MISSING_IN_PORTAL", "v"), "only": ("MISSING_IN_SOURCE", None),
        "none": ("NOT_AVAILABLE", None), "diff": ("VALUE_DIFFERENT", "2"), "new": ("MISSING_IN_PORTAL", "n"),
    }
    assert sorted(r.field_key for r in compare.change_preview(out).collect()) == ["diff", "gone", "minor", "new"]
    v = spark.createDataFrame([("k", "low", "b"), ("k", "top", None), ("k", "mid", "a")], "k string, source string, value string")
    assert [tuple(r) for r in compare.preferred_value(v, ["k"], ["top", "mid", "low"]).collect()] == [("k", "a", "mid")]
    good = "AB" * 32
    d = spark.createDataFrame([("bad", good)], "a string, b string").select(compare.first_digest(F.col("a"), F.col("b")).alias("d"))
    assert d.first()[0] == good.lower()


REGION = "doc_id int, page int, id string, x1 int, y1 int, x2 int, y2 int, text string, confidence double"


def test_layout_fixtures(spark):
    def page(doc, *boxes):
        return [(doc, 1, i, *b, i, 0.9) for i, b in boxes]

    rows = page(1, ("a", (10, 10, 60, 30)), ("b", (100, 11, 150, 31)), ("c", (10, 50, 60, 70)))
    rows += page(2, ("r1", (10, 20, 90, 40)), ("r2", (250, 20, 330, 40)), ("r3", (10, 60, 90, 80)), ("r4", (250, 60, 330, 80)))
    rows += page(3, ("x", (10, 10, 20, 20)), ("y", (100, 12, 110, 22)), ("z", (11, 60, 20, 70)), ("w", (101, 61, 111, 71)))
    r = spark.createDataFrame(rows, REGION)
    placed = layout.lines(r)
    assert {(x.id, x.line, x.place) for x in placed.where("doc_id = 1").collect()} == {("a", 0, 0), ("b", 0, 1), ("c", 1, 0)}
    order = layout.reading_order(r)
    assert [x.id for x in order.where("doc_id = 2").orderBy("position").collect()] == ["r1", "r3", "r2", "r4"]
    assert {(x.doc_id, x.column_count, x.reading_order) for x in layout.layout_summary(order).collect()} >= {(1, 1, "a,b,c"), (2, 2, "r1,r3,r2,r4")}
    assert {(x.line, x.text) for x in layout.line_texts(r, placed).where("doc_id = 1").collect()} == {(0, "a b"), (1, "c")}
    found = layout.table_evidence(placed, layout.table_anchors(r)).where("doc_id = 3").first()
    assert found.table_candidate and found.repeated_columns == 2 and found.candidate_rows == 2


def test_regions_and_pages(spark):
    raw = spark.createDataFrame([(1, "a", [4.0, 3.0, 2.0, 1.0], None, 1), (1, None, [1.4, 2.0, 3.6, 4.0], "t", 2), (1, "c", [1.0], "t", 3)], "doc_id int, id string, bbox array<double>, text string, position int")
    got = {r.id: (r.valid, r.x2) for r in layout.normalise_regions(raw).collect()}
    assert got["a"] == (False, 2) and got["region-2"] == (True, 4) and got["c"][0] is False
    r = spark.createDataFrame([(1, 1, "a", 0, 0, 1, 1, "1) head", 0.9), (1, 1, "b", 0, 0, 1, 1, "body", 0.4), (1, 1, "c", 0, 0, 1, 1, "", None)], REGION)
    roll = pages.confidence_rollup(r, ["doc_id"]).first()
    assert (roll.region_count, roll.scored_count, round(roll.mean_confidence, 3), roll.low_confidence, roll.approval) == (3, 2, 0.65, True, False)
    assert layout.review_contract(r).first().candidates == "b"
    shape = pages.structure_evidence(r).first()
    assert (shape.headings, shape.has_body) == (1, True)
    p = spark.createDataFrame([(1, 2, "ocr:t", "t", "b"), (1, 1, "embedded-text", None, "a")], "doc_id int, page int, method string, engine string, text string")
    s = pages.page_summary(p).first()
    assert (s.methods, s.mixed, s.method_label, s.engines) == ("embedded-text,ocr:t", True, "mixed", "t")
    assert pages.document_text(p).first().text == "a\n\nb"


def test_page_policies(spark):
    m = spark.createDataFrame([(0.055, 0.012, 0.0, 0.349, "d"), (0.054, 0.012, 0.034, 0.35, "d"), (None, None, 0.035, None, "d"), (0.0, 0.0, 0.0, 2.0, "d"), (0.0, 0.0, 0.0, 0.1, "z")], "a double, b double, c double, q double, e string")
    got = m.select(layout.visual_marks(F.col("a"), F.col("b"), F.col("c")).alias("v"), layout.engine_choice(F.col("e"), F.col("q"), default="d", better="p").alias("g")).collect()
    assert [r.v.review for r in got] == [True, False, False, False, False]
    assert [(r.g.engine, r.g.escalated, r.g.error) for r in got] == [("p", True, None), ("d", False, None), ("d", False, None), ("d", False, "quality out of range"), ("z", False, None)]
    t = spark.createDataFrame([("x" * 79 + " \n",), ("x" * 80,), (None,)], "t string")
    assert [r[0] for r in t.select(layout.page_route(F.col("t"))).collect()] == ["recognise", "embedded-text", "recognise"]


def test_contracts(spark):
    good = {"category": "c", "priority": "HIGH", "required_action": "r", "confidence": "LOW", "needs_manual_review": True, "source_page": 1, "subject": None, "affected_entities": ["a"]}
    bad = {"category": 1, "priority": "SOON", "confidence": "LOW", "needs_manual_review": True, "source_page": 0, "more": 1, "required_action": "r"}
    rows = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("nope",)], "j string").select(checks.contract_violations(F.col("j")).alias("v")).collect()
    assert rows[0].v == []
    assert sorted(rows[1].v) == ["additional:more", "enum:priority", "minimum:source_page", "type:category"]
    assert rows[2].v == ["not_json"]
    results = [{"schema_version": 1, "text": "", "normalized_text": "", "filename": "f", "ocr": {}, "pages": p} for p in ([{"page_number": 1}, {"page_number": 2}], [{"page_number": 1}, {"page_number": 3}], [])]
    got = checks.release_gate(spark.createDataFrame([(json.dumps(r),) for r in results], "result string")).collect()
    assert [(r.valid, r.sequential_pages, r.page_count) for r in got] == [(True, True, 2), (False, False, 2), (False, False, 0)]


def test_quality_rates(spark):
    pairs = spark.createDataFrame([("a", "kitten", "sitting"), ("b", "", ""), ("c", "x", ""), ("d", "one two", "one three two"), ("e", "y" * 20, "y"), ("f", None, "x")], "case_id string, actual string, expected string")
    got = {r.case_id: r for r in quality.error_rates(pairs, longest=15).collect()}
    assert round(got["a"].cer, 4) == round(3 / 7, 4) and got["b"].cer == 0 and got["c"].cer == 1 and got["c"].wer == 1
    assert round(got["d"].wer, 4) == round(1 / 3, 4) and got["e"].cer is None and got["e"].skipped == "longer than 15" and got["f"].wer is None


def test_edit_distance_is_exact():
    def brute(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    for n in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(40))) for _ in range(2))
        assert quality.edit_distance(a, b, block=1 + n % 9) == quality.edit_distance(list(a), list(b)) == brute(a, b)


def test_word_edits_are_exact(spark):
    rng = random.Random(8)
    some = ["a", "b", "c", "déjà", "x1", "कार्य", "😀", "dd"]
    text = lambda: "".join(rng.choice(some) + rng.choice([" ", "  ", "\n", "\u2003", "\x1f", "\xa0"]) for _ in range(rng.randrange(25)))
    rows = [(i, text(), text()) for i in range(200)] + [(200, "", ""), (201, " ", "a"), (202, None, "a"), (203, "w " * 700, " ".join(f"w{i}" for i in range(700)))]
    got = {r.i: r.e for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", quality.word_edits(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got == {i: None if a is None else quality.edit_distance(a.split(), b.split()) for i, a, b in rows}


def test_long_pairs_have_rates(spark):
    words = [f"w{i % 97}" for i in range(3000)]
    changed = [w if i % 10 else "x" for i, w in enumerate(words)]
    pairs = spark.createDataFrame([("long", " ".join(changed), " ".join(words)), ("same", "a", "a"), ("half", None, "z" * 6000)], "case_id string, actual string, expected string")
    rates = quality.error_rates(pairs)
    got = {r.case_id: r for r in rates.collect()}
    assert len(got) == 3 and all(r.skipped is None for r in got.values()) and got["half"].cer is None
    assert got["long"].word_edits == 300 and got["long"].wer == 0.1 and len(" ".join(words)) > quality.LONGEST
    assert got["long"].cer == quality.edit_distance(" ".join(changed), " ".join(words)) / len(" ".join(words))
    pooled = quality.corpus_rates(rates.withColumn("by", F.lit(1)), "by").first()
    assert pooled.cases == 3 and pooled.pooled_wer == 300 / 3001 and pooled.mean_wer == 0.05


def test_vocabulary(spark):
    d = spark.createDataFrame([("alpha beta",), ("alphabet",), ("gamma, ALPHA",), ("",)], "t string")
    got = [r[0] for r in d.select(vocab.resolve(F.col("t"), {"a": ["alpha", "alpha beta"], "g": ["gamma"]})).collect()]
    assert [(g.key, g.ambiguous, g.candidates) for g in got] == [("a", False, ""), (None, False, ""), (None, True, "a,g"), (None, False, "")]
    longest = d.select(vocab.match_terms(F.col("t"), {"a": ["alpha", "alpha beta"]})).first()[0]
    assert longest[0].term == "alpha beta"
    cases = spark.createDataFrame([("c1", ["Alpha", "delta"])], "case_id string, expected_terms array<string>")
    pack = spark.createDataFrame([("alpha",)], "term string")
    assert [tuple(r) for r in vocab.coverage_gaps(cases, pack).collect()] == [("c1", "delta")]
    defs = spark.createDataFrame([("k", 1, None), ("k", 2, None), ("z", 1, 5)], "category_key string, version int, valid_to int")
    assert {(r.category_key, r.open_versions) for r in vocab.open_version_violations(defs).collect()} == {("k", 2), ("z", 0)}


def test_search(spark):
    assert search.query_tokens("The  शिक्षा-विभाग a the") == ["the", "शिक्षा", "विभाग", "the"]
    d = spark.createDataFrame([(2, "the cat"), (10, "the cat"), (1, "cat"), (3, "dog")], "id int, t string")
    got = search.search(d, "the cat", text=F.col("t"), limit=3).collect()
    assert [(r.id, r.score) for r in got] == [(10, 1.0), (2, 1.0), (1, 0.5)]
    assert search.search(d, "a", text=F.col("t")).count() == 0


def test_sources(spark, tmp_path):
    (tmp_path / "cases.jsonl").write_text('# note\n\n{"case_id": "1", "source": "s", "expected_text": "e"}\nbroken\n')
    assert [r.case_id for r in io.read_cases(spark, str(tmp_path / "cases.jsonl")).collect()] == ["1", None]
    (tmp_path / "p.json").write_text('{"terms": {"k": ["a", "b"]}, "list": ["c"], "map": {"x": "y"}, "version": 1}')
    got = {tuple(r) for r in io.read_vocabulary(spark, str(tmp_path / "p.json")).collect()}
    assert got == {("p", "terms", "k", "a"), ("p", "terms", "k", "b"), ("p", "list", "c", "c"), ("p", "map", "x", "y")}
    (tmp_path / "e1.json").write_text('{"general": {"name": "N", "code": null}}')
    assert {tuple(r) for r in io.read_profiles(spark, str(tmp_path / "e1.json")).collect()} == {("e1", "general", "name", "N"), ("e1", "general", "code", None)}
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1.7 x")
    r = io.file_inventory(io.read_files(spark, str(tmp_path), "*.pdf")).first()
    assert (r.size, r.format, len(r.sha256)) == (10, "pdf", 64)
    events = spark.createDataFrame([(1, NOW)], "id int, created_at timestamp")
    for _ in range(2):
        io.append_events(events, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    io.write_json(events, str(tmp_path / "out"))
    assert io.scan(spark, str(tmp_path / "log"), ["id"], F.col("id") == 1).columns == ["id"]


def test_recogniser_runs_once_for_a_file(spark):
    def engine(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"key": b.key, "text": "t", "engine": "e", "confidence": 1.0, "regions": [[]] * len(b)})

    files = spark.createDataFrame([(1, "h", b"x"), (2, "h", b"x"), (3, "g", b"y")], "id int, sha256 string, content binary")
    out = hooks.recognise(files, engine)
    assert sorted((r.id, r.text) for r in out.collect()) == [(1, "t"), (2, "t"), (3, "t")]


def test_dedup_has_no_window_or_self_join(spark):
    d = spark.createDataFrame([(2, "c", 1), (1, "c", 1), (3, None, 1)], "id int, checksum string, received_at int")
    out = dedup.canonical_by_checksum(d)
    assert {(r.id, r.canonical_id, r.duplicate) for r in out.collect()} == {(1, 1, False), (2, 1, True), (3, 3, False)}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lines_match_a_plain_search(spark):
    """Each region, from top to bottom, joins the nearest line whose leftmost region is near or overlaps it by half."""
    import random

    rng = random.Random(4)
    mid = lambda r: (r["y1"] + r["y2"]) / 2
    tall = lambda r: max(1, r["y2"] - r["y1"])
    rows, by_line, by_anchor = [], {}, {}
    for n in range(150):
        page = []
        for i in range(rng.randrange(1, 40)):
            x, y = rng.randrange(0, 300), rng.randrange(0, 150)
            page.append({"id": f"r{i:02}", "x1": x, "y1": y, "x2": x + 30, "y2": y + rng.choice([0, 5, 20, 60])})
        rows += [(n, 1 + n % 2, *r.values()) for r in page]
        want: list[list[dict]] = []
        for r in sorted(page, key=lambda r: (mid(r), r["x1"], r["id"])):
            heads = [min(line, key=lambda m: (m["x1"], m["id"])) for line in want]
            share = [max(0, min(h["y2"], r["y2"]) - max(h["y1"], r["y1"])) / min(tall(h), tall(r)) for h in heads]
            fits = [(abs(mid(h) - mid(r)), k) for k, h in enumerate(heads) if abs(mid(h) - mid(r)) <= 12 or share[k] >= 0.5]
            want[min(fits)[1]].append(r) if fits else want.append([r])
        want = [sorted(line, key=lambda r: (r["x1"], r["id"])) for line in want]
        want.sort(key=lambda line: (mid(line[0]), line[0]["x1"], line[0]["id"]))
        by_line |= {(n, r["id"]): (i, j) for i, line in enumerate(want) for j, r in enumerate(line)}
        edges = [[r["x1"] for r in line] for line in want]
        plain: list[int] = []
        for x in (x for line in edges for x in line):
            plain += [x] if min((abs(x - a) for a in plain), default=99) > 12 else []
        support = [(a, sum(min(abs(x - a) for x in line) <= 12 for line in edges)) for a in sorted(plain)]
        by_anchor |= {(n, i): a for i, a in enumerate(a for a in support if a[1] >= 2)} if len(edges) >= 2 else {}
    regions = spark.createDataFrame(rows, "doc_id int, page int, id string, x1 int, y1 int, x2 int, y2 int")
    found = layout.lines(regions)
    assert {(r.doc_id, r.id): (r.line, r.place) for r in found.collect()} == by_line
    assert {(r.doc_id, r.column_index): (r.x, r.support_rows) for r in layout.table_anchors(regions).collect()} == by_anchor
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and layout.lines(regions.limit(0)).count() == 0
