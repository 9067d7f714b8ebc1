"""Text and extraction goldens; column functions over one-row tables."""

import datetime

import pytest
from docweft.functions import extract as ex
from docweft.functions import files, messages
from docweft.functions import text as tx
from pyspark.sql import functions as F


def value(spark, column, **row):
    data = {k: ("" if v is None else v) for k, v in row.items()}
    return spark.createDataFrame([tuple(data.values())], list(data)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("पत्र संख्या 12", "पत्रांक: 12"),
        ("विषयक परीक्षा", "विषय: परीक्षा"),
        ("इस के सम्बन्ध में", "इस के संबंध में"),
        ("उपरोक्त विषयक के संबंध में", "उपरोक्त विषय के संबंध में"),
        ("दिनांक 12 . 9 - 2026", "दिनांक 12/9/2026"),
        ("a ,, b ;:", "a, b:"),
        ("x\u00a0y\r\n  z\u200b ", "x y\nz"),
    ],
)
def test_normaliser(spark, given, want):
    assert value(spark, tx.normalise(F.col("t")), t=given) == want


def test_normaliser_is_idempotent(spark):
    for given in ("उपरोक्त विषयक के संबंध मे ।", "पत्र सं. 5 –  12.1.2020", "आवश्यक कार्यवाही , तुरंत", "plain"):
        once = value(spark, tx.normalise(F.col("t")), t=given)
        assert value(spark, tx.normalise(F.col("t")), t=once) == once


def test_word_aliases_match_whole_words_only(spark):
    aliases = {"dept": "department", "depts": "departments"}
    assert value(spark, tx.word_aliases(F.col("t"), aliases), t="dept depts deptx (dept)") == "department departments deptx (department)"


def test_cleanup(spark):
    assert value(spark, tx.clean_control(F.col("t")), t="  hello\tworld\n\n\nnext  ") == "hello world\n\nnext"
    assert value(spark, tx.clean_recognised(F.col("t")), t="a\u00a0 b\u200c\r\n\n\n\nc") == "a b\n\nc"
    assert value(spark, tx.folded(F.col("t")), t="  Stra\u00dfe  X ") == "strasse x"
    assert value(spark, tx.compact(F.col("t")), t="Tabbu-Khatoon 1") == "tabbukhatoon1"
    assert value(spark, tx.text_lines(F.col("t")), t=" a  b \n\n c:\n") == ["a b", "c:"]
    assert value(spark, tx.text_lines(F.col("t"), strip_signs=True), t="a:\n- b -") == ["a", "b"]
    assert value(spark, F.size(tx.header_lines(F.col("t"))), t=[str(i) for i in range(50)]) == 11


@pytest.mark.parametrize(("given", "want"), [("12/09/2026", datetime.date(2026, 9, 12)), ("1.2.26", datetime.date(2026, 2, 1)), ("31/02/2026", None), ("x", None), ("1/2/123", None)])
def test_dates(spark, given, want):
    assert value(spark, ex.normalised_date(F.col("t")), t=given) == want


def test_date_candidates(spark):
    got = value(spark, ex.date_candidates(F.col("t")), t="on 12/09/2026, 31/02/2026 and 2026-01-05; 192.168.1.2026x")
    assert [(d["text"], d["valid"]) for d in got] == [("12/09/2026", True), ("31/02/2026", False), ("2026-01-05", True)]
    signals = value(spark, ex.date_signals(ex.date_candidates(F.col("t"))), t="31/02/2026")
    assert (signals["has_valid_date"], signals["has_invalid_date"]) == (False, True)


LETTER = """जिला शिक्षा पदाधिकारी, पटना
पत्रांक: 123/A दिनांक: 05.06.2024
विषय: परीक्षा कार्यक्रम के संबंध में
सूचना यहाँ है
महोदय,
सभी को सूचित किया जाता है कि 10/06/2024 तक जमा करें
अंतिम तिथि 12/06/2024"""


def test_letter_fields(spark):
    lines = tx.text_lines(F.col("t"), strip_signs=True)
    assert value(spark, ex.reference_number(lines), t=LETTER) == "123/A"
    assert value(spark, ex.printed_date(lines, F.col("t")), t=LETTER) == "05.06.2024"
    subject = value(spark, ex.official_subject(tx.text_lines(F.col("t"))), t=LETTER)
    assert (subject["value"], subject["source"], subject["confidence"]) == ("परीक्षा कार्यक्रम के संबंध में सूचना यहाँ है", "subject_label", "HIGH")
    authority = value(spark, ex.header_authority(tx.text_lines(F.col("t"))), t=LETTER)
    assert authority["value"] == "जिला शिक्षा पदाधिकारी, पटना" and authority["confidence"] == "HIGH"
    assert value(spark, ex.authority_name(F.col("t")), t=authority["value"]) == "District Education Office"
    assert value(spark, ex.document_type(F.col("t")), t=LETTER)["value"] == "examination"
    assert value(spark, ex.deadlines(F.col("t")), t=LETTER) == ["05.06.2024", "10/06/2024", "12/06/2024"]
    deadline = value(spark, ex.deadline(F.col("t")), t=LETTER)
    assert (deadline["value"], deadline["source"]) == ("12/06/2024", "label")
    assert len(value(spark, ex.action_lines(tx.text_lines(F.col("t"))), t=LETTER)) == 1
    assert value(spark, ex.priority(F.col("t")), t=LETTER) == "HIGH"
    assert value(spark, ex.category(F.col("t")), t=LETTER) == "District Office"
    whole = value(spark, ex.document_intelligence(F.col("t")), t=LETTER)
    assert whole["document_type"]["value"] == "examination" and whole["subject"]["confidence"] == "HIGH"


def test_labelled_line_takes_the_next_line(spark):
    lines = tx.text_lines(F.col("t"), strip_signs=True)
    assert value(spark, ex.labelled_line(lines, ["from"]), t="From:\nThe Office\nx") == "The Office"
    assert value(spark, ex.labelled_line(lines, ["from"]), t="fromage\nx") is None
    assert value(spark, ex.labelled_line(lines, ["from"], 3), t="From: too long\nFrom: ok") == "ok"
    assert value(spark, ex.rule_subject(lines), t="x\nA notice, सूचना for everybody here") == "A notice, सूचना for everybody here"
    assert value(spark, ex.rule_authority(lines, F.col("t")), t="विषय: कार्यालय\nमेरा कार्यालय") == "मेरा कार्यालय"


def test_small_rules(spark):
    assert value(spark, ex.filled_confidence([F.col("a"), F.col("b")]), a="x", b="y") == "MEDIUM"
    assert value(spark, ex.taxonomy_key(F.col("t"), {"Exam": "exam"}), t="Nope") == "other"
    merged = value(spark, ex.merged_field(F.col("a"), F.lit("HIGH"), F.col("b")), a="", b="rule")
    assert (merged["value"], merged["source"], merged["confidence"]) == ("rule", "rule", "MEDIUM")
    assert value(spark, ex.short_description(tx.text_lines(F.col("t"))), t="short\nhttp://a.very.long.address/x\na line that is long enough") == "a line that is long enough"
    assert value(spark, ex.clean_field(F.col("t")), t=" :- a  b -: ") == "a b"
    assert value(spark, ex.heading_kind(F.col("t")), t="1) one") == "heading_signal"
    assert value(spark, ex.heading_kind(F.col("t")), t="Subjective") == "body"


def test_files(spark):
    kind = files.file_format(F.col("c"), F.col("n"))
    for content, name, want in (
        (b"%PDF-1.4", "x", "pdf"), (b"\xff\xd8\xff\xe0", "x.pdf", "jpeg"), (b"\x89PNG\r\n\x1a\n", "", "png"), (b"II*\x00", "", "tiff"), (b"MM\x00*", "", "tiff"),
        (b"RIFF0000WEBP", "", "webp"), (b"text", "x.pdf", "unknown"), (b"text", "x.docx", "office"), (b"text", "x.JPG", "image"),
    ):
        assert spark.createDataFrame([(content, name)], "c binary, n string").select(kind).first()[0] == want
    name = value(spark, files.canonical_filename(F.col("o"), F.col("s"), F.col("a"), F.col("d"), F.col("r")), o="scan.PDF", s="A/B: " + "long " * 60, a="Office", d="2024-06-05", r="1/2")
    assert name.startswith("2024-06-05_Office_A B long") and name.endswith(".pdf") and len(name) <= 184
    assert value(spark, files.canonical_filename(F.col("o"), F.col("s"), F.col("a"), F.col("d"), F.col("r")), o="scan.tif", s="", a="", d="", r="") == "scan.tif"
    out = value(spark, files.delivered_as(F.lit(b"\xff\xd8\xff\xe0"), F.col("n")), n="photo.jpg")
    assert (out["format"], out["output_name"], out["converted"]) == ("jpeg", "photo.pdf", True)


def test_messages(spark):
    assert value(spark, messages.escaped(F.col("t")), t=" a <b> & c ") == "a &lt;b&gt; &amp; c"
    tags = value(spark, messages.search_tags(F.col("c"), F.col("s"), {"x": ["one", "two"]}), c="x", s="The subject two words words")
    assert tags == ["one", "two", "subject", "words"]
    bad = value(spark, messages.stage_text(F.col("t"), {"a": "A"}), t="b")
    assert bad["text"] is None and bad["error"] == "unknown status: b"
    assert value(spark, messages.json_first(F.col("t"), ["$.a", "$.b.c"]), t='{"a": "", "b": {"c": "v"}}') == "v"
    merged = messages.merged_map(F.from_json("t", "map<string,string>"), F.from_json("u", "map<string,string>"), ["z"])
    assert value(spark, merged, t='{"a": "1", "z": "2"}', u='{"a": "3", "b": "4"}') == {"a": "3", "b": "4"}
    assert value(spark, messages.title(F.col("t")), t="school_name") == "School Name"
    assert value(spark, messages.evidence(F.col("t"), F.lit(None).cast("int"), F.lit("r1"), F.lit(None).cast("string")), t="s") == {"source": "s", "region_id": "r1"}


def test_rules_of_the_second_round(spark):
    lines = tx.text_lines(F.col("t"), strip_signs=True)
    council = "बिहार शिक्षा परियोजना परिषद शिक्षा विभाग की बैठक"
    assert value(spark, ex.rule_authority(lines, F.col("t")), t=council) == "बिहार शिक्षा परियोजना परिषद"
    assert value(spark, ex.script_authority(F.col("t")), t="Issued by: Office of X\nmore") == "Office of X"
    assert value(spark, ex.script_authority(F.col("t")), t="x\nBSEB, Patna") == "BSEB"
    assert value(spark, ex.script_authority(F.col("t")), t="nothing here") is None
    assert value(spark, ex.required_action(F.col("t")), t="Required action: send the list\nx") == "send the list"
    assert value(spark, ex.required_action(F.col("t")), t="This is URGENT.") == "Immediate action required"
    assert value(spark, ex.required_action(F.col("t")), t="plain") is None
    assert tuple(value(spark, ex.rule_category(F.col("t")), t="Admission notice of BSEB")) == ("admission", "Admission")
    assert tuple(value(spark, ex.rule_category(F.col("t")), t="bseb")) == ("bseb", "BSEB")
    assert tuple(value(spark, ex.rule_category(F.col("t")), t=None)) == ("other", "Other")
    assert value(spark, ex.taxonomy_key(F.col("t")), t="Payment / Fee") == "payment_fee" and value(spark, ex.taxonomy_key(F.col("t")), t="x") == "other"
    assert tuple(value(spark, ex.type_category(F.col("t"), F.lit("sure")), t="TRANSFER")) == ("other", "Transfer", "LOW")
    assert tuple(value(spark, ex.type_category(F.col("t"), F.lit("high")), t="data_submission")) == ("data_submission", "Data Submission", "HIGH")
    found = value(spark, ex.date_candidates(F.col("t")), t="a 31/02/2026, b 1-3-2026; 2026-01-05")
    assert [(d.text, d.start, d.end, d.valid) for d in found] == [("31/02/2026", 2, 12, False), ("1-3-2026", 16, 24, True), ("2026-01-05", 26, 36, True)]
    assert value(spark, ex.rule_subject(lines, F.col("t")), t="about Spot Admission now").startswith("सत्र 2026-28")
    i = value(spark, ex.document_intelligence(F.col("t"), offices={"east": ["East Office"], "west": ["West Office"]}), t="Subject: The training of staff\nfrom the east office")
    assert i.office.key == "east" and i.description == "यह दस्तावेज़ training संबंधी सूचना/निर्देश से संबंधित है: The training of staff from the east office."
