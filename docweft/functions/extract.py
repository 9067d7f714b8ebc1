"""Field extraction as column functions (F15-F36, A9). Arrays of lines come from ``text.text_lines``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import fixed_values as fixed
from docweft.functions.text import NOT_AFTER, ascii_digits, caseless, header_lines, occurs, once, present, quoted, strip, text_lines

SIGNS = r"^[ :\-–—\t]+|[ :\-–—\t]+$"
DATE = r"(?<![\p{L}\p{N}_])(\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{2,4})(?![\p{L}\p{N}_])"
FULL_DATE = r"(?<![\p{L}\p{N}_])\p{Nd}{1,2}[./-]\p{Nd}{1,2}[./-]\p{Nd}{4}(?![\p{L}\p{N}_])"


def first_match(c: Column, patterns: Sequence[str]) -> Column:
    """group 1 of the first pattern that has a non-empty one, stripped."""
    return F.coalesce(*[present(strip(F.regexp_extract(c, "(?iu)" + p, 1))) for p in patterns], F.lit(None).cast("string"))


def first_of(lines: Column, test) -> Column:
    """The first line that passes, or null."""
    return F.get(F.filter(lines, test), F.lit(0))


def labelled_line(lines: Column, labels: Sequence[str], longest: int = 700) -> Column:
    """F16: what follows a label at a line's start; if nothing does, the next line. Longer values are skipped; null if none.

    A label ends where no letter goes on. ``labels`` are patterns.
    """
    pattern = rf"(?iu)^(?:{'|'.join(labels)}){NOT_AFTER}\s*[:\-–—]?\s*(.*)$"

    def first_value(all_: Column) -> Column:
        own = lambda x: present(F.regexp_replace(F.regexp_extract(x, pattern, 1), SIGNS, ""))
        found = F.transform(all_, lambda x, i: F.when(x.rlike(pattern), F.coalesce(own(x), F.get(all_, i + 1))))
        return first_of(found, lambda v: (v != "") & (F.length(v) <= longest))

    return once(lines, first_value)


def before(c: Column, words: Sequence[str]) -> Column:
    """The text before the first of the words (with white space before it)."""
    return F.regexp_replace(c, rf"(?isu)\s+(?:{'|'.join(words)})\s*[:\-–—]?.*$", "")


def reference_number(lines: Column) -> Column:
    """the labelled reference without a date behind it, 250 characters at most."""
    return present(F.left(strip(before(labelled_line(lines, fixed.REFERENCE_LABELS, 250), fixed.DATE_LABELS)), F.lit(250)))


def printed_date(lines: Column, text: Column) -> Column:
    """the date in a labelled line, else the first in the text, as printed."""
    return F.coalesce(
        present(F.regexp_extract(labelled_line(lines, fixed.DATE_LABELS, 100), DATE, 1)), present(F.regexp_extract(text, DATE, 1))
    )


def script_reference(c: Column) -> Column:
    """F17, script version: the letters, digits and signs that follow a reference label, else those after a plain number label."""
    return first_match(c, fixed.REFERENCE_PATTERNS)


def script_date(c: Column) -> Column:
    """F18, script version: the labelled date, in figures or with the month's name, else the first date in figures, as printed."""
    return F.coalesce(first_match(c, fixed.DATE_PATTERNS), present(F.regexp_extract(c, DATE, 1)))


def normalised_date(c: Column) -> Column:
    """d/m/y (or with dots or dashes, digits of any script; two-digit years are 20yy) as a date; null for anything else and
    impossible days."""
    pattern = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{2}|\d{4})$"
    c = ascii_digits(strip(c))
    year = F.regexp_extract(c, pattern, 3)
    year = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    whole = F.concat_ws("/", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2), year)
    return F.when(c.rlike(pattern), F.try_to_date(whole, "d/M/yyyy"))


def date_candidates(c: Column) -> Column:
    """all day-first, then all year-first dates with their offsets and calendar validity: array of (text, start, end, valid).

    Digits may be of any script and are given as they stand."""
    edge, end = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    length = lambda parts: F.aggregate(parts, F.lit(0), lambda n, x: n + F.length(x))

    def judged(pattern: str, form: str) -> Column:
        found, between = F.regexp_extract_all(c, F.lit(f"({edge}{pattern}{end})"), 1), F.split(c, edge + pattern + end, -1)
        as_date = lambda x: F.try_to_date(F.translate(ascii_digits(x), "-", "/"), form)

        def one(x: Column, i: Column) -> Column:
            start = length(F.slice(between, F.lit(1), i + 1)) + length(F.slice(found, F.lit(1), i))
            return F.struct(x.alias("text"), start.alias("start"), (start + F.length(x)).alias("end"), as_date(x).isNotNull().alias("valid"))

        return F.transform(found, one)

    return F.concat(judged(r"\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{4}", "d/M/yyyy"), judged(r"\p{Nd}{4}[/-]\p{Nd}{1,2}[/-]\p{Nd}{1,2}", "yyyy/M/d"))


def date_signals(candidates: Column) -> Column:
    """F21."""
    return F.struct(
        F.exists(candidates, lambda d: d["valid"]).alias("has_valid_date"), F.exists(candidates, lambda d: ~d["valid"]).alias("has_invalid_date")
    )


def official_subject(lines: Column, fallback: Column | None = None) -> Column:
    """(value, source, confidence): the first subject label whose text, with up to four lines until a stop label, has
    8 to 500 characters; else the fallback; else nothing."""
    label = rf"(?iu)^(?:{'|'.join(sorted(fixed.SUBJECT_LABELS[:3], key=len, reverse=True))}){NOT_AFTER}\s*[:：\-–—]?\s*(.*)$"
    stop = rf"(?iu)^(?:(?:{'|'.join(map(quoted, fixed.SUBJECT_STOPS))}){NOT_AFTER}|\d+[.)]\s+)"

    def folded_line(a: Column, x: Column) -> Column:
        return once(a["over"] | x.rlike(stop), lambda over: F.struct(F.when(over, a["text"]).otherwise(F.concat(a["text"], F.lit(" "), x)).alias("text"), over.alias("over")))

    def value(all_: Column, p: Column) -> Column:
        rest = F.slice(all_, p["i"] + 2, 4)
        # lines after the first stop are dropped by folding with a flag
        taken = F.aggregate(rest, F.struct(F.lit("").alias("text"), F.lit(False).alias("over")), folded_line)["text"]
        own = F.regexp_replace(F.regexp_extract(p["line"], label, 1), SIGNS, "")
        return strip(F.regexp_replace(F.concat(own, taken), r"\s+", " "))

    fits = lambda v: v.isNotNull() & F.length(v).between(8, 500)

    def first_value(all_: Column) -> Column:
        numbered = F.transform(all_, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
        return F.get(F.filter(F.transform(F.filter(numbered, lambda p: p["line"].rlike(label)), lambda p: value(all_, p)), fits), F.lit(0))

    def judged(found: Column, fall: Column) -> Column:
        return F.struct(
            F.when(found.isNotNull(), found).when(fits(fall), fall).alias("value"),
            F.when(found.isNotNull(), "subject_label").when(fits(fall), "normalized_subject").alias("source"),
            F.when(found.isNotNull(), "HIGH").when(fits(fall), "MEDIUM").otherwise("LOW").alias("confidence"),
        )

    fall = strip(fallback) if fallback is not None else F.lit(None).cast("string")
    return once(once(lines, first_value), lambda found: once(fall, lambda f: judged(found, f)))


def rule_subject(lines: Column, text: Column | None = None, special: tuple[str, str] = fixed.SPECIAL_SUBJECT) -> Column:
    """the labelled subject up to another label, else the special subject if its pattern is in ``text``, else the first line
    of 15 to 220 characters that speaks of a matter."""
    own = present(F.left(F.regexp_replace(before(labelled_line(lines, fixed.SUBJECT_LABELS, 1000), fixed.AFTER_SUBJECT), SIGNS, ""), F.lit(1000)))
    line = first_of(lines, lambda x: F.length(x).between(15, 220) & x.rlike("(?iu)" + fixed.MATTER_WORDS) & ~x.rlike("(?iu)" + fixed.OTHER_LABELS))
    by_text = F.when(text.rlike("(?iu)" + special[0]), F.lit(special[1])) if text is not None else F.lit(None).cast("string")
    return F.coalesce(own, by_text, line)


def script_subject(c: Column) -> Column:
    """F23, script version: 5 to 500 characters behind a subject label, cleaned."""
    return present(clean_field(first_match(c, fixed.SUBJECT_PATTERNS)))


def header_authority(lines: Column, hints: Sequence[str] = fixed.AUTHORITY_HINTS) -> Column:
    """(value, source, confidence) of the first header line that names a known office."""
    found = first_of(header_lines(lines), lambda x: once(F.lower(x), lambda low: _any_contained(low, hints)))
    return once(
        found,
        lambda hit: F.struct(
            F.left(hit, F.lit(300)).alias("value"),
            F.when(hit.isNotNull(), "header").alias("source"),
            F.when(hit.isNotNull(), "HIGH").otherwise("LOW").alias("confidence"),
        ),
    )


def _any_contained(low: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | low.contains(t.lower())
    return out


def rule_authority(lines: Column, text: Column, known: Sequence[str] = fixed.KNOWN_AUTHORITIES) -> Column:
    """the labelled sender unless it holds another label; else a known office in the text; else a short office-like line
    among the first 80."""
    own = labelled_line(lines, fixed.AUTHORITY_LABELS, 500)
    own = once(own, lambda o: F.when(~o.rlike(r"(?iu)विषय|subject|पत्रांक|दिनांक|reference|memo"), o))
    named = once(F.lower(text), lambda low: F.coalesce(*[F.when(low.contains(k.lower()), F.lit(k)) for k in known], F.lit(None).cast("string")))
    like = lambda words: "(?iu)" + "|".join(map(quoted, words))
    line = first_of(
        F.slice(lines, 1, 80),
        lambda x: (F.length(x) <= 180) & ~x.rlike(like(fixed.NOT_OFFICE_WORDS)) & x.rlike(like(fixed.OFFICE_WORDS)),
    )
    return F.coalesce(own, named, line)


def script_authority(c: Column) -> Column:
    """F25, script version: what follows an issuing label, else from a known kind of office on to the line's end; without
    a greeting in front, under its canonical name; null if nothing is left."""
    found = present(clean_field(first_match(c, fixed.AUTHORITY_PATTERNS)))
    return authority_name(present(strip(F.regexp_replace(found, "(?iu)" + fixed.GREETINGS, ""))))


def authority_name(c: Column) -> Column:
    """the canonical name of an office, the stripped value if no rule knows it."""

    def named(given: Column) -> Column:
        out = strip(given)
        for pattern, name in reversed(fixed.AUTHORITY_NAMES):
            out = F.when(given.rlike("(?iu)" + pattern), F.lit(name)).otherwise(out)
        return out

    return once(c, named)


def deadlines(c: Column, most: int = 12) -> Column:
    """distinct full dates in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({FULL_DATE})"), 1)), 1, most)


def deadline(c: Column) -> Column:
    """(value, source): a labelled deadline, else any labelled date."""
    labelled, any_label = fixed.DEADLINE_PATTERNS
    both = lambda value, source: F.struct(value.alias("value"), F.when(value.isNotNull(), source).alias("source"))
    any_date = lambda: once(first_match(c, [any_label]), lambda found: both(found, "fallback"))
    return once(first_match(c, [labelled]), lambda last: F.when(last.isNotNull(), both(last, "label")).otherwise(any_date()))


def action_lines(lines: Column, most: int = 5) -> Column:
    """lines that ask for something."""
    asks = "(?iu)" + "|".join(f"(?:{p})" for p in fixed.ACTION_PATTERNS)
    return F.slice(F.transform(F.filter(lines, lambda x: x.rlike(asks)), lambda x: F.left(x, F.lit(500))), 1, most)


def required_action(c: Column) -> Column:
    """what follows words that ask for an action, else a standing text where the letter is urgent, else null."""
    asked = present(clean_field(first_match(c, [fixed.REQUIRED_ACTION])))
    return F.coalesce(asked, F.when(c.rlike("(?iu)" + fixed.IMMEDIATE), F.lit(fixed.IMMEDIATE_ACTION)))


def priority(c: Column) -> Column:
    """F29."""
    return once(caseless(c), lambda low: F.when(occurs(c, low, fixed.URGENT), "HIGH").otherwise("NORMAL"))


def category(c: Column, cascade: Sequence[tuple[str, str]] = fixed.CATEGORY_CASCADE) -> Column:
    """the first category whose pattern occurs, else Other."""

    def named(low: Column) -> Column:
        out = F.lit("Other")
        for pattern, name in reversed(cascade):
            out = F.when(occurs(c, low, pattern), F.lit(name)).otherwise(out)
        return out

    return once(caseless(c), named)


def rule_category(c: Column, rules: Sequence[tuple[str, str, str]] = fixed.CATEGORY_RULES) -> Column:
    """F30, rule version: (key, label) of the first rule whose pattern occurs, else other."""
    both = lambda key, label: F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"))
    out = both("other", "Other")
    for pattern, key, label in reversed(rules):
        out = F.when(F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False)), both(key, label)).otherwise(out)
    return out


def filled_confidence(fields: Sequence[Column]) -> Column:
    """HIGH from four filled fields on, MEDIUM from two."""
    n = sum((F.when(present(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))
    return once(n, lambda filled: F.when(filled >= 4, "HIGH").when(filled >= 2, "MEDIUM").otherwise("LOW"))


def rule_confidence(subject: Column, printed: Column, authority: Column) -> Column:
    """F31, rule version: HIGH with a subject and a date or an authority, else MEDIUM."""
    dated = present(printed).isNotNull() | present(authority).isNotNull()
    return F.when(present(subject).isNotNull() & dated, "HIGH").otherwise("MEDIUM")


def _listed(c: Column, values: Mapping[str, str]) -> Column:
    listed = F.create_map(*[F.lit(x) for pair in values.items() for x in pair]) if values else F.lit(None).cast("map<string,string>")
    return F.try_element_at(listed, c)


def taxonomy_key(label: Column, keys: Mapping[str, str] = fixed.TAXONOMY_KEYS) -> Column:
    """F32: the key of a label whatever its case, ``other`` for one that is not listed or null."""
    return F.coalesce(_listed(F.lower(label), keys), F.lit("other"))


def type_category(kind: Column, confidence: Column, keys: Mapping[str, str] = fixed.TAXONOMY_KEYS, labels: Mapping[str, str] = fixed.TYPE_LABELS) -> Column:
    """F32: (key, label, confidence) of a document type: only a key of the taxonomy is given, else other; the label is the type's own, or
    its name in title case; a confidence that is none of HIGH, MEDIUM, LOW is LOW."""
    kind = F.coalesce(present(F.lower(strip(kind))), F.lit("other"))
    sure = F.upper(F.coalesce(present(confidence), F.lit("LOW")))
    return F.struct(
        F.when(kind.isin(*keys.values()), kind).otherwise("other").alias("key"),
        F.coalesce(_listed(kind, labels), F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))).alias("label"),
        F.when(sure.isin("HIGH", "MEDIUM", "LOW"), sure).otherwise("LOW").alias("confidence"),
    )


def merged_field(found: Column, found_confidence: Column, rule: Column) -> Column:
    """(value, source, confidence): the evidence-based value if there is one, else the rule's."""
    rule, found = present(rule), present(found)
    return F.struct(
        F.coalesce(found, rule).alias("value"),
        F.when(found.isNotNull(), "intelligence").when(rule.isNotNull(), "rule").alias("source"),
        F.when(found.isNotNull(), found_confidence).when(rule.isNotNull(), "MEDIUM").otherwise("LOW").alias("confidence"),
    )


def short_description(lines: Column) -> Column:
    """the first two lines of 15 characters or more that are no address, 500 characters at most; null if none."""
    useful = F.filter(lines, lambda x: (F.length(x) >= 15) & ~x.rlike(r"(?iu)^https?://"))
    return present(F.left(F.array_join(F.slice(useful, 1, 2), " "), F.lit(500)))


def script_description(lines: Column, subject: Column, authority: Column) -> Column:
    """F34, script version: the subject, else the first useful lines, else a sentence on the authority; null without any."""
    sender = F.concat(F.lit(fixed.DESCRIPTION_OF_SENDER), present(authority))
    return F.coalesce(present(subject), short_description(lines), sender)


def detailed_description(filename: Column, subject: Column, authority: Column, printed: Column) -> Column:
    """F34, detailed: the file's name, then subject, authority and date, or for each that it was not found."""
    said = [
        F.coalesce(F.concat(F.lit(before), present(value), F.lit(". ")), F.lit(missing))
        for value, (before, missing) in zip((subject, authority, printed), fixed.DETAILED_PARTS, strict=True)
    ]
    first, rest = fixed.DETAILED_FRAME
    return F.concat(F.lit(first[0]), F.coalesce(filename, F.lit("")), F.lit(first[1]), *said, F.lit(rest))


def templated_description(subject: Column, actions: Column, category: Column) -> Column:
    """F34, templated: subject and first action (220 characters at most), or category and subject; null without a subject."""
    subject = F.regexp_replace(present(subject), r"\.+$", "")
    first = F.get(actions, F.lit(0))
    a, b, end = map(F.lit, fixed.DESCRIPTION_WITH_ACTION)
    x, y, z = map(F.lit, fixed.DESCRIPTION_PLAIN)
    return F.when(first.isNotNull(), F.concat(a, subject, b, F.left(first, F.lit(220)), end)).otherwise(F.concat(x, category, y, subject, z))


def clean_field(c: Column) -> Column:
    """F35."""
    return F.left(strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"^[\s:：.\-]+|[\s:：.\-]+$", "")), F.lit(500))


def document_type(c: Column, rules: Mapping[str, Sequence[str]] = fixed.TYPE_RULES) -> Column:
    """(value, evidence, confidence): the type with the most terms in the text, the first listed on ties."""
    names = list(rules)

    def counted(low: Column) -> Column:
        hits = [sum((low.contains(t.lower()).cast("int") for t in rules[k]), F.lit(0)) for k in names]
        return F.array(*[F.struct(h.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("name")) for i, (k, h) in enumerate(zip(names, hits, strict=True))])

    def judged(all_: Column, best: Column) -> Column:
        return F.struct(
            F.when(best["score"] > 0, best["name"]).otherwise("other").alias("value"),
            F.transform(F.filter(all_, lambda h: h["score"] > 0), lambda h: h["name"]).alias("evidence"),
            F.when(best["score"] >= 2, "HIGH").when(best["score"] == 1, "MEDIUM").otherwise("LOW").alias("confidence"),
        )

    counts = once(F.lower(F.coalesce(c, F.lit(""))), counted)
    return once(counts, lambda all_: once(F.array_max(all_), lambda best: judged(all_, best)))


def document_intelligence(c: Column, normalised_subject: Column | None = None, offices: Mapping[str, Sequence[str]] | None = None) -> Column:
    """authority, subject, type, actions, deadlines, the office that a vocabulary knows (A11) and the templated description of
    a text as one struct, without Python."""
    from docweft.operators.vocab import resolve

    def found(lines: Column) -> Column:
        return F.struct(
            lines.alias("lines"), official_subject(lines, normalised_subject).alias("subject"), document_type(c).alias("kind"), action_lines(lines).alias("actions")
        )

    def told(x: Column) -> Column:
        return F.struct(
            header_authority(x["lines"]).alias("authority"),
            x["subject"].alias("subject"),
            x["kind"].alias("document_type"),
            x["actions"].alias("actions"),
            deadlines(F.coalesce(c, F.lit(""))).alias("deadlines"),
            resolve(F.coalesce(c, F.lit("")), offices or {}).alias("office"),
            templated_description(x["subject"]["value"], x["actions"], x["kind"]["value"]).alias("description"),
        )

    return once(once(text_lines(c), found), told)


def heading_kind(c: Column) -> Column:
    """heading_signal, body or unknown: a numbered or lettered line, or one that begins with a heading label."""
    text = strip(F.coalesce(c, F.lit("")))
    label = rf"(?iu)^(?:[0-9]+[.)]|[क-ह][.)]|[A-Z][.)]|(?:{'|'.join(fixed.HEADING_LABELS)}){NOT_AFTER})"
    return F.when(text == "", "unknown").when(text.rlike(label), "heading_signal").otherwise("body")

