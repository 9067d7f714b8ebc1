"""Text normalisation as column functions (F1-F14). All are native expressions; null in gives null out unless stated."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions import fixed_values as fixed

#: White space as these rules mean it: ASCII white space and the no-break space.
EDGES = r"^[\s ]+|[\s ]+$"
#: A place where no word goes on, in any script: letters, marks and digits belong to words.
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once, however often ``then`` has it: a column that stands twice in a condition or a
    function of arrays is worked out twice, and what is built on it twice as often again."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def present(c: Column) -> Column:
    """Null for an empty text; the text is worked out once."""
    return F.get(F.filter(F.array(c), lambda x: x != ""), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


#: Decimal digits of all scripts but ASCII, and the ASCII digits that they stand for.
NATIVE_DIGITS = [chr(i) for i in range(128, sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]
PLAIN_DIGITS = "".join(str(unicodedata.decimal(x)) for x in NATIVE_DIGITS)


def ascii_digits(c: Column) -> Column:
    """Digits of any script as ASCII digits; for short values, not for whole texts."""
    return F.when(c.rlike(r"[\p{Nd}&&[^0-9]]"), F.translate(c, "".join(NATIVE_DIGITS), PLAIN_DIGITS)).otherwise(c)


def quoted(text: str) -> str:
    """A literal as a regular expression."""
    return "".join("\\" + x if x in r"\.[]{}()*+-?^$|" else x for x in text)


#: Letters beside A-Z that a pattern without regard to case takes for ASCII letters.
ODD_LETTERS = [("ı", "i"), ("ſ", "s"), ("İ", "i"), ("\u212a", "k")]
#: Patterns of ASCII and Devanagari literals, white space between them and alternatives: lower case alone decides whether they occur.
PLAIN = re.compile(r"(?:[ !\"#%&',/0-9:;<=>@A-Z_`a-z~|\u0900-\u097f-]|\\s[*+])+")


def caseless(c: Column) -> Column:
    """A text for ``occurs``: in lower case, the letters that case-blind patterns take for ASCII ones with them."""
    return F.lower(replaced(c, ODD_LETTERS))


def occurs(c: Column, low: Column, pattern: str) -> Column:
    """Whether a pattern occurs in ``c``, whatever the case. ``low`` is ``caseless(c)``: plain patterns are looked for there, as literals
    where they are; to compare without regard to case at every place of a text costs several times as much."""
    if not PLAIN.fullmatch(pattern):
        return c.rlike("(?iu)" + pattern)
    found = [F.lit(False)]
    for term in pattern.lower().split("|"):
        literal = re.split(r"\\s[*+]", term)  # the first piece is looked for before the whole
        found.append(low.contains(literal[0]) & low.rlike(term) if len(literal) > 1 else low.contains(term))
    return functools.reduce(lambda a, b: a | b, found)


def whole_word(terms: Sequence[str]) -> str:
    """A pattern for any of the terms as whole words, longest first."""
    return NOT_BEFORE + "(?:" + "|".join(quoted(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")" + NOT_AFTER


def clean_recognised(c: Column) -> Column:
    """no-break spaces, zero-width signs, blanks, line ends and runs of empty lines."""
    c = F.regexp_replace(F.translate(c, " ", " "), r"[​‌‍]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\r\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_control(c: Column) -> Column:
    """NUL to space, runs of blanks to one, three line ends or more to two, stripped."""
    c = F.regexp_replace(F.regexp_replace(c, r"\x00", " "), r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def line_whitespace(c: Column) -> Column:
    """one kind of line end, no zero-width space, single blanks, every line and the whole stripped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n")
    c = F.regexp_replace(F.translate(c, " ", " "), r"​", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"(?m)^[ \t]+|[ \t]+$", ""))


def replaced(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements one after another."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def longest_first(aliases: Mapping[str, str]) -> list[tuple[str, str]]:
    return sorted(aliases.items(), key=lambda p: -len(p[0]))


def unicode_equivalents(c: Column) -> Column:
    """F4."""
    return replaced(c, fixed.UNICODE_EQUIVALENTS)


def word_aliases(c: Column, aliases: Mapping[str, str]) -> Column:
    """known spellings to canonical words, longest first; only whole words, so that a second pass changes nothing."""
    for old, new in longest_first(aliases):
        if old != new:
            c = F.regexp_replace(c, whole_word([old]), new.replace("\\", r"\\").replace("$", r"\$"))
    return c


def label_aliases(c: Column, aliases: Mapping[str, str] = fixed.LABEL_ALIASES) -> Column:
    """label spellings, longest first, where no combining mark follows."""
    for old, new in longest_first(aliases):
        c = F.regexp_replace(c, quoted(old) + r"(?!\p{M})", new)
    return c


def phrase_aliases(c: Column, aliases: Mapping[str, str] = fixed.PHRASE_ALIASES) -> Column:
    """phrases, longest first, where no combining mark follows; then a repeated phrase is collapsed."""
    for old, new in longest_first(aliases):
        c = F.regexp_replace(c, quoted(old) + r"(?!\p{M})", new)
    whole, tail = fixed.REPEATED_PHRASE
    return F.regexp_replace(c, rf"{whole}(?:\s+{tail})+", whole)


def date_separators(c: Column) -> Column:
    """F8: ``d . m - yyyy`` to ``d/m/yyyy`` where no digit touches it; digits of any script, which stay as they are."""
    return F.regexp_replace(c, r"(?<!\p{Nd})(\p{Nd}{1,2})\s*[./-]\s*(\p{Nd}{1,2})\s*[./-]\s*(\p{Nd}{4})(?!\p{Nd})", "$1/$2/$3")


def punctuation(c: Column) -> Column:
    """full stops, colons and dashes of other scripts; no blank before a sign; a run of ``,;:`` to its last."""
    c = replaced(c, [("।", "."), ("ः", ":"), ("–", "-"), ("—", "-")])
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+([,.:;])", "$1"), r"[,;:]+([,;:])", "$1")


def normalise(c: Column, *, words: Mapping[str, str] | None = None) -> Column:
    """F3, F4, F5, F7, F6, F8, F9, F3. Phrases come before labels, because a label is part of one phrase."""
    c = word_aliases(unicode_equivalents(line_whitespace(c)), words or {})
    return line_whitespace(punctuation(date_separators(label_aliases(phrase_aliases(c)))))


def text_lines(c: Column, *, strip_signs: bool = False) -> Column:
    """non-empty lines with single blanks; optionally without colons and dashes at their ends."""
    edge = " :-–—" if strip_signs else " \u00a0"
    c = replaced(F.coalesce(c, F.lit("")), [("\t", " "), ("\x0b", " "), ("\f", " "), ("\r", "\n")])
    c = once(F.regexp_replace(c, " {2,}", " "), lambda one: _without_edges_before_ends(one, edge))
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(edge))), lambda x: x != "")


#: Signs that end a line for ``$`` but do not part lines here.
OTHER_ENDS = "\x85\u2028\u2029"


def _without_edges_before_ends(c: Column, edge: str) -> Column:
    """Edges before such a sign at a line's end go too, as ``$`` has it; most texts have none."""
    seen = functools.reduce(lambda a, b: a | b, [c.contains(x) for x in OTHER_ENDS])
    return F.when(seen, F.regexp_replace(c, rf"[{quoted(edge)}]+(?=[{OTHER_ENDS}](?:\n|\z))", "")).otherwise(c)


def header_lines(lines: Column, share: float = 0.22, least: int = 8) -> Column:
    """the first lines: a share of them, ``least`` at least."""
    return once(lines, lambda all_: F.slice(all_, 1, F.greatest(F.lit(least), F.floor(F.size(all_) * F.lit(share)).cast("int"))))


def folded(c: Column) -> Column:
    """for search and comparison: single blanks, stripped, lower case, sharp s as ss; null counts as empty."""
    return F.replace(F.lower(strip(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))), F.lit("ß"), F.lit("ss"))


def compact(c: Column) -> Column:
    """the folded text's ASCII letters and digits only."""
    return F.regexp_replace(folded(c), "[^a-z0-9]", "")
