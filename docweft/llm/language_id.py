"""Language ID by compression: the language whose zstandard raw-content dictionary encodes a text smallest."""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweft.llm.common import map_texts

#: What ends a word: anything but letters and the marks that follow them. Numerals such as ½ and ① are no letters.
NOT_LETTERS = regex.compile(r"(?:[^\p{L}\p{M}]+\p{M}*)+|^\p{M}+")
ASCII_LETTERS = bytes(c if 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Zeros after each block: they cost the same for every dictionary and keep short blocks from being stored raw.
FILLER = bytes(48)
#: Encoded sizes in bytes from which on a text has the least margin of its class.
CLASSES = [16 << i for i in range(10)]
#: Characters of a language, of rows kept out of its dictionary, that its margins are set from.
OUTSIDE = 200_000
#: Characters of one such row.
OUTSIDE_ROW = 16_384


def letters(text: str | None) -> bytes:
    """Lower-case words of letters (Unicode category L, with the marks on them), single-spaced, in UTF-8; empty without letters."""
    if not text or text.isascii():
        return b" ".join((text or "").encode().translate(ASCII_LETTERS).split())
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


class Model:
    """Per language: dictionary bytes, the number of training rows and, for each of ``CLASSES``, the least margin for
    each encoded byte that is not rejected (``calibrate``). ``langs`` is in order of preference on ties."""

    def __init__(self, dictionaries: dict[str, bytes], rows: dict[str, int], block: int = 8192):
        self.langs = sorted(dictionaries, key=lambda x: (-rows[x], x))
        self.dictionaries = [dictionaries[x] for x in self.langs]
        self.block = block
        self.least: dict[str, list[float]] = {}

    def needed(self, lang: str, size: int) -> float:
        """Least margin in bytes for a text of ``size`` encoded bytes; below the first class and without calibration only ties fail."""
        at = bisect_right(CLASSES, size) - 1
        return max(1.0, self.least[lang][at] * size) if at >= 0 and lang in self.least else 1.0

    def calibrate(self, margins: list[tuple[str, int, int]], share: float = 0.4, tail: float = 0.02) -> None:
        """Set ``least`` from (language, encoded bytes, margin) of rightly judged texts that no dictionary holds: ``share`` of the margin
        for each encoded byte that all but ``tail`` of a language's texts of a class reach. A class with under three texts has half of what the class below it has."""
        found: dict[tuple[str, int], list[float]] = {}
        for lang, size, margin in margins:
            found.setdefault((lang, bisect_right(CLASSES, size) - 1), []).append(margin / size)
        for lang in {x for x, _ in found}:
            self.least[lang], last = [], 0.0
            for at in range(len(CLASSES)):
                some = sorted(found.get((lang, at), []))
                last = share * some[int(tail * len(some))] if len(some) >= 3 else last / 2
                self.least[lang].append(last)

    def scorer(self):
        """A function from texts to (lang, score, margin in bytes, least encoded size)."""
        import zstandard as z

        # a coder's tables shrink with its dictionary, so that many languages take no more memory than 200
        less = max(0, 16 - max([self.block, *map(len, self.dictionaries)]).bit_length())
        params = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_LAZY2, min_match=4, window_log=17, hash_log=15 - less, chain_log=16 - less, search_log=3,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        coders = []
        for data in self.dictionaries:
            raw = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(compression_params=params)
            coders.append(z.ZstdCompressor(dict_data=raw, compression_params=params).compress)

        def one(text: str | None) -> tuple[str, float, int, int]:
            data = letters(text)
            if not data or not coders:
                return "und", 0.0, 0, 0
            blocks = [data[i : i + self.block] + FILLER for i in range(0, len(data), self.block)]
            sizes = [sum(len(encode(b)) for b in blocks) for encode in coders]
            least = min(sizes)
            best = sizes.index(least)
            margin = min((s for i, s in enumerate(sizes) if i != best), default=least + len(data)) - least
            score = 1 / sum(math.exp((least - s) * math.log(2)) for s in sizes)
            return self.langs[best], score, margin, least

        return one


def pieces(text: str | None, chars: int, at: int = 4) -> str:
    """At most ``chars`` characters of a text's letters: all, or a piece of each of ``at`` equal stretches from a hashed offset on."""
    plain = letters(text).decode()
    if len(plain) <= chars:
        return plain
    size, stretch = chars // at, len(plain) / at
    digest = hashlib.md5(plain.encode()).digest()
    begins = [int(i * stretch) + int.from_bytes(digest[2 * i : 2 * i + 2]) * int(stretch - size + 1) // 65_536 for i in range(at)]
    return " ".join(plain[b : b + size] for b in begins)


def taken_pieces(texts: list[str | None], chars: int) -> list[list]:
    """For each text whether it is kept out of the dictionaries (an eighth is), and its pieces: of ``chars`` characters, or of ``OUTSIDE_ROW``."""
    out = [hashlib.md5((t or "").encode("utf-8", "replace")).digest()[-1] < 32 for t in texts]
    return [out, [pieces(t, OUTSIDE_ROW if o else chars) for t, o in zip(texts, out, strict=True)]]


def fit(
    docs: DataFrame,
    *,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    rows_per_lang: int = 800,
    chars_per_row: int = 400,
    dictionary_bytes: int = 65_536,
    model_bytes: int = 200 * 65_536,
) -> Model:
    """Dictionaries from a bounded sample: for each language the ``rows_per_lang`` rows first in order of md5(id and text), of
    which each gives at most ``chars_per_row`` characters of its text to the dictionary (so no one row fills it).
    An eighth of them stays out: the margins of their texts set the least margins by language and size (``Model.calibrate``).

    A row's pieces come from hashed places of its whole text (``pieces``), so no shared opening fills a dictionary. Every
    label is learned, however few letters its rows have; beyond 200 of them ``model_bytes`` is shared among the dictionaries. Rows with null label or
    without letters teach nothing. The sample is chosen by bounded heaps in the tasks (a limit on row number by language).
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # by id and text, so that rows of one id, or without any, spread; rows equal in both are one place and teach once
    place = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), F.col(text_col)))
    known = known.select(F.col(lang_col).cast("string").alias("lang"), place.alias("place"), F.col(text_col).alias("text"))
    counted = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("place").alias("places")).collect()
    rows, places = {r["lang"]: r["n"] for r in counted}, {r["lang"]: r["places"] for r in counted}
    # many languages share the memory that 200 of the full size take
    dictionary_bytes = max(1024, min(dictionary_bytes, model_bytes // max(1, len(rows))))
    # the first hex digits of the digest keep about twice the rows needed, so that no window sees a whole language
    bounds = [(x, "g" if (b := math.ceil(4096 * 3 * (rows_per_lang + 10) / max(1, n))) >= 4096 else f"{max(1, b):03x}") for x, n in sorted(places.items())]
    bound = F.broadcast(docs.sparkSession.createDataFrame(bounds, "lang string, bound string"))  # a row for each language
    few = known.join(bound, "lang").where(F.substring("place", 1, 3) < F.col("bound")).drop("bound")
    pieces = map_texts(few, "text", ["lang", "place"], "kept_out boolean, piece string", lambda: lambda texts: taken_pieces(texts, chars_per_row))
    order = Window.partitionBy("lang").orderBy("place", "piece")
    taken = pieces.dropDuplicates(["lang", "place"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= rows_per_lang)
    text: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    outside: dict[str, str] = {}
    for r in taken.orderBy("lang", "at").toLocalIterator():
        if r["kept_out"] and places[r["lang"]] >= 16:
            if len(outside.get(r["lang"], "")) < OUTSIDE:
                outside[r["lang"]] = f"{outside.get(r['lang'], '')} {letters(r['piece']).decode()}".strip()
        elif size.get(r["lang"], 0) < dictionary_bytes and (data := letters(r["piece"])):
            text.setdefault(r["lang"], []).append(data)
            size[r["lang"]] = size.get(r["lang"], 0) + len(data) + 1
    joined = {x: b" ".join(t)[:dictionary_bytes] for x, t in text.items()}
    # a dictionary has eight bytes at least; fewer letters are repeated
    model = Model({x: t if len(t) >= 8 else b" ".join([t] * 8) for x, t in joined.items()}, rows)
    most = max(8, min(60, 1200 // max(1, len(outside))))
    cut = [(x, t[i : i + c]) for c in (16 << i for i in range(11)) for x, t in sorted(outside.items()) for i in range(0, min(len(t) - c + 1, most * c), c)]
    if cut:
        spark = docs.sparkSession
        tests = spark.createDataFrame(cut[::2] + cut[1::2], "lang string, text string").repartition(32)
        sent = spark.sparkContext.broadcast(model)

        def start():
            one = sent.value.scorer()

            def score(texts):
                made = [one(t) for t in texts]
                return [[m[k] for m in made] for k in (0, 2, 3)]

            return score

        judged = map_texts(tests, "text", ["lang"], "lang_pred string, margin long, size long", start)
        model.calibrate([(r["lang"], r["size"], r["margin"]) for r in judged.where("lang = lang_pred").collect()])  # a few texts a language and class
    return model


def identify(
    docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None, min_margin: int = 1
) -> DataFrame:
    """Carried columns, then ``lang_pred, score, margin, rejected``; one row per input row, no shuffle.

    The whole text is encoded in blocks with every dictionary. ``score`` is the smallest size's share of
    2 ** -size over all languages; ``margin`` the bytes between it and the next one. ``rejected`` is true
    where the margin is below ``min_margin`` bytes or below what the model needs for the language and the size of the text
    (``Model.needed``: texts of no learned language, or of several), and where there is nothing to encode: null text, or
    none with letters, is ``und`` with score 0. On a tie the language with more training rows is given.
    With an empty model every row is ``und``. Repeated rows are judged alike; an empty table gives no rows; a carried column
    named like a result is left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # about model_bytes

    def start():
        one = sent.value.scorer()

        def score(texts):
            made = [one(t) for t in texts]
            return [
                [m[0] for m in made],
                [m[1] for m in made],
                [m[2] for m in made],
                [m[0] == "und" or m[2] < max(min_margin, sent.value.needed(m[0], m[3])) for m in made],
            ]

        return score

    return map_texts(docs, text_col, carry or [], "lang_pred string, score double, margin long, rejected boolean", start)
