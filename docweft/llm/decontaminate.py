"""Benchmark decontamination: Wu-Manber multi-pattern search for 13-word windows of benchmark items in documents."""

from __future__ import annotations

import hashlib
import math
import uuid
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import checked_broadcast, map_texts, stored

WINDOW = 13
#: All bytes that are no part of a word become spaces; A-Z become a-z. Bytes from 0x80 on are parts of words.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class WuManber:
    """Search for the windows of one length, as word numbers.

    ``text`` has the words of all items, ``starts`` where windows begin in it. Blocks are the last ``b`` = min(2, length) words of a
    position. ``keys`` and ``shifts`` have, for each block that any window contains, how far the search may move (any other block:
    length - b + 1); where it is 0, the windows that end with the block are those of its stretch of ``suffixes``, in order of
    their first words (``prefixes``); these are compared word by word. All are sorted arrays; with the words' numbers they take about twelve
    bytes for each byte of item text while they are built.
    """

    def __init__(self, length: int, text: np.ndarray, begins: np.ndarray, sizes: np.ndarray, base: int):
        self.length, self.b, self.base = length, min(2, length), base
        self.most = length - self.b + 1
        self.text = array("i", text.tobytes())
        # a block that ends at word e of its item stands at the end of a window from word length - 1 on, else that far before one
        place = _ranges(sizes)
        ends = np.repeat(begins, sizes) + place
        blocks = ends[place >= self.b - 1]
        shift = np.maximum(0, length - 1 - place[place >= self.b - 1]).astype(np.int8)
        keys = self._keys(text, blocks - self.b + 1)
        order = np.lexsort((shift, keys))
        keys, shift = keys[order], shift[order]
        new = np.r_[True, keys[1:] != keys[:-1]]
        self.keys, self.shifts = array("q", keys[new].tobytes()), array("b", shift[new].tobytes())
        starts = np.repeat(begins, sizes - length + 1) + _ranges(sizes - length + 1)
        suffix, prefix = self._keys(text, starts + length - self.b), self._keys(text, starts)
        order = np.lexsort((starts, prefix, suffix))
        self.suffixes, self.prefixes = array("q", suffix[order].tobytes()), array("q", prefix[order].tobytes())
        self.starts = array("q", starts[order].astype(np.int64).tobytes())

    def _keys(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        first = text[at].astype(np.int64)
        return first * self.base + text[at + 1] if self.b == 2 else first

    def find(self, text: array, hit: bytearray, found: set[int]) -> None:
        """Mark the words of all occurrences in ``hit`` and add where their windows start to ``found``."""
        keys, shifts, most, m, b, base = self.keys, self.shifts, self.most, self.length, self.b, self.base
        end, n, size, ones = m, len(text), len(keys), b"\x01" * m
        while end <= n:
            last = text[end - 1]
            if last == UNKNOWN:  # no window has this word: the next one begins behind it
                end += m
                continue
            key = text[end - 2] * base + last if b == 2 else last
            i = bisect_left(keys, key)
            step = shifts[i] if i < size and keys[i] == key else most
            if step:
                end += step
                continue
            begin = end - m
            first = text[begin] * base + text[begin + 1] if b == 2 else text[begin]
            low = bisect_left(self.suffixes, key)
            high = bisect_right(self.suffixes, key, low)
            low = bisect_left(self.prefixes, first, low, high)
            window = text[begin:end]
            for k in range(low, bisect_right(self.prefixes, first, low, high)):
                s = self.starts[k]
                if self.text[s : s + m] == window:
                    hit[begin:end] = ones
                    found.add(s)
            end += 1


#: The number of words that no item has.
UNKNOWN = -1


def _ranges(sizes: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Search:
    """All windows of a set of items, one ``WuManber`` for each length that occurs. Each distinct word has a number."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]]):
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        named: dict[str | None, int] = {}
        text, begins, owners = array("i"), [], []
        for name, item in items:
            if not (w := words(item)):
                continue
            if name not in named:
                named[name] = len(self.names)
                self.names.append(name)
            begins.append(len(text))
            owners.append(named[name])
            text.extend(self.number.setdefault(x, len(self.number)) for x in w)
        self.begins, self.owners = array("q", begins), array("q", owners)
        whole = np.frombuffer(text, np.int32) if text else np.empty(0, np.int32)
        at = np.array(begins, np.int64)
        sizes = np.diff(np.r_[at, len(whole)])
        lengths = np.minimum(sizes, WINDOW)
        base = len(self.number) + 1
        self.tables = [WuManber(int(n), whole, at[lengths == n], sizes[lengths == n], base) for n in np.unique(lengths)]

    def __call__(self, text: str | None) -> tuple[int, bytearray, list[str]]:
        w = words(text)
        hit, found, number = bytearray(len(w)), set(), self.number
        numbers = array("i", [number.get(x, UNKNOWN) for x in w])
        for t in self.tables:
            t.find(numbers, hit, found)
        owners = {self.owners[bisect_right(self.begins, s) - 1] for s in found}
        return len(w), hit, sorted(self.names[i] for i in owners)


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def judged(n_words: int, n_hit: int, items: list[str]) -> tuple[int, int, int, str, bool]:
    digest = hashlib.sha256(",".join(items).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


#: The search of the broadcast that this process used last: tasks of one worker build it once.
_BUILT: dict[str, Search] = {}


def _search(sent: _Sent) -> Search:
    if sent.id not in _BUILT:
        _BUILT.clear()
        _BUILT[sent.id] = Search(sent.value["items"])
    return _BUILT[sent.id]


class _Sent:
    """Items under a name of their own, so that a worker knows whether it has built their search."""

    def __init__(self, docs: DataFrame, items: list[tuple]):
        self.sent = docs.sparkSession.sparkContext.broadcast({"items": items})
        self.id = uuid.uuid4().hex

    @property
    def value(self) -> dict:
        return self.sent.value


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    carry: list[str] | None = None,
    pattern_bytes: int = 32_000_000,
) -> DataFrame:
    """Carried columns, then ``n_words, n_hit, n_items, items_sha256, contaminated``; one row per input row.

    A window is 13 consecutive words of an item, or all of a shorter item's words. A document's word is
    hit if it lies in any occurrence of any window; the document is contaminated if some word is hit
    and hit words are a twentieth or more. Items are counted by id: rows that repeat an id are one item, a
    row with null id is left out, and items without words have no window. Null and empty texts have no words. Texts are searched
    whole, however long; repeated rows are judged alike; an empty table gives no rows, an empty benchmark no hits; a carried
    column named like a result is left out.

    The items are broadcast and each Python worker builds their tables once, sorted arrays that take
    about twelve bytes for each byte of item text while they are built; one scan serves all benchmarks up to ``pattern_bytes``.
    If the items' texts exceed ``pattern_bytes``, they are dealt by hash into as many parts as needed, each part is searched by
    itself, and the hit words of the few rows that have any are united.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / pattern_bytes))
    carry = [c for c in carry or [] if c not in T.StructType.fromDDL(RESULT).names]
    if parts > 1:
        return _in_parts(docs, items, parts, text_col, carry)
    sent = _Sent(docs, [tuple(r) for r in items.collect()])  # at most pattern_bytes

    def start():
        search = _search(sent)

        def score(texts):
            made = []
            for t in texts:
                n, hit, names = search(t)
                made.append(judged(n, hit.count(1), names))
            return list(zip(*made, strict=True)) if made else [[]] * 5

        return score

    return map_texts(docs, text_col, carry, RESULT, start)


def _in_parts(docs: DataFrame, items: DataFrame, parts: int, text_col: str, carry: list[str]) -> DataFrame:
    """As above with the items dealt into ``parts``; rows get a number that a written table fixes, and hit words travel as bitmaps."""
    n_words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0)).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("_dw_body"), n_words.alias("_dw_n"))
    rows = stored(rows.withColumn("_dw_row", F.monotonically_increasing_id()), "contamination-rows")
    found = None
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == k)
        sent = _Sent(docs, [tuple(r) for r in own.collect()])  # about pattern_bytes

        def start(sent=sent):
            search = _search(sent)

            def score(texts):
                made = [search(t) for t in texts]
                return [[np.packbits(np.frombuffer(m[1], np.uint8)).tobytes() for m in made], [m[2] for m in made]]

            return score

        one = map_texts(rows.select("_dw_row", "_dw_body"), "_dw_body", ["_dw_row"], "_dw_hit binary, _dw_items array<string>", start)
        one = one.where(F.size("_dw_items") > 0)
        found = one if found is None else found.unionByName(one)
    groups = found.groupBy("_dw_row").agg(
        F.collect_list("_dw_hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_dw_items")))).alias("names")
    )

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = []
            for hits in batch.column(1).to_pylist():
                bits = 0
                for h in hits:
                    bits |= int.from_bytes(h, "little")
                n_hit.append(bits.bit_count())
            digests = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in batch.column(2).to_pylist()]
            n_items = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_hit, pa.int64()), n_items, pa.array(digests)], names=["_dw_row", "_dw_n_hit", "_dw_n_items", "_dw_sha"])

    hits = stored(groups.mapInArrow(unite, "_dw_row long, _dw_n_hit long, _dw_n_items long, _dw_sha string"), "contamination-hits")
    n_hit = F.coalesce("_dw_n_hit", F.lit(0).cast("long"))
    return rows.join(checked_broadcast(hits), "_dw_row", "left").select(
        *[F.col(f"`{c}`") for c in carry], F.col("_dw_n").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("_dw_n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("_dw_sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("_dw_n"))).alias("contaminated"),
    )
