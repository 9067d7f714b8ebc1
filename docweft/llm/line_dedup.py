"""Line dedup over range-partitioned line digests: documents get compressed keep bitmaps, not new texts."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweft.llm.common import checked_broadcast, map_texts, schema_with, stored

BLANK = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[bytes]:
    """The key of each line: stripped of ASCII white space, A-Z in lower case. Null and empty texts have one empty line."""
    return [x.strip(BLANK) for x in (text or "").encode("utf-8", "replace").lower().split(b"\n")]


#: What a range says of a row: its key is frequent; counts of a range's first or last key; such a key's rows, which are
#: fewer than ``min_docs`` there; and, where first occurrences stay, the range's first row of a frequent or such a key.
FREQUENT, EDGE, HELD, FIRST, HELD_FIRST = range(5)


class _Run:
    """Rows of the current key, held back until ``min_docs`` have come."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.n, self.held, self.started = key, 0, [], False


def stream_range(
    part: int, batches: Iterator[pa.RecordBatch], schema: pa.Schema, min_docs: int, keep_first: bool
) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range (h1, h2, doc_id, text_key, n_lines, places); adds ``kind, part, n``."""
    run: _Run | None = None
    first_key, out = None, []

    def put(kind: int, rows: pa.RecordBatch) -> None:
        extra = [pa.array([v] * len(rows), t) for v, t in ((kind, pa.int32()), (part, pa.int32()), (0, pa.int64()))]
        kept = [c.cast(f.type) for c, f in zip(rows.columns, schema, strict=False)]
        out.append(pa.RecordBatch.from_arrays(kept + extra, schema=schema))

    def put_rows(run: _Run, rows: pa.RecordBatch, rest: int, first: int) -> None:
        if keep_first and not run.started:
            put(first, rows.slice(0, 1))
            rows = rows.slice(1)
        run.started = True
        if len(rows):
            put(rest, rows)

    def close(run: _Run, edge: bool) -> None:
        if not edge:
            return
        row = [[run.key[0]], [run.key[1]], *[[None]] * (len(schema) - 5), [EDGE], [part], [run.n]]
        out.append(pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema))
        for rows in run.held:
            put_rows(run, rows, HELD, HELD_FIRST)

    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
        sizes = np.diff(np.r_[starts, len(h1)])
        # keys that begin and end in the batch and are too rare need no look at all
        looked = np.flatnonzero(sizes >= min_docs).tolist()
        for j in sorted({0, len(starts) - 1, *looked}):
            key = int(h1[starts[j]]), int(h2[starts[j]])
            if run is None or run.key != key:
                if run is not None:
                    close(run, run.key == first_key)
                first_key = first_key or key
                run = _Run(key)
            rows = batch.slice(int(starts[j]), int(sizes[j]))
            run.n += len(rows)
            if run.n < min_docs:
                run.held.append(rows)
                continue
            for r in [*run.held, rows]:
                put_rows(run, r, FREQUENT, FIRST)
            run.held = []
        if len(out) >= 200:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()
            out.clear()
    if run is not None:
        close(run, True)
    if out:
        yield from pa.Table.from_batches(out).combine_chunks().to_batches()


def line_drops(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_chars: int = 1,
    keep_first: bool = False,
    lines_per_range: int = 250_000,
) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: ``doc_id, text_key, n_lines, n_dropped, keep_bitmap``.

    A key of ``min_chars`` code points or more that ``min_docs`` documents have loses all its lines, or,
    with ``keep_first``, all but the first in order of document and position. A document that is not in the result
    keeps all its lines. ``text_key`` (xxhash64 of the text) tells documents with the same id apart; every
    row counts as a document. ``keep_bitmap`` is zlib of one bit a line, 1 for keep, least significant bit first.

    Each row of ``docs`` gives one row for each distinct key (128-bit digest, id, positions). These are range-partitioned by
    digest and document, so that a key of any frequency spreads over many ranges, and sorted in them; each range is
    streamed once with fewer than ``min_docs`` rows of the current key in memory. Only a range's first and
    last key can reach into others: their counts (two rows a range) are summed by digest, and the few held-back
    rows of those keys join the sums. Text is not shuffled. With ``keep_first``, rows that repeat id and text are one
    document. Null ids are ids like others (their rows are told apart by text), texts are split whole, however long, null and empty texts
    are one empty line. Other columns of ``docs`` are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("body"))
    entry = "h1: bigint, h2: bigint, places: array<int>"

    def start():
        def score(texts):
            sizes, entries = [], []
            for t in texts:
                places: dict[bytes, list[int]] = {}
                keys = line_keys(t)
                for i, k in enumerate(keys):
                    if len(k) >= min_chars and (min_chars <= 1 or len(k.decode("utf-8", "replace")) >= min_chars):
                        places.setdefault(k, []).append(i)
                sizes.append(len(keys))
                made = []
                for k, at in places.items():
                    d = xxhash.xxh3_128_digest(k)
                    made.append({"h1": int.from_bytes(d[:8], "big", signed=True), "h2": int.from_bytes(d[8:], "big", signed=True), "places": at})
                entries.append(made)
            return [sizes, entries]

        return score

    made = map_texts(rows, "body", ["doc_id", "text_key"], f"n_lines int, entries array<struct<{entry}>>", start)
    lines = made.select("doc_id", "text_key", "n_lines", F.explode("entries").alias("e"))
    lines = lines.select("e.h1", "e.h2", "doc_id", "text_key", "n_lines", "e.places")
    if keep_first:
        lines = lines.dropDuplicates(["h1", "h2", "doc_id", "text_key"])
    lines = stored(lines, "line-digests")
    ranges = min(50_000, max(1, -(-lines.count() // lines_per_range)))  # more would burden the driver
    ordered = lines.repartitionByRange(ranges, "h1", "h2", "doc_id", "text_key").sortWithinPartitions("h1", "h2", "doc_id", "text_key")
    out = schema_with(lines, "kind int, part int, n long")

    def stream(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        return stream_range(TaskContext.get().partitionId(), batches, to_arrow_schema(out), min_docs, keep_first)

    streamed = stored(ordered.mapInArrow(stream, out), "line-runs")
    edges = streamed.where(F.col("kind") == EDGE).groupBy("h1", "h2")
    edges = edges.agg(F.sum("n").alias("total"), F.min("part").alias("opens")).where(F.col("total") >= min_docs)
    edges = checked_broadcast(stored(edges, "line-edges"))  # two rows a range at most
    later = F.when(F.col("part") > F.col("opens"), F.col("places")).otherwise(F.expr("slice(places, 2, size(places))"))
    cols = ["doc_id", "text_key", "n_lines", "places"]
    dropped = streamed.where(F.col("kind") == FREQUENT).select(*cols)
    held = streamed.where(F.col("kind") == HELD).join(edges, ["h1", "h2"])
    first = streamed.where(F.col("kind") == FIRST).join(edges, ["h1", "h2"], "left").withColumn("places", later)
    held_first = streamed.where(F.col("kind") == HELD_FIRST).join(edges, ["h1", "h2"]).withColumn("places", later)
    for more in (held, first, held_first):
        dropped = dropped.unionByName(more.select(*cols))
    # a set: rows that repeat id and text give each key's places again, and only once are they held
    by_doc = dropped.groupBy("doc_id", "text_key", "n_lines").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"))
    by_doc = by_doc.where(F.size("places") > 0)

    def bitmaps(batches):
        for batch in batches:
            maps = []
            for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, bool)
                keep[at] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
            n_dropped = pa.array([len(x) for x in batch.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), n_dropped, pa.array(maps, pa.binary())],
                names=["doc_id", "text_key", "n_lines", "n_dropped", "keep_bitmap"],
            )

    return by_doc.mapInArrow(bitmaps, schema_with(by_doc.drop("places"), "n_dropped int, keep_bitmap binary"))


def kept_lines(text: str | None, keep_bitmap: bytes | None, n_lines: int) -> list[str]:
    """The lines that a bitmap keeps; all of them without one."""
    lines = (text or "").split("\n")
    if keep_bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(keep_bitmap), np.uint8), count=n_lines, bitorder="little")
    return [x for x, k in zip(lines, keep.tolist(), strict=True) if k]


def with_bitmaps(docs: DataFrame, drops: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 64_000_000) -> DataFrame:
    """``doc_id, text, keep_bitmap`` for every row of ``docs``; ``drops`` is broadcast if its bytes are few, else shuffled."""
    drops = stored(drops.select("doc_id", "text_key", "keep_bitmap"), "line-bitmaps")
    size = drops.agg(F.sum(F.length("keep_bitmap") + 64)).first()[0] or 0
    drops = (F.broadcast(drops) if size <= broadcast_bytes else drops).alias("k")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.text_key") == F.col("k.text_key"))
    return rows.join(drops, same, "left").select("d.doc_id", "d.text", "k.keep_bitmap")


def line_digests(rows: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` of rows with bitmaps."""

    def run(batches):
        for batch in batches:
            made = []
            for text, bitmap in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = (text or "").count("\n") + 1
                kept = kept_lines(text, bitmap, n)
                made.append((n, n - len(kept), hashlib.sha256("\n".join(kept).encode("utf-8", "replace")).hexdigest()))
            cols = list(zip(*made, strict=True)) if made else [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return rows.mapInArrow(run, schema_with(rows.select("doc_id"), "n_lines long, n_dropped long, kept_sha256 string"))
