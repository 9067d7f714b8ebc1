"""Packing token ids into rows of fixed length: best fit decreasing with a segment tree over free capacities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.llm.common import checked_broadcast, schema_with, stored
from docweft.llm.tokenizers import encoder_for


class FreeSpace:
    """Segment tree over capacities 0..most: how many open rows have each free space, and the least that fits."""

    def __init__(self, most: int):
        self.size = 1
        while self.size < most + 1:
            self.size *= 2
        self.tree = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, row: int, free: int) -> None:
        self.rows[free].append(row)
        i = self.size + free
        while i:
            self.tree[i] += 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return the row with the least free space of ``need`` or more (its number and space), or None."""
        tree, i = self.tree, self.size + need
        if not tree[i]:
            # up to the first ancestor whose right neighbour has a row, then down to its leftmost leaf
            while i > 1 and (i & 1 or not tree[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        free = i - self.size
        row = self.rows[free].pop()
        while i:
            tree[i] -= 1
            i //= 2
        return row, free


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers. Items (each of 1 to ``capacity``) go longest first, ties in given order, each into the open row with the
    least space that fits, or into a new one."""
    space, rows = FreeSpace(capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = space.take(sizes[i])
        if found is None:
            row, free = len(rows), capacity
            rows.append([])
        else:
            row, free = found
        rows[row].append(i)
        if free > sizes[i]:
            space.put(row, free - sizes[i])
    return rows


PACKED = (
    "row long, n_tokens int, doc_ids array<{id}>, doc_starts array<int>, "
    "cu_seqlens array<int>, position_resets array<int>, token_ids binary"
)


def pack(
    docs: DataFrame,
    *,
    tokenizer: str,
    row_tokens: int = 2048,
    end_id: int | None = None,
    pad_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_bytes: int = 8_000_000,
) -> DataFrame:
    """Packed rows: ``shard, row, n_tokens, doc_ids, doc_starts, cu_seqlens, position_resets, token_ids``.

    Each document's ids (plus ``end_id`` if given) are cut into pieces of at most ``row_tokens``, without loss, and the pieces of a
    shard are packed best fit decreasing. ``token_ids`` is one line of the id matrix: ``row_tokens`` little-endian
    numbers (16 bits if all ids fit, else 32; ``id_bytes``), ``pad_id`` after the last piece. Piece i of a row is
    ``cu_seqlens[i]`` to ``cu_seqlens[i + 1]``, belongs to ``doc_ids[i]`` and begins at its token ``doc_starts[i]``; positions
    restart at 0 at each of ``position_resets``.

    Documents are dealt by the hash of their id and text to as many shards as keep each near ``shard_bytes`` of text, so
    that a task holds a few shards' ids one after another and no source or id is hot; equal rows that alone exceed a shard are numbered
    and dealt by their number too. A shard's rows depend on its documents only: they are sorted by id, then text. Documents without tokens have no piece.

    Null and empty texts have no tokens, null ids stay null in ``doc_ids``, rows that repeat an id or are equal throughout are packed
    like any others, very long texts are cut like long ones. Other columns are ignored; an empty table gives no rows.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-int(total) // shard_bytes))
    given = docs.where(F.octet_length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    given = given.withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    shard = lambda *x: F.pmod(F.xxhash64(*x), F.lit(shards)).cast("long").alias("shard")
    # rows that are equal and together too large for a shard: at most total / shard_bytes keys
    size = F.sum(F.octet_length("text").cast("long"))
    many = stored(given.groupBy("key").agg(F.count(F.lit(1)).alias("n"), size.alias("size")).where((F.col("n") > 1) & (F.col("size") > shard_bytes)).select("key"), "pack-equal")
    dealt = given.select(shard("key"), "doc_id", "text")
    if many.count():
        some = checked_broadcast(many)
        equal = given.join(some, "key", "left_semi").groupBy("key", "doc_id", "text").agg(F.count(F.lit(1)).alias("n"))
        spread = equal.select("key", "doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("number"))
        rest = given.join(some, "key", "left_anti").select(shard("key"), "doc_id", "text")
        dealt = rest.unionByName(spread.select(shard("key", "number"), "doc_id", "text"))
    kind = dealt.schema["doc_id"].dataType.simpleString()
    parts = max(1, min(shards, 100_000))
    dealt = dealt.repartition(parts, "shard").sortWithinPartitions("shard", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        encoder = encoder_for(tokenizer)
        shard, ids, texts, held = None, [], [], []

        def encode() -> None:
            """Keep ids instead of texts."""
            end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
            for i, data in zip(ids, encoder.ids_of(texts), strict=True):
                held.append((i, np.frombuffer(data + end, "<i4")))
            ids.clear()
            texts.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            encode()
            pieces = [(i, at, data[at : at + row_tokens]) for i, data in held for at in range(0, len(data), row_tokens)]
            held.clear()
            rows = best_fit_decreasing([len(p[2]) for p in pieces], row_tokens)
            for a in range(0, len(rows), 512):
                some = rows[a : a + 512]
                matrix = np.full((len(some), row_tokens), pad_id, "<i4")
                cols: dict[str, list] = {f.name: [] for f in fields}
                for k, row in enumerate(some):
                    cut = np.cumsum([0, *[len(pieces[p][2]) for p in row]]).tolist()
                    matrix[k, : cut[-1]] = np.concatenate([pieces[p][2] for p in row])
                    for c, v in (
                        ("shard", shard), ("row", a + k), ("n_tokens", cut[-1]), ("doc_ids", [pieces[p][0] for p in row]),
                        ("doc_starts", [pieces[p][1] for p in row]), ("cu_seqlens", cut), ("position_resets", cut[:-1]),
                    ):
                        cols[c].append(v)
                lines = matrix.astype(f"<u{width}")
                cols["token_ids"] = [x.tobytes() for x in lines]
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in fields], schema=fields)

        size = 0
        for batch in batches:
            for s, i, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if shard is not None:
                        yield from flush()
                    shard, size = s, 0
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > 1_000_000:
                    encode()
                    size = 0
        if shard is not None:
            yield from flush()

    width = id_bytes(tokenizer, end_id, pad_id)
    schema = schema_with(dealt.select("shard"), PACKED.format(id=kind))
    return dealt.mapInArrow(run, schema)


def id_bytes(tokenizer: str, end_id: int | None = None, pad_id: int = 0) -> int:
    """2 if every id of the tokenizer and the two given ones fit in 16 bits, else 4."""
    most = max(encoder_for(tokenizer).n_ids - 1, end_id or 0, pad_id)
    return 2 if most < 1 << 16 else 4


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a row's tokens: from 0 again in each piece."""
    cut = np.asarray(cu_seqlens)
    return np.arange(cut[-1]) - np.repeat(cut[:-1], np.diff(cut))


def unpack(rows: DataFrame, id_width: int) -> DataFrame:
    """The pieces of packed rows: ``doc_id, doc_start, token_ids array<int>``."""
    kind = rows.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for docs, starts, cut, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, f"<u{id_width}")
                out += [(d, s, ids[a:b].tolist()) for d, s, a, b in zip(docs, starts, cut, cut[1:], strict=False)]
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            kinds = (batch.schema.field("doc_ids").type.value_type, pa.int32(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "doc_start", "token_ids"])

    schema = T.StructType([T.StructField("doc_id", kind), *T.StructType.fromDDL("doc_start int, token_ids array<int>").fields])
    return rows.select("doc_ids", "doc_starts", "cu_seqlens", "token_ids").mapInArrow(run, schema)
