"""What the operators of this subpackage share: tables, the shared folder, size checks, text mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweft.operators.joins import checked_broadcast, stored, table_bytes, with_totals  # noqa: F401
from docweft.sources.io import shared_dir, spread  # noqa: F401

#: Texts are handed to a scorer in slices of about this many characters.
SLICE_CHARS = 2_000_000


#: Rows in an Arrow batch: ten thousand texts, Spark's default, are too many for small executors.
BATCH_ROWS = 2_000


def tuned(spark: SparkSession) -> SparkSession:
    """The session with batches of texts that fit small executors; jobs call this once, operators leave the session alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """True for the rows whose crc32 of the id as text leaves ``fold`` modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def schema_with(df: DataFrame, fields: str) -> T.StructType:
    """The schema of ``df`` with further fields (a DDL string)."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(fields).fields])


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` characters, one row at least."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def map_texts(
    docs: DataFrame,
    text_col: str,
    carry: Sequence[str],
    results: str,
    start: Callable[[], Callable[[list[str | None]], list[Sequence]]],
) -> DataFrame:
    """One output row for each row of ``docs``: the carried columns, then what the scorer gives for the text.

    ``start`` runs once in a task and returns the scorer, which takes a list of texts and returns one
    sequence for each field of ``results`` (a DDL string). A carried column named like a result is left out.
    """
    names = T.StructType.fromDDL(results).names
    carry = [c for c in carry if c not in names]
    kept = docs.select(*[F.col(f"`{c}`") for c in carry])
    # a text that is carried along travels once
    given = kept if text_col in carry else docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias("_dw_text"))
    at, out = carry.index(text_col) if text_col in carry else len(carry), schema_with(kept, results)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fields, score = to_arrow_schema(out), start()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for a, b in slices(texts):
                made = score(texts[a:b])
                kept = [batch.column(i).slice(a, b - a).cast(fields.field(i).type) for i in range(len(carry))]
                made = [
                    x if isinstance(x, pa.Array) else pa.array(x, fields.field(len(carry) + i).type)
                    for i, x in enumerate(made)
                ]
                yield pa.RecordBatch.from_arrays(kept + made, schema=fields)
        pa.default_memory_pool().release_unused()

    return given.mapInArrow(run, out)
