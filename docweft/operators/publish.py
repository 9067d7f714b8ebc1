"""Publication: gate, public views and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweft.functions.text import folded, strip


def text_chars(text: Column) -> Column:
    """Characters of a text without white space at its ends; 0 for null."""
    return F.length(strip(F.coalesce(text, F.lit(""))))


def gate(docs: DataFrame, *, least_text: int = 80) -> DataFrame:
    """Adds ``gate_ok`` and ``gate_reason`` (failed checks in a fixed order, comma-joined, or ``ok``).

    The checks' names are output values. Three-valued flags: a null ``sensitive`` or ``duplicate`` passes, and ``useful`` fails only where it is false.
    The text's length is the column ``text_chars``, so that joins before need not carry texts, or, without it, that of ``full_text``.
    """
    chars = F.col("text_chars") if "text_chars" in docs.columns else text_chars(F.col("full_text"))
    checks = [
        (~F.col("processing_status").eqNullSafe("Completed"), "processing_not_completed"),
        (~F.coalesce(F.col("publication_status") == "Unpublished", F.lit(True)), "publication_not_pending"),
        (F.coalesce(F.col("backup_id"), F.lit("")) == "", "drive_backup_missing"),
        (F.coalesce("sensitive", F.lit(False)), "sensitive_document"),
        (F.coalesce("duplicate", F.lit(False)), "duplicate_document"),
        (F.col("useful").eqNullSafe(False), "document_marked_not_useful"),
        (chars < least_text, "insufficient_ocr_text"),
        (strip(F.coalesce("extraction_method", F.lit(""))) == "", "missing_extraction_provenance"),
    ]
    failed = F.array_compact(F.array(*[F.when(test, name) for test, name in checks]))
    return docs.withColumn("gate_ok", F.size(failed) == 0).withColumn(
        "gate_reason", F.when(F.size(failed) == 0, "ok").otherwise(F.array_join(failed, ","))
    )


def public_documents(docs: DataFrame) -> DataFrame:
    """Approved rows that are neither sensitive nor duplicate (here a null flag is not public)."""
    return docs.where("approved AND NOT sensitive AND NOT duplicate")


def newest(docs: DataFrame, n: int, *, by: Sequence[Column]) -> DataFrame:
    """L1, L3: the first ``n`` rows in a total order, as one top-n."""
    return docs.orderBy(*by).limit(n)


def oldest_first(docs: DataFrame, n: int, *, at: str, key: str) -> DataFrame:
    """L2: a bounded work queue, ties by key."""
    return docs.orderBy(F.col(at).asc_nulls_last(), key).limit(n)


def listing(public: DataFrame, *, category: str | None = None, priority: str | None = None, search: str | None = None) -> DataFrame:
    """Archive filters; a blank one does not filter. The search text is literal (commas count as blanks)."""
    out = public
    if category:
        out = out.where(F.col("category") == category)
    if priority:
        out = out.where(F.col("priority") == priority)
    wanted = " ".join((search or "").replace(",", " ").split())
    return out.where(F.lower("search_text").contains(wanted.lower())) if wanted else out


def visible(docs: DataFrame, role: str) -> DataFrame:
    """What a role sees: reviewers everything, all others the public rows."""
    return docs if role == "reviewer" else public_documents(docs)


def allowed_senders(messages: DataFrame, users: DataFrame, chats: DataFrame) -> DataFrame:
    """Messages of which the user or the chat is listed (two semi joins without doubling)."""
    by_user = messages.join(users, "user_id", "left_semi")
    by_chat = messages.join(chats, "chat_id", "left_semi").join(users, "user_id", "left_anti")
    return by_user.unionByName(by_chat)


def chosen_attachment(document: Column, photos: Column) -> Column:
    """The document, else the last photo."""
    return F.coalesce(document, F.try_element_at(photos, F.lit(-1)))


def numbered(listed: DataFrame, *order: Column) -> DataFrame:
    """Serial numbers of a listing that a limit has bounded; never for a whole table."""
    return listed.withColumn("serial", F.row_number().over(Window.orderBy(*order)))


def searchable(fields: Sequence[Column]) -> Column:
    """the folded text of the fields that have one."""
    return folded(F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]))
