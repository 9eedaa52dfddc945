"""Stored documents and their children: joins, retention, listing, latest rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.files import stored_id
from docweave.operators.skew import left_join_many


def with_children(documents: DataFrame, children: DataFrame) -> DataFrame:
    """Documents with their entities, predictions or logs; childless documents stay."""
    return left_join_many(documents, children, "document_id")


def delete_cascade(children: DataFrame, deleted: DataFrame) -> DataFrame:
    """Children that are left once ``deleted`` documents are gone."""
    return children.join(deleted.select("document_id"), "document_id", "left_anti")


def known_children(children: DataFrame, documents: DataFrame) -> DataFrame:
    """Children whose document exists."""
    return children.join(documents.select("document_id"), "document_id", "left_semi")


def document_row(document: DataFrame, classification: DataFrame, file_info: DataFrame) -> DataFrame:
    """One stored row per document from the steps' results, with the defaults of missing steps."""
    return (
        document.join(classification, "document_id", "left")
        .join(file_info, "document_id", "left")
        .select(
            "document_id",
            F.coalesce("file_type", F.lit("unknown")).alias("file_type"),
            F.coalesce("file_size", F.lit(0)).alias("file_size"),
            F.coalesce("document_type", F.lit("unknown")).alias("document_type"),
            F.coalesce("confidence", F.lit(0.0)).alias("confidence_score"),
            F.coalesce("text", F.lit("")).alias("extracted_text"),
        )
    )


def document_files(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Stored files and result files of each document, one row per file, with ``found``.

    The id is read from the name, which turns a prefix search into an equality join; ``1`` does not
    find ``10``. Documents without a file keep one row.
    """
    named = files.select(
        stored_id(F.col("name")).alias("document_id"),
        "name",
        F.when(F.col("name").startswith("processed/"), "result").otherwise("file").alias("kind"),
    )
    return left_join_many(documents.select("document_id"), named, "document_id").withColumn(
        "found", F.col("name").isNotNull()
    )


def listing(files: DataFrame, prefix: str | None = None, limit: int | None = 100) -> DataFrame:
    """Files by name, up to ``limit``; the prefix is pushed to the scan."""
    kept = files.where(F.col("name").startswith(prefix)) if prefix else files
    return kept.orderBy("name").limit(limit) if limit is not None else kept


def expired(files: DataFrame, asof: Column, days: int = 30) -> DataFrame:
    """Files created more than ``days`` days before ``asof``."""
    return files.where(F.col("created") < asof - F.make_dt_interval(F.lit(days)))


def recent(documents: DataFrame, limit: int = 100, id_col: str = "document_id") -> DataFrame:
    """Newest documents first; ids break ties."""
    return documents.orderBy(F.desc("created_at"), F.asc(id_col)).limit(limit)


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest row per key. An aggregate, so a hot key is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*")


def form_grid(cells: DataFrame) -> DataFrame:
    """Table cells to rows: ``(document_id, table_no, row_index, cells)`` by column order."""
    ordered = F.sort_array(F.collect_list(F.struct("column_index", "content")))
    return cells.groupBy("document_id", "table_no", "row_index").agg(
        F.transform(ordered, lambda c: c["content"]).alias("cells")
    )


def form_key_values(df: DataFrame) -> DataFrame:
    """``Key: value`` lines of a text as rows."""
    pattern = r"(?md)^([^:\n]+):[ \t]*(\S.*)$"
    keys = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(1))
    values = F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(2))
    return df.select(
        "document_id", F.inline(F.arrays_zip(keys.alias("key"), values.alias("value")))
    )
