"""File names, types, gates and storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits and types of the intake.
MAX_FILE_SIZE = 16 * 1024 * 1024
SUPPORTED = [".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".txt", ".docx"]
MIME = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".tiff": "image/tiff",
    ".bmp": "image/bmp",
    ".txt": "text/plain",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".json": "application/json",
    ".html": "text/html",
    ".csv": "text/csv",
}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def extension(path: Column) -> Column:
    """Last dot and what follows, as written; a leading dot starts a name, not a type."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]*)\z", 1)


def mime_type(path: Column) -> Column:
    """Content type by extension, NULL where unknown."""
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.try_element_at(known, F.lower(extension(path)))


def size_error(size: Column) -> Column:
    """Why a file is refused for its size, NULL if it is not."""
    return F.when(size.isNull(), "File does not exist").when(size > MAX_FILE_SIZE, "File too large")


def type_error(path: Column) -> Column:
    """Why a file is refused for its type, NULL if it is not."""
    ext = F.lower(extension(path))
    return F.when(~ext.isin(*SUPPORTED), F.concat(F.lit("Unsupported file type: "), ext))


def read_method(path: Column) -> Column:
    """How the text is to be had: as it is, page by page, or from an image."""
    ext = F.lower(extension(path))
    return F.when(ext == ".txt", "direct_read").when(ext == ".pdf", "pdf_ocr").otherwise("image_ocr")


def storage_path(document_id: Column, path: Column) -> Column:
    return F.concat(F.lit("documents/"), document_id, extension(path))


def results_path(document_id: Column) -> Column:
    return F.concat(F.lit("processed/"), document_id, F.lit("_results.json"))


def stored_id(name: Column) -> Column:
    """Document id inside a stored name of either kind."""
    return F.regexp_extract(name, r"\A(?:documents|processed)/([^/]*?)(?:_results\.json|\.[^./]*)?\z", 1)


def merge_metadata(base: Column, extra: Column) -> Column:
    """``dict.update``: keys of ``extra`` replace those of ``base``."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    return F.when(extra.isNull(), base).otherwise(F.map_concat(kept, extra))
