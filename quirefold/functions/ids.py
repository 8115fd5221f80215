"""Ids that a task retry reproduces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_ID = r"^[0-9a-f]{64}$"
UUID_ID = r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"


def _joined(*parts: Column) -> Column:
    """The parts as one text, each with its length before it, so that no two lists of parts are equal."""
    texts = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.concat(*(F.concat(F.length(text).cast("string"), F.lit(":"), text) for text in texts))


def document_id(workspace_id: Column, source_path: Column, import_batch_id: Column) -> Column:
    """One id per file and import batch, so a second import is a second document."""
    return F.sha2(_joined(workspace_id, source_path, import_batch_id), 256)


def part_id(document: Column, kind: str, number: Column) -> Column:
    """Id of the ``number``-th chunk or section of a document."""
    return F.sha2(_joined(document, F.lit(kind), number), 256)


def is_valid_id(value: Column) -> Column:
    return value.rlike(HEX_ID) | value.rlike(UUID_ID)
