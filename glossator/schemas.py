"""Schemas of the engine's tables; columns may be added, never retyped.

Each name gives a StructType, made when it is asked for, as Spark's parser needs a session.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_PASSAGES = (
    "rowid BIGINT, model STRING, id STRING, date DATE, file_name STRING, section_number INT, embedding ARRAY<FLOAT>, scheme INT, chunk_text STRING, page INT, char_start INT, char_start_utf16 INT"
)
RESULT = "STRUCT<similarity: DOUBLE, folder_id: STRING, file_name: STRING, section_number: INT, rowid: BIGINT, status: TINYINT, page: INT, duplicates: ARRAY<STRING>, matched: STRING>"
_HISTORY = (
    f"id STRING, date TIMESTAMP, query STRING, query_embedding ARRAY<ARRAY<FLOAT>>, results ARRAY<{RESULT}>, model STRING, source STRING, index_state STRING, min_similarity DOUBLE"
)
_EXCLUDED = ("id STRING, date DATE, reason STRING")
_META = ("key STRING, value STRING")
_FILE_HASHES = ("key STRING, library_id BIGINT, size BIGINT, mtime BIGINT, hash STRING")
_IGNORED = ("hash STRING, date DATE")
CREATOR = "STRUCT<first_name: STRING, last_name: STRING, name: STRING, creator_type: STRING>"
_ITEMS = (
    f"item_id BIGINT, key STRING, library_id BIGINT, date_added TIMESTAMP, date_modified TIMESTAMP, item_type STRING, title STRING, creators ARRAY<{CREATOR}>, fields MAP<STRING, STRING>, "
    "tags ARRAY<STRING>, collections ARRAY<STRING>, deleted BOOLEAN"
)
_ATTACHMENTS = ("item_id BIGINT, parent_id BIGINT, key STRING, library_id BIGINT, content_type STRING, link_mode INT, path STRING, date_added TIMESTAMP, deleted BOOLEAN")

#: Why a document can be excluded.
REASONS = ("no_text", "encrypted", "unreadable", "manual", "duplicate", "other")

_TABLES = {"PASSAGES": _PASSAGES, "HISTORY": _HISTORY, "EXCLUDED": _EXCLUDED, "META": _META, "FILE_HASHES": _FILE_HASHES, "IGNORED": _IGNORED, "ITEMS": _ITEMS, "ATTACHMENTS": _ATTACHMENTS}


def __getattr__(name: str) -> StructType:
    if name in _TABLES:
        return StructType.fromDDL(_TABLES[name])
    raise AttributeError(name)
