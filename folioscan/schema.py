"""Records, results and constants of the search engine."""

from __future__ import annotations

import enum
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("topics", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("is_pdf", T.BooleanType()),
        T.StructField("file_path", T.StringType()),
    ]
)
#: A stored record has an id of its own, as the caller's may repeat.
STORED = T.StructType([T.StructField("row_id", T.LongType()), *DOCUMENT.fields])
RESULT_COLUMNS = ["title", "reference", "text", "id", "segment", "is_pdf", "file_path"]
#: What a missing value counts as.
DEFAULTS = {"title": "", "reference": "", "text": "", "segment": 0, "is_pdf": False, "file_path": ""}

SCHEMA_VERSION = 2
ENGINE_VERSION = "0.1.0"
FORMAT = "folioscan-index"
META_FILE = "_index_meta.json"
#: Most distinct terms that are marked in a page of results, shared evenly by the patterns of a query.
HIGHLIGHT_TERMS = 512


class ResultsOrder(enum.Enum):
    CATALOGUE = "catalogue"
    RELEVANCE = "relevance"


@dataclass(frozen=True)
class DocumentInput:
    id: int
    title: str
    reference: str
    topics: str
    text: str
    segment: int
    is_pdf: bool
    file_path: str

    def values(self) -> tuple:
        return tuple(asdict(self).values())


@dataclass(frozen=True)
class HighlightConfig:
    highlight_prefix: str = "<font color=red>"
    highlight_postfix: str = "</font>"
    max_chars: int = 800


@dataclass(frozen=True)
class SearchPage:
    """A page of results and how many records match in all."""

    total_count: int
    results: DataFrame


@dataclass(frozen=True)
class IndexCompatibility:
    compatible: bool
    status: str
    found_schema_version: int | None
    required_schema_version: int
    engine_version: str
    metadata_path: str
    reason: str | None = None


class ExpansionError(ValueError):
    """A pattern stands for more terms than the query allows."""
