"""Batch and micro-batch venue search and recommendation on Spark DataFrames."""

from .config import AnswerConfig, IngestConfig, SearchConfig
from .errors import CorpusTooSmallError, ListingSchemaError
from .schemas import CANONICAL, PREFS, RAW, RESPONSES, SCHEMA_VERSION, column_mapping

__all__ = [
    "AnswerConfig",
    "CANONICAL",
    "CorpusTooSmallError",
    "IngestConfig",
    "ListingSchemaError",
    "PREFS",
    "RAW",
    "RESPONSES",
    "SCHEMA_VERSION",
    "SearchConfig",
    "column_mapping",
]
