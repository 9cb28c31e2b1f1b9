"""All queries of the library and their SQL twins."""

from __future__ import annotations

from . import block_queries, codec_queries, container_queries, pixel_queries, prediction_queries, stream_queries, token_queries  # noqa: F401
from .registry import COVERS, ORACLE_SQL, QUERIES

__all__ = ["COVERS", "ORACLE_SQL", "QUERIES"]
