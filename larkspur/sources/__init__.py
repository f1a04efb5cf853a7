"""Reading and writing: JSON, JSON Lines, JSON text sequences, JSON5, YAML, CSV, TSV, TOON, raw text, Parquet."""

from __future__ import annotations

from larkspur.sources.readers import read
from larkspur.sources.writers import write

__all__ = ["read", "write"]
