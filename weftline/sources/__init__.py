"""Reading of catalogues and sessions, writing of results."""

from weftline.sources.jsonl import read_catalog, read_sessions, results, write_results

__all__ = ["read_catalog", "read_sessions", "results", "write_results"]
