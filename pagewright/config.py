"""Limits and injectable parts of an extraction run."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, fields, replace

@dataclass(frozen=True)
class EngineConfig:
    agent: str = "pagewright"
    api_key: str = ""
    request_timeout: float = 15.0
    max_page_bytes: int = 2_000_000
    max_robots_bytes: int = 500_000
    max_redirects: int = 5
    robots_ttl: float = 3600.0
    min_interval: float = 1.0
    cache_ttl: float = 3600.0
    cache_entries: int = 1000
    llm_enabled: bool = False
    llm_input_chars: int = 12_000
    llm_min_chars: int = 30
    render_enabled: bool = False
    render_below_chars: int = 200
    unended_references: bool = True
    sheet_rows_per_edit: int = 10
    first_data_row: int = 2
    llm: Callable | None = None
    renderer: Callable | None = None
    transport: Callable | None = None

    @classmethod
    def from_environment(cls, prefix: str = "PAGEWRIGHT_") -> EngineConfig:
        """Numbers, flags and texts from variables named after the fields."""
        found = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None and not isinstance(default := f.default, type(None)):
                found[f.name] = raw.lower() in ("1", "true", "yes", "on") if isinstance(default, bool) else type(default)(raw)
        return replace(cls(), **found)
