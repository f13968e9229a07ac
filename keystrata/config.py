"""Sizes and limits of a store."""

from __future__ import annotations

from dataclasses import dataclass

BLOCK = 32 * 1024
HEADER = 9


@dataclass(frozen=True)
class Config:
    """Limits in bytes of data unless named otherwise."""

    log_bytes: int = 4_000_000
    table_bytes: int = 2_000_000
    young_tables: int = 4
    level_base: int = 10
    cached_tables: int = 250
    #: Most rows of a manifest that are sent to every executor; beyond it ranges are dealt into buckets.
    broadcast_rows: int = 20_000

    def capacity(self, level: int) -> int:
        """Tables that a level holds before it is compacted."""
        return self.young_tables if level == 0 else self.level_base**level
