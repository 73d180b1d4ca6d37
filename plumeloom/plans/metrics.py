"""Counts of rows that pass by, taken while another action runs.

An action that reads a frame twice, as a global sort does to sample it, counts its rows twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


#: Everything that a run can count: tiles with a valid pixel, slots over the thresholds, those with a
#: geometry, pairs of heads without a common valid pixel, and plumes after merging.
EVERYTHING = ("chunks", "extracted", "candidates", "no_valid_mask", "plumes")


class Counters:
    """counters.on(df, "plumes") is df; counters.values() after an action on it has its rows, or those
    of them that meet a condition. Only the names that are wanted are counted."""

    def __init__(self, wanted: tuple[str, ...] = ("candidates", "plumes")) -> None:
        self.wanted = wanted
        self._seen: dict[str, Observation] = {}

    def on(self, df: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
        if name not in self.wanted:
            return df
        self._seen[name] = Observation(name)
        rows = F.count(F.lit(1)) if condition is None else F.count_if(condition)
        return df.observe(self._seen[name], rows.alias("rows"))

    def values(self) -> dict[str, int]:
        """Waits for the first action on every counted frame."""
        return {name: seen.get["rows"] for name, seen in self._seen.items()}
