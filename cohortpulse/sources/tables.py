"""A set of named tables, each opened on first use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


class Tables:
    """``Tables(spark.table)``, ``Tables(lambda name: spark.read.parquet(f"{root}/{name}"))``, ..."""

    def __init__(self, open_table: Callable[[str], DataFrame]):
        self._open = open_table
        self._opened: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def map(self, change: Callable[[str, DataFrame], DataFrame]) -> Tables:
        """The same tables, each passed through ``change(name, table)`` when opened."""
        return Tables(lambda name: change(name, self[name]))

    def register(self, *names: str) -> None:
        """Make tables visible to SQL under their names."""
        for name in names:
            self[name].createOrReplaceTempView(name)
