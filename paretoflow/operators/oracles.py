"""Metrics by registered functions: a name and a version stand for one function of an offering's row.

A function takes the columns of an offering (its struct of identity, its ``signals`` map and its
``metadata`` map) and returns a Column of the observation's struct: value, unit, evidence_tier,
lower, upper, sample_count, observed_at, source. It may be an expression or a Pandas UDF. A Pandas
UDF should give null for a row that it cannot judge; the row is then rejected with a reason, and
the reason tells nothing about the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

Oracle = Callable[[Column, Column, Column], Column]


class OracleError(ValueError):
    """An oracle is unknown, or its name and version are taken."""


class Oracles:
    def __init__(self) -> None:
        self._known: dict[tuple[str, str], Oracle] = {}

    def register(self, name: str, version: str, oracle: Oracle) -> None:
        if not name or not version:
            raise OracleError("an oracle needs a name and a version")
        if (name, version) in self._known:
            raise OracleError("this name and version are registered already")
        self._known[name, version] = oracle

    def evaluate(self, name: str, version: str, offering: Column, signals: Column, metadata: Column) -> Column:
        if (name, version) not in self._known:
            raise OracleError("no such oracle")
        return self._known[name, version](offering, signals, metadata)
