"""Registered queries of the station and grid operators, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from . import archive, calibration, details, geo, ingest, inputs, pairing, ranking, series, shapes, thermal

_ALL: dict[str, tuple] = {}
for _module in (thermal, series, pairing, archive, calibration, ranking, geo, ingest, inputs, details, shapes):
    _ALL |= _module.QUERIES


def _ready(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _ready(q) for name, (q, _) in _ALL.items()}
ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _ALL.items() if sql}
