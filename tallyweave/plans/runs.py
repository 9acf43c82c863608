"""One reconciliation per folder and session, its legs written as they are needed.

A run is kept by the folder, and the time and size of its tables, so that a
changed table is read anew.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession

from ..operators import legs
from ..sources.scratch import keep
from ..sources.world import state, world

_made: dict[tuple, object] = {}
_lock = threading.RLock()


def once(spark: SparkSession, sf_dir: str, name: str, make):
    at = (*state(spark, sf_dir), name)
    with _lock:
        if at not in _made:
            _made[at] = make()
        return _made[at]


def erp(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = world(spark, sf_dir)
    return once(spark, sf_dir, "erp", lambda: legs.erp_gateway(w["inv"], w["pg"]))


def bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    w = world(spark, sf_dir)
    return once(spark, sf_dir, "bank", lambda: legs.batch_bank(w["pg"], w["bank"]))


def before_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = world(spark, sf_dir)
    return once(spark, sf_dir, "before", lambda: keep(legs.union(erp(spark, sf_dir)[1], legs.integrity(w["inv"], w["pg"]), bank(spark, sf_dir)[1])))


def full(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return once(spark, sf_dir, "full", lambda: legs.reconcile(world(spark, sf_dir)))


def apart(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """One reconciliation of several worlds."""
    return once(spark, sf_dir, "apart", lambda: legs.reconcile(world(spark, sf_dir, True)))
