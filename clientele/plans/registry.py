"""The table of registered queries: key -> (Spark plan, equivalent SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]

PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if key in PLANS:
            raise ValueError(f"query {key} is registered twice")
        PLANS[key] = plan
        if sql is not None:
            SQL[key] = sql
        return plan
    return add
