"""The catalogue of queries: a name, a plan, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def plan(sql: str | None = None) -> Callable[[Plan], Plan]:
    def keep(function: Plan) -> Plan:
        PLANS[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return keep


def sql_uniform(operator: str, *keys: str, seed: int = 0) -> str:
    """DuckDB's form of ``keyed_uniform``."""
    text = " || '|' || ".join([f"'{seed}'", f"'{operator}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(sha1({text}), 1, 8) AS BIGINT) AS DOUBLE) / CAST(4294967295 AS DOUBLE))"


def sql_number(text: str, first: int = 1) -> str:
    return f"CAST('0x' || substr(sha1({text}), {first}, 8) AS BIGINT)"


def sql_items(slot: str = "noise") -> str:
    """DuckDB's form of the fixture's items."""
    return f"""items AS (SELECT d.doc_id, 'q:' || d.doc_id AS uid, 'doc:' || d.doc_id AS image_id, lang, source, n_chars, quality, toxic,
CASE WHEN CAST({sql_number("'doc:' || d.doc_id")} AS DOUBLE) / 4294967295 < CAST(0.2 AS DOUBLE) THEN 'calib' ELSE 'report' END AS split,
round(ln(CAST(greatest(n_chars, 1) AS DOUBLE) / CAST(1000 AS DOUBLE)) + 2 * {sql_uniform(slot, 'd.doc_id')} - 1, 6) AS gap FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


#: Probability of yes of an item, and of its predicted option, in SQL.
SQL_P = "(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-gap)))"
