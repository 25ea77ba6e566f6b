"""Registered queries over the driver's tables and the DuckDB SQL that checks them."""

from __future__ import annotations

import importlib
import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_MODULES = ("describing", "tables", "testing", "preparing", "evaluating", "series", "modelling", "scoring", "baskets", "streams", "clustering", "explaining")


def eight_digits(sql: str) -> str:
    """{{expr}} in the SQL stands for expr at eight significant digits, as functions.scalar.sig has it."""
    return re.sub(r"\{\{(.*?)\}\}", r"(case when abs((\1)::double) < 1e-11 then 0.0 else cast(printf('%.7e', (\1)::double * 1.000000000003) as double) end)", sql, flags=re.S)


def query(name: str, sql: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame under a survey id."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = eight_digits(sql)
        return fn

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"tesserae.plans.{m}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
