"""Queries over the driver tables, one or more per operator, with SQL for the same result.

Dates leave both sides as text (``YYYY-MM-DD``), so that results compare equal whatever the client's date type.
"""

from __future__ import annotations

import importlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PARTS = ("prep", "features", "risk", "regime", "signals", "backtest", "scenario", "models", "stream")


def _modules():
    for p in _PARTS:
        try:
            yield importlib.import_module(f"tidemark.catalog.{p}")
        except ModuleNotFoundError as e:
            if e.name != f"tidemark.catalog.{p}":
                raise


def dates_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f"`{f.name}`") for f in df.schema])


def _outer_columns(sql: str) -> list[str]:
    """Output names of the outermost SELECT list."""
    depth, start, items, cur = 0, None, [], []
    for m in re.finditer(r"'[^']*'|\(|\)|,|\bSELECT\b|\bFROM\b|[^(),']+?(?=\bSELECT\b|\bFROM\b|[(),']|$)", sql, re.S):
        tok = m.group(0)
        depth += (tok == "(") - (tok == ")")
        if start is None:
            if depth == 0 and tok == "SELECT":
                start = True
            continue
        if depth == 0 and tok == "FROM":
            break
        if depth == 0 and tok == ",":
            items.append("".join(cur))
            cur = []
        else:
            cur.append(tok)
    items.append("".join(cur))
    return [re.findall(r"\w+", i)[-1] for i in items if re.findall(r"\w+", i)]


def _text_dates(sql: str) -> str:
    names = [c for c in _outer_columns(sql) if c == "ts" or c.endswith("_ts")]
    if not names:
        return sql
    casts = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in names)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)"


def _text(query):
    def run(spark, sf_dir):
        return dates_as_text(query(spark, sf_dir))

    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict:
    return {n: _text(q) for m in _modules() for n, q in m.QUERIES.items()}


def all_oracles() -> dict:
    return {n: _text_dates(q) for m in _modules() for n, q in m.ORACLES.items()}
