"""How SQL operators run: a text with {table} names over DataFrames, which Catalyst plans like any other."""

from __future__ import annotations

from pyspark.sql import DataFrame


def over(sql: str, **tables) -> DataFrame:
    """sql over DataFrames; other values in braces are literals."""
    return next(t for t in tables.values() if isinstance(t, DataFrame)).sparkSession.sql(sql, **tables)


def sql_operator(sql: str, *names: str):
    """An operator that takes the named tables, in this order. Its sql is the text for another engine, where the names are those of its own tables."""

    def operator(*tables: DataFrame) -> DataFrame:
        return over(sql, **dict(zip(names, tables, strict=True)))

    operator.tables = names
    operator.sql = sql
    for n in names:
        operator.sql = operator.sql.replace("{" + n + "}", n)
    return operator
