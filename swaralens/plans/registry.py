"""Registered queries and their DuckDB SQL, with helpers to write both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The blanks of functions.text in RE2's notation.
B = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '[{B}]+'), lambda t: t <> '')"


DEVA = r"\x{0900}-\x{097F}"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def quoted(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(quoted, value)) + "]"
    if isinstance(value, bool):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def values(data: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in data)
    return f"(VALUES {body}) AS v({names})"


def listed(items) -> str:
    return quoted(list(items))


def sql_map(pairs: dict) -> str:
    return f"MAP({listed(pairs.keys())}, {listed(pairs.values())})"


def coded(r: str, h: str) -> str:
    """Two token lists as lists of numbers, in columns cr and ch."""
    code = f"list_distinct(list_concat({r}, {h}))"
    return ", ".join(f"list_transform({x}, lambda t: list_position({code}, t)::BIGINT) AS {y}" for x, y in ((r, "cr"), (h, "ch")))


#: Word edits of cr and ch in DuckDB, by rows of the usual table: its levenshtein counts bytes.
EDITS = """list_reduce(list_transform(cr, lambda t: [t]), lambda acc, x:
  list_reduce(list_transform(range(1, len(ch) + 1), lambda n: [n]),
    lambda line, k: list_append(line, least(line[k[1]] + 1, acc[k[1] + 1] + 1, acc[k[1]] + CASE WHEN ch[k[1]] = x[1] THEN 0 ELSE 1 END)), [acc[1] + 1]),
  range(0, len(ch) + 1))[-1]"""
