"""Order-free comparison of a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def rows(names, values) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in values)


def differences(spark_df, con, sql: str, shown: int = 3) -> str | None:
    got = spark_df.collect()
    result = con.execute(sql)
    names = [column[0] for column in result.description]
    want = result.fetchall()
    if sorted(names) != sorted(spark_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} against {sorted(names)}"
    left, right = rows(spark_df.columns, got), rows(names, want)
    if left == right:
        return None
    return (
        f"columns {sorted(names)}; rows {len(got)} against {len(want)}; "
        f"only Spark {list((left - right).items())[:shown]}; only SQL {list((right - left).items())[:shown]}"
    )


def misplaced(spark_df, con, sql: str, keys: list[str]) -> str | None:
    """Where the sort keys of the rows, in the order in which they come, part from those that SQL sorts them by.

    ``keys`` are columns with a direction and a place for nulls; rows that tie on them may come in any order.
    """
    names = list(dict.fromkeys(key.split()[0] for key in keys))
    got = [tuple(plain(row[name]) for name in names) for row in spark_df.collect()]
    result = con.execute(f"SELECT {', '.join(names)} FROM ({sql}) ORDER BY {', '.join(keys)}").fetchall()
    want = [tuple(map(plain, row)) for row in result]
    first = next((i for i, pair in enumerate(zip(got, want)) if pair[0] != pair[1]), None)
    if len(got) == len(want) and first is None:
        return None
    return f"{len(got)} rows against {len(want)}; first difference at {first}: {got[first]} against {want[first]}"
