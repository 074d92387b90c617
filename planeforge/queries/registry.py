"""Named queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def ints(**columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("bigint").alias(n) for n, c in columns.items()]


def reals(**columns: Column | str) -> list[Column]:
    return [(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for n, c in columns.items()]


#: The derived rasters, as SQL.
RGB = """rgb AS (SELECT event_id // 100 AS y, event_id % 100 AS x, k % 256 AS r, (k // 256) % 256 AS g, user_id % 256 AS b
  FROM (SELECT event_id, user_id, CAST(floor(value * 100) AS BIGINT) AS k FROM events))"""
PLANE = """plane AS (SELECT vec_id AS y, CAST(i AS BIGINT) AS x, CAST(floor(CAST(embedding[i + 1] AS DOUBLE) * 128) AS BIGINT) AS v
  FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS i FROM embeddings))"""
PALETTE = """pal AS (SELECT p_partkey AS idx, CAST(p_size * 5 AS BIGINT) AS c0, (p_partkey * 7 + p_size) % 256 AS c1, p_partkey % 256 AS c2 FROM part WHERE p_partkey < 200)"""
PASSES = """passes AS (SELECT l_orderkey AS block_id, CAST(row_number() OVER w AS BIGINT) AS pass_index, CAST(l_quantity AS BIGINT) AS bytes,
    CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_bytes, l_extendedprice AS distortion
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)),
blocks AS (SELECT block_id, CAST(count(*) AS BIGINT) AS pass_count, CAST(max(cum_bytes) AS BIGINT) AS byte_length FROM passes GROUP BY block_id)"""
