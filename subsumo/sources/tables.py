"""Triples from the star-schema test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("customer", "nation", "supplier", "orders", "part")

TRIPLES_SQL = """
SELECT concat('c', c_custkey) AS s, 'nation' AS p, concat('n', c_nationkey) AS o FROM customer
UNION ALL SELECT concat('c', c_custkey), 'region', concat('r', n_regionkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('c', c_custkey), 'segment', c_mktsegment FROM customer
UNION ALL SELECT concat('su', s_suppkey), 'snation', concat('n', s_nationkey) FROM supplier
UNION ALL SELECT concat('n', n_nationkey), 'region', concat('r', n_regionkey) FROM nation
UNION ALL SELECT concat('o', o_orderkey), 'status', o_orderstatus FROM orders
UNION ALL SELECT concat('o', o_orderkey), 'priority', o_orderpriority FROM orders
UNION ALL SELECT concat('o', o_orderkey), 'cust', concat('c', o_custkey) FROM orders
UNION ALL SELECT concat('p', p_partkey), 'brand', p_brand FROM part
"""


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triples of the tables in `sf_dir`; the session's views are left alone."""
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", TRIPLES_SQL), **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in NAMES})
