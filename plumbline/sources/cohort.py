"""A multi-site cohort of observations drawn from the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE, MOVING = "AFRICA", "MIDDLE EAST"
TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")

#: The same in Spark and in ANSI SQL engines: subject = customer, site = region, bundle = part type.
COHORT_SQL = """
SELECT c.c_custkey AS sid, r.r_name AS site, p.p_type AS bundle, '{metric}' AS metric,
       {value} * (CAST(1 AS DOUBLE) + CAST(r.r_regionkey AS DOUBLE) / CAST(10 AS DOUBLE))
         + CAST(5 AS DOUBLE) * r.r_regionkey + CAST(20 + (c.c_custkey * 11) % 70 AS DOUBLE) / CAST(5 AS DOUBLE) AS mean,
       CAST(20 + (c.c_custkey * 11) % 70 AS DOUBLE) AS age,
       CAST(CASE WHEN c.c_custkey % 6 >= 3 THEN 2 ELSE 1 END AS INT) AS sex,
       CAST(CASE WHEN c.c_custkey % 3 = 1 THEN 2 ELSE 1 END AS INT) AS handedness,
       CASE WHEN c.c_mktsegment = 'MACHINERY' THEN 'PT' ELSE 'HC' END AS disease
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey JOIN {part} p ON l.l_partkey = p.p_partkey
GROUP BY c.c_custkey, r.r_name, r.r_regionkey, p.p_type, c.c_mktsegment
"""
VALUES = {"price": "AVG(l.l_extendedprice) / CAST(1000 AS DOUBLE)", "qty": "AVG(l.l_quantity)"}


def cohort(spark: SparkSession, sf_dir: str, metric: str = "price") -> DataFrame:
    """One row per subject and bundle.  The big join and its sums come first; only dimension tables join to them."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(COHORT_SQL.format(metric=metric, value=VALUES[metric], **tables))


def reference(df: DataFrame, site: str = REFERENCE) -> DataFrame:
    return df.where(F.col("site") == site)


def moving(df: DataFrame, site: str = MOVING) -> DataFrame:
    """Controls of the moving site."""
    return df.where((F.col("site") == site) & (F.col("disease") == "HC"))
