"""Shapes, grids and networks derived from the plain tables, by integer rules that SQL can repeat.

Box of part k: corner (37 k mod 1000, 91 k mod 1000), width p_size, height 1 + k mod 20. Point of supplier or customer k:
(53 k mod 1000, 29 k mod 1000). Basin of region k: corner (150 k, 120 k), 400 by 400. Grid of 50 columns:
part k is the cell (k div 50, k mod 50). Tree: the parent of customer k is (k - 1) div 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.operators import spatial
from rillflow.sources.layers import table

BOX = (200.0, 200.0, 800.0, 800.0)
COLUMNS = 50
TILE = 100.0

SQL_PART = "(SELECT p_partkey AS k, p_name, p_brand, p_type, p_size, p_retailprice, CAST(p_partkey * 37 % 1000 AS DOUBLE) AS x0, CAST(p_partkey * 91 % 1000 AS DOUBLE) AS y0, CAST(p_partkey * 37 % 1000 + p_size AS DOUBLE) AS x1, CAST(p_partkey * 91 % 1000 + 1 + p_partkey % 20 AS DOUBLE) AS y1 FROM part)"
SQL_BASIN = "(SELECT r_regionkey AS b, CAST(r_regionkey * 150 AS DOUBLE) AS bx0, CAST(r_regionkey * 120 AS DOUBLE) AS by0, CAST(r_regionkey * 150 + 400 AS DOUBLE) AS bx1, CAST(r_regionkey * 120 + 400 AS DOUBLE) AS by1 FROM region)"
SQL_SUPPLIER = "(SELECT s_suppkey AS k, s_nationkey, s_acctbal, CAST(s_suppkey * 53 % 1000 AS DOUBLE) AS x, CAST(s_suppkey * 29 % 1000 AS DOUBLE) AS y FROM supplier)"
SQL_CUSTOMER = "(SELECT c_custkey AS k, c_nationkey, c_acctbal, c_mktsegment, CAST(c_custkey * 53 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 29 % 1000 AS DOUBLE) AS y FROM customer)"
SQL_OVERLAP = "(least(x1, bx1) - greatest(x0, bx0)) * (least(y1, by1) - greatest(y0, by0))"
SQL_MEET = "least(x1, bx1) > greatest(x0, bx0) AND least(y1, by1) > greatest(y0, by0)"


def sql_cells(z: str) -> str:
    return f"(SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST({z} AS DOUBLE) AS z, p_partkey AS k FROM part)"


def boxes(spark: SparkSession, sf: str, geom: bool = True) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 37 % 1000).cast("double"), (k * 91 % 1000).cast("double")
    df = table(spark, sf, "part").select(
        k.alias("fid"), "p_name", "p_brand", "p_type", "p_size", x.alias("xmin"), y.alias("ymin"), (x + F.col("p_size")).alias("xmax"), (y + 1 + k % 20).alias("ymax")
    )
    return df.withColumn("geom", spatial.box_wkb(*spatial.BOX)) if geom else df


def basins(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("r_regionkey")
    x, y = (k * 150).cast("double"), (k * 120).cast("double")
    df = table(spark, sf, "region").select(k.alias("basin_id"), x.alias("xmin"), y.alias("ymin"), (x + 400).alias("xmax"), (y + 400).alias("ymax"))
    return df.withColumn("geom", spatial.box_wkb(*spatial.BOX))


def one_basin(spark: SparkSession) -> DataFrame:
    df = spark.range(1).select(F.lit(0).alias("basin_id"), *[F.lit(v).alias(n) for v, n in zip(BOX, spatial.BOX)])
    return df.withColumn("geom", spatial.box_wkb(*spatial.BOX))


def points(spark: SparkSession, sf: str, name: str) -> DataFrame:
    p = name[0]
    k = F.col(f"{p}_{'supp' if p == 's' else 'cust'}key")
    return table(spark, sf, name).withColumns({"key": k, "x": (k * 53 % 1000).cast("double"), "y": (k * 29 % 1000).cast("double")})


def placed(df: DataFrame) -> DataFrame:
    """Points with box and shape."""
    return spatial.as_points(df, "x", "y").withColumn("geom", spatial.point_wkb("x", "y"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """From a box's corner, five times its size along x for even keys, along y for odd ones."""
    b = boxes(spark, sf, geom=False)
    even, long = F.col("fid") % 2 == 0, F.col("p_size") * 5.0
    b = b.withColumn("xmax", F.when(even, F.col("xmin") + long).otherwise(F.col("xmin"))).withColumn("ymax", F.when(even, F.col("ymin")).otherwise(F.col("ymin") + long))
    return b.withColumn("geom", spatial.segment_wkb(*spatial.BOX))


def grid(spark: SparkSession, sf: str, z: str) -> DataFrame:
    """Cells r, c, z of the part grid, with its size h, w."""
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey"))
    cells = p.select((F.expr("k div 50")).alias("r"), F.expr("k % 50").alias("c"), F.expr(z).cast("double").alias("z"), "k")
    size = cells.agg((F.max("r") + 1).alias("h")).withColumn("w", F.lit(COLUMNS).cast("long"))
    return cells.crossJoin(F.broadcast(size))  # one row


def tree(spark: SparkSession, sf: str) -> DataFrame:
    """Reaches of a binary tree that flow to the parent: every 13th a canal or a harbour basin, every 11th without direction, every 17th of reversed drawing."""
    k = F.col("c_custkey")
    up, down = k.cast("string"), F.expr("(c_custkey - 1) div 2").cast("string")
    back = k % 17 == 0
    return table(spark, sf, "customer").where("c_custkey > 0").select(
        k.alias("id"),
        k.alias("ord"),
        F.when(k % 26 == 0, F.lit("Retenue-bassin portuaire")).when(k % 13 == 0, F.lit("Canal")).otherwise(F.lit("Ecoulement naturel")).alias("nature"),
        F.when(k % 11 == 0, F.lit("Sans objet")).when(back, F.lit("Sens inverse")).otherwise(F.lit("Sens direct")).alias("direction"),
        F.when(back, down).otherwise(up).alias("ini"),
        F.when(back, up).otherwise(down).alias("fin"),
    )
