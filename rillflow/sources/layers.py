"""Reading layers: tables of features with a box (xmin, ymin, xmax, ymax) and, where there is a shape, WKB in geom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.functions import scalar as S


class LayerTooLarge(RuntimeError):
    """A scan would pass the budget of features; ``limit`` is the budget."""

    def __init__(self, limit: int):
        super().__init__(f"more than {limit} features: narrow the extent")
        self.limit = limit


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def overlaps(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Box test on plain columns, so that it reaches the Parquet scan."""
    return (F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0)


def scan(layer: DataFrame, extent: tuple[float, float, float, float] | None = None, ids: Sequence[str] | None = None, columns: Sequence[str] | None = None, id_column: str = "fid") -> DataFrame:
    """Features whose box meets an extent, of given ids, with given columns only."""
    if extent is not None:
        layer = layer.where(overlaps(*extent))
    if ids is not None:
        layer = layer.where(F.col(id_column).isin(list(ids)))
    return layer.select(*columns) if columns else layer


def within_budget(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """The rows, or an error if there are more than ``limit``; reads no more rows than tell."""
    if df.limit(limit + 1).count() > limit:
        raise LayerTooLarge(limit)
    return df


def over_budget(df: DataFrame, limit: int) -> DataFrame:
    """One row: rows, limit and whether the budget is passed."""
    return df.agg(F.count("*").alias("n_rows")).select("n_rows", F.lit(limit).cast("long").alias("budget"), (F.col("n_rows") > limit).alias("over"))


def union_layers(layers: dict[str, DataFrame], tag: str = "layer") -> DataFrame:
    """Layers one after the other, each row with its layer's name."""
    out = None
    for name, df in layers.items():
        one = df.withColumn(tag, F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def by_codes(records: DataFrame, codes: DataFrame, column: str) -> DataFrame:
    """Records whose code is in a list; each once."""
    return records.join(codes.select(column).distinct(), column, "left_semi")


def harmonised(df: DataFrame, **columns: str | Column) -> DataFrame:
    """One schema from another: text columns trimmed, empty as null; Columns as they are."""
    return df.select(*[(S.blank_as_null(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def raw_grids(spark: SparkSession, path: str, width: int, height: int) -> DataFrame:
    """Grids of little-endian 32-bit floats, one file each, as (path, r, c, z) cells; a wrong size is an error."""

    def cells(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                if len(data) != 4 * width * height:
                    raise ValueError(f"{name}: {len(data)} bytes where {4 * width * height} are due")
                z = np.frombuffer(data, "<f4")
                for i in range(0, len(z), 1 << 18):
                    part, k = z[i : i + (1 << 18)], np.arange(i, min(len(z), i + (1 << 18)))
                    yield pa.record_batch([pa.array([name] * len(part)), pa.array(k // width), pa.array(k % width), pa.array(part)], names=["path", "r", "c", "z"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(cells, "path string, r long, c long, z float")


def json_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON collections: properties as declared, geometry type and coordinates text, box."""
    schema = f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    docs = spark.read.schema(schema).option("multiLine", "true").json(path)
    each = docs.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    numbers = F.transform(F.regexp_extract_all("coordinates", F.lit(r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?"), F.lit(0)), lambda x: x.cast("double"))
    xs, ys = F.filter(numbers, lambda _, i: i % 2 == 0), F.filter(numbers, lambda _, i: i % 2 == 1)
    return each.select("*", F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))
