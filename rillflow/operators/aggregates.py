"""Aggregates over overlays and records. Sums of money and area that must not depend on the order of rows
are taken in decimals; shares keep the basin's area, not the sum of groups, as denominator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(c: str | Column, scale: int = 4) -> Column:
    """Sum of doubles independent of row order."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(28,{scale})")).cast("double")


def share(part: Column, whole: Column) -> Column:
    """Part in % of whole; null if the whole is 0 or unknown."""
    return F.try_divide(100.0 * part, whole)


def class_shares(overlay: DataFrame, keys: Sequence[str], label: str, basin_area: Column, limit: int | None = None) -> DataFrame:
    """Area and % of the basin by class, largest first (column rank); with a limit, the first so many, then those without area go."""
    sums = overlay.groupBy(*keys, label).agg(exact_sum("overlap").alias("area"), F.count("*").alias("n"), F.first(basin_area).alias("_whole"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), label))
    out = sums.withColumn("rank", rank)
    if limit is not None:
        out = out.where(F.col("rank") <= limit)
    return out.where("area > 0").withColumn("part_pct", share(F.col("area"), F.col("_whole"))).drop("_whole")


def two_levels(overlay: DataFrame, upper: str, lower: str) -> DataFrame:
    """Areas by class and by (class, subclass) in one pass over the overlay."""
    sets = [[F.col(upper)], [F.col(upper), F.col(lower)]]
    return overlay.groupingSets(sets, upper, lower).agg(exact_sum("overlap").alias("area"), F.count("*").alias("n"))


def labelled(df: DataFrame, labels: DataFrame, key: str, label: str, default: str | Column | None = None) -> DataFrame:
    """Labels of codes; a code that the table lacks takes the default or stands for itself. Spark broadcasts a table that is small."""
    named = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).dropDuplicates(["_key"])
    fall = F.col(key).cast("string") if default is None else (F.lit(default) if isinstance(default, str) else default)
    joined = df.join(named, F.col(key) == F.col("_key"), "left")
    return joined.withColumn(label, F.coalesce(F.nullif("_label", F.lit("")), fall)).drop("_key", "_label")


def latest(records: DataFrame, key: Sequence[str], year: str, order: str) -> DataFrame:
    """Each key's latest record; of the same year the first in order; rows without key or year are left out."""
    known = records.where(" and ".join(f"`{c}` is not null" for c in [*key, year]))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(year), order))
    return known.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def size_stats(df: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(size).alias("n"), exact_sum(size).alias("total"), F.avg(size).alias("mean"), F.median(size).alias("median"))


def elevation_stats(cells: DataFrame, keys: Sequence[str], z: str, nodata: float | None = None) -> DataFrame:
    """Min, max, mean, median, H5 and H95, and the hypsometric curve as (share of surface above, elevation)."""
    quantiles = (0, 5, 10, 25, 50, 75, 90, 95, 100)
    fine = ~F.isnan(z) & (F.abs(z) < float("inf"))
    rows = cells.where(fine & (F.col(z) != nodata) if nodata is not None else fine)
    at = F.percentile(z, F.array(*[F.lit(q / 100) for q in quantiles]))
    out = rows.groupBy(*keys).agg(F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.avg(z).alias("z_mean"), F.median(z).alias("z_median"), at.alias("_q"))
    curve = F.arrays_zip(F.array(*[F.lit(100 - q) for q in quantiles]).alias("part"), F.col("_q").alias("z"))
    return out.withColumns({"z_h5": F.get("_q", F.lit(quantiles.index(95))), "z_h95": F.get("_q", F.lit(quantiles.index(5))), "relief": F.col("z_max") - F.col("z_min"), "curve": curve}).drop("_q")


def slope_stats(cells: DataFrame, keys: Sequence[str], degrees: str = "slope_deg") -> DataFrame:
    """Mean, median and maximum in degrees; the percentage is the tangent of the mean, not the mean of tangents."""
    out = cells.groupBy(*keys).agg(F.avg(degrees).alias("mean_deg"), F.median(degrees).alias("median_deg"), F.max(degrees).alias("max_deg"))
    return out.withColumn("mean_pct", 100 * F.tan(F.radians("mean_deg")))


def overlapping_groups(occurrences: DataFrame, lineage: str, species: str, groups: dict[str, int]) -> DataFrame:
    """Observations and distinct species of groups that may overlap, and of all (group "total")."""
    member = F.array(*[F.when(F.array_contains(lineage, key), F.lit(name)) for name, key in groups.items()], F.lit("total"))
    each = occurrences.select(F.explode(F.array_compact(member)).alias("group"), species)
    return each.groupBy("group").agg(F.count("*").alias("n_obs"), F.count_distinct(species).alias("n_species"))


def ternary(flag: str | Column, name: str) -> list[Column]:
    """Counts of true, false and unknown."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return [F.count_if(c).alias(f"{name}_true"), F.count_if(~c).alias(f"{name}_false"), F.count_if(c.isNull()).alias(f"{name}_unknown")]


def joined_text(value: str, order: str, separator: str = ", ") -> Column:
    """Values in order, as one text; null if there is none."""
    rows = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))))
    return F.nullif(F.array_join(F.transform(rows, lambda s: s["v"]), separator), F.lit(""))


def dominant(df: DataFrame, keys: Sequence[str], label: str, weight: str) -> DataFrame:
    """The class of most weight; ties to the first label."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), label))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dasymetric(zones: DataFrame, inside: DataFrame, whole: DataFrame, key: str, amount: str) -> DataFrame:
    """Each zone's amount by the share of its housing inside (both: key, housing); null where the zone has none."""
    joined = zones.join(inside.withColumnRenamed("housing", "_in"), key, "left").join(whole.withColumnRenamed("housing", "_all"), key, "left")
    return joined.withColumn("estimate", F.try_divide(F.col(amount) * F.coalesce("_in", F.lit(0)), F.col("_all"))).drop("_in", "_all")


def top(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def capped(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows a group in order, each with the group's whole count and whether it was cut."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("n_all", F.count("*").over(w))
    return out.withColumn("truncated", F.col("n_all") > cap).where(F.col("rank") <= cap)


def chart_groups(shares: DataFrame, label: str, value: str, least: float = 1.0, residue: float = 0.05, other: str = "Autres") -> DataFrame:
    """Groups of at least ``least`` %, and the rest as one if it is more than ``residue`` %."""
    named = shares.withColumn(label, F.when(F.col(value) >= least, F.col(label)).otherwise(F.lit(None)))
    out = named.groupBy(label).agg(F.sum(value).alias(value))
    return out.where(F.col(label).isNotNull() | (F.col(value) > residue)).withColumn(label, F.coalesce(label, F.lit(other)))


def iou(inter: Column, a: Column, b: Column) -> Column:
    """Overlap by union; 0 where the union is nothing."""
    return F.coalesce(F.try_divide(inter, a + b - inter), F.lit(0.0))
