"""Wide and long forms: fixed schemas with labels, pivots that tell 0 from unknown, indicator tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

KINDS: dict[str, DataType] = {"DOUBLE": DoubleType(), "INT": IntegerType(), "LONG": LongType(), "STRING": StringType(), "BOOLEAN": BooleanType()}


def schema(fields: Sequence[tuple[str, str, str]]) -> StructType:
    """StructType from (name, type, label with unit); label and unit go to the fields' metadata."""
    out = []
    for name, kind, label in fields:
        text, _, unit = label.partition(" (")
        out.append(StructField(name, KINDS[kind], True, {"label": text, "unit": unit.rstrip(")")}))
    return StructType(out)


def faults(fields: Sequence[tuple[str, str, str]]) -> list[str]:
    """What is wrong with a table of fields: names repeated or alike in their first ten characters, labels missing or over 55 characters."""
    out, names, short = [], set(), {}
    for name, kind, label in fields:
        if name in names:
            out.append(f"{name}: repeated")
        elif (first := short.setdefault(name[:10], name)) != name:
            out.append(f"{name}: begins like {first}")
        names.add(name)
        if kind not in KINDS:
            out.append(f"{name}: unknown type {kind}")
        if not label or len(label) > 55:
            out.append(f"{name}: label of {len(label)} characters")
    return out


def differences(declared: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that one of two tables lacks (key, missing_in: 'known' or 'declared'), each once."""
    a, b = declared.select(key).distinct(), known.select(key).distinct()
    lack = lambda x, y, name: x.exceptAll(y).withColumn("missing_in", F.lit(name))
    return lack(a, b, "known").unionByName(lack(b, a, "declared"))


def fitted(df: DataFrame, wanted: StructType) -> DataFrame:
    """The wanted columns in order, cast, null where df lacks them, with the wanted metadata."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in wanted])


def pivoted(df: DataFrame, keys: Sequence[str], label: str, value: Column, names: dict[str, str], zero: Sequence[str] = ()) -> DataFrame:
    """One column for each of a fixed list of classes (class: column); absent classes are null, or 0 for columns in ``zero``."""
    cols = []
    for cls, name in names.items():
        total = F.sum(F.when(F.col(label) == cls, value))
        cols.append((F.coalesce(total, F.lit(0)) if name in zero else total).alias(name))
    return df.groupBy(*keys).agg(*cols)


def indicators(df: DataFrame, key: str, themes: dict[str, str]) -> DataFrame:
    """Long table (key, theme, field, label, unit, number, text) of the values that are known; themes: by field."""
    parts = []
    for f in df.schema:
        if f.name == key or f.name not in themes:
            continue
        text = isinstance(f.dataType, (StringType, BooleanType))
        number = F.lit(None).cast("double") if text else F.col(f.name).cast("double")
        label = f.metadata.get("label", f.name)
        parts.append(F.struct(*[F.lit(x).alias(n) for n, x in (("theme", themes[f.name]), ("field", f.name), ("label", label), ("unit", f.metadata.get("unit", "")))], number.alias("number"), (F.col(f.name).cast("string") if text else F.lit(None).cast("string")).alias("text")))
    rows = df.select(key, F.explode(F.array(*parts)).alias("i")).select(key, "i.*")
    return rows.where("number is not null or text is not null")


def assembled(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """One row a key: the base with the columns of every part that has them."""
    out = base
    for part in parts:
        out = out.join(part, key, "left")
    return out


def trace(df: DataFrame, key: str, points: dict[str, tuple[str, str]]) -> DataFrame:
    """The known ones of several named points a row, one row each (key, origin, x, y)."""
    each = F.array(*[F.struct(F.lit(n).alias("origin"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for n, (x, y) in points.items()])
    return df.select(key, F.explode(each).alias("p")).select(key, "p.*").where("x is not null and y is not null")
